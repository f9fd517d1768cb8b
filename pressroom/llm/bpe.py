"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that no token of the vocabulary has inside can never be joined, so
a text may be cut there for certain.  The fragments between such cuts are encoded each by itself, equal ones
once, and their ids stand one after another.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import Spans, pieces, spread
from .textops import U64, mix
from .token_ids import REMEMBERED, Encoder, tokenizer_path

LETTER, DIGIT, OTHER, BLANK = range(4)
#: White space is in no token of a tokenizer that drops it: texts may always be cut before it.
_BLANKS = re.compile(rb"[\t-\r ]")
_FINAL = U64(0x8CB92BA72F3D8DD7)
_coders: dict[str, "ForcedBoundaryCoder"] = {}


def byte_of_char() -> dict[str, int]:
    """Bytes by the letters that stand for them in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE_OF = byte_of_char()
CHAR_OF = {b: c for c, b in BYTE_OF.items()}


def _second_of_composition() -> frozenset[int]:
    """Code points that canonical composition may join to the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(range(0x1161, 0x1176)) | frozenset(range(0x11A8, 0x11C3))


class ForcedBoundaryCoder(Encoder):
    """Ids of texts, and texts of ids, for byte-level BPE tokenizers.

    A word's last symbol may carry the vocabulary's end-of-word suffix, so there are two tables of joinable pairs: one
    for pairs that end a word, one for all others; fragments that end a word are encoded with the
    suffix and others without it.  Known fragments are told apart by 64-bit hashes.

    With the rules that token_ids describes, whole blocks of texts are lower-cased and cut into words by tables of code points, which the
    tokenizer's own parts fill in; texts with code points that composition could join, or with
    special tokens, and all texts of other byte-level tokenizers, go through those parts one by one.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        from tokenizers import models

        model = json.loads(self.tokenizer.to_str())["model"]
        self.joined = self.tokenizer.decoder is None
        if model["type"] != "BPE" or "ByteLevel" not in repr(self.tokenizer.pre_tokenizer) or not (self.joined or "ByteLevel" in repr(self.tokenizer.decoder)):
            raise ValueError("not a byte-level BPE tokenizer")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.ending, self.inner = self.tokenizer.model, models.BPE(model["vocab"], merges) if suffix else self.tokenizer.model
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.joins = np.zeros((2, 256, 256), dtype=bool)
        pieces_of = [b""] * (self.top + 1)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            pieces_of[i] = token.encode() + b" " if self.joined else bytes(BYTE_OF[c] for c in token)
            if token in self.added:
                continue
            ends = bool(suffix) and token.endswith(suffix)
            body = [BYTE_OF[c] for c in (token[: -len(suffix)] if ends else token)]
            for k, pair in enumerate(zip(body, body[1:])):
                self.joins[int(ends and k == len(body) - 2)][pair] = True
        if not suffix:
            self.joins[1] = self.joins[0]
        self.token_bytes = np.frombuffer(b"".join(pieces_of), dtype=np.uint8)
        self.token_size = np.array([len(p) for p in pieces_of], dtype=np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.low = np.full(0x110000, -2, dtype=np.int32)
        self.kind = np.zeros(0x110000, dtype=np.uint8)
        self.joining = _second_of_composition()

    @classmethod
    def of(cls, path: str) -> "ForcedBoundaryCoder":
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def _meet(self, points: list[int]) -> None:
        """Fill in the tables for code points: the lower-case one that stands for it (-1: not just one, or it may be composed) and its kind of word."""
        for c in points:
            plain = self.tokenizer.normalizer.normalize_str(chr(c))
            if len(plain) != 1 or c in self.joining or ord(plain) in self.joining or unicodedata.combining(chr(c)):
                self.low[c] = -1
                continue
            self.low[c] = ord(plain)
            count = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
            self.kind[c] = BLANK if not count(plain) else LETTER if count("a" + plain) == 1 else DIGIT if count(plain + plain) == 2 else OTHER

    # ---- words ------------------------------------------------------------------------------

    def _words(self, c: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of lower-case code points begin; first tells where texts do.

        A word is a contraction (' and s, t, re, ve, m, ll or d, where the ' begins a match), letters, one digit, or other signs.
        """
        n = len(c)
        begin = first.copy()
        begin[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero((c[:-1] == ord("'")) & begin[:-1] & begin[1:] & (kind[1:] == LETTER) & ~first[1:]) if n > 1 else np.zeros(0, dtype=np.int64)
        one = c[at + 1]
        follows = at + 2 < n
        two = np.where(follows & ~begin[np.minimum(at + 2, n - 1)], c[np.minimum(at + 2, n - 1)], 0)
        pair = np.zeros(len(at), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (one == ord(x)) & (two == ord(y))
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, np.where(pair, 2, 0))
        at, size = at[size > 0], size[size > 0]
        begin[at + 1] = False
        rest = at + 1 + size
        begin[rest[rest < n]] = True
        return begin

    def _slowly(self, text: str) -> tuple[bytes, list[int], dict[int, int]]:
        """A text through the tokenizer's own parts: its bytes, where its words begin, and special tokens by the place where they begin."""
        out, begin, special = bytearray(), [], {}
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                special[len(out)] = self.added[part]
                begin.append(len(out))
                out += part.encode()
                continue
            plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                begin.append(len(out))
                out += bytes(BYTE_OF[c] for c in word)
        return bytes(out), begin, special

    # ---- fragments --------------------------------------------------------------------------

    def _fragments(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where fragments begin, and which of them end a word: words are cut at all pairs that no token has inside."""
        ends = np.ones(len(data), dtype=bool)
        ends[:-1] = begin[1:]
        cut = begin.copy()
        cut[1:] |= ~self.joins[ends[1:].astype(np.int8), data[:-1], data[1:]]
        start = np.flatnonzero(cut)
        return start, ends[np.concatenate((start[1:], [len(data)])) - 1] if len(start) else np.zeros(0, dtype=bool)

    def _encode(self, fragment: bytes, final: bool) -> bytes:
        model = self.ending if final else self.inner
        return np.array([t.id for t in model.tokenize("".join(CHAR_OF[b] for b in fragment))], dtype=self.dtype).tobytes()

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments one after another, and how many each has; each distinct fragment is encoded once."""
        hashes = Spans(data, start, end).hashes()
        hashes = np.where(final, mix(hashes ^ _FINAL), hashes)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._place(unique)[1]
        if len(self.keys) + int((~known).sum()) > REMEMBERED:
            self.forget()
            known[:] = False
        new = first[~known]
        if len(new):
            text = data.tobytes()
            self._add(unique[~known], [self._encode(text[i:j], f) for i, j, f in zip(start[new].tolist(), end[new].tolist(), final[new].tolist())])
        at = self._place(unique)[0][which]
        size = self.size[at].astype(np.int64)
        return self.flat[spread(self.start[at], size)], size

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block."""
        n = len(offsets) - 1
        text = data.tobytes().decode("utf-8", "replace")
        whole = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        if len(whole) == int(((data & 0xC0) != 0x80).sum()):
            bounds = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        else:  # bytes that aren't UTF-8: each text by itself
            parts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:])]
            whole = np.array([ord(c) for p in parts for c in p], dtype=np.int64)
            bounds = np.cumsum([0, *map(len, parts)])
        slow = np.zeros(n, dtype=bool)
        if not self.wordwise:
            slow[:] = True
        else:
            seen = np.unique(whole)
            self._meet(seen[self.low[seen] == -2].tolist())
            odd = np.flatnonzero(self.low[whole] < 0)
            slow[np.searchsorted(bounds, odd, side="right") - 1] = True
            if self.specials:
                odd = np.array([m.start() for m in self.specials.finditer("".join(map(chr, whole)) if len(text) != len(whole) else text)], dtype=np.int64)
                slow[np.searchsorted(bounds, odd, side="right") - 1] = True
        out: list[np.ndarray | None] = [None] * n
        for i in np.flatnonzero(slow).tolist():
            out[i] = self._one("".join(map(chr, whole[bounds[i] : bounds[i + 1]].tolist())))
        size = np.where(slow, 0, np.diff(bounds))
        c = self.low[whole[np.repeat(~slow, np.diff(bounds))]] if slow.any() else self.low[whole]
        kind = self.kind[c]
        first = np.zeros(len(c) + 1, dtype=bool)
        first[np.concatenate(([0], np.cumsum(size)))] = True
        begin = self._words(c, kind, first[:-1]) if len(c) else first[:-1]
        wide = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        place = np.concatenate(([0], np.cumsum(wide)))
        low = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        at = np.zeros(len(low), dtype=bool)
        at[place[:-1][begin]] = True
        start, final = self._fragments(low, at)
        end = np.concatenate((start[1:], [len(low)]))
        keep = ~np.repeat(kind == BLANK, wide)[start]
        start, end, final = start[keep], end[keep], final[keep]
        ids, each = self._ids(low, start, end, final)
        upto = np.concatenate(([0], np.cumsum(each)))[np.searchsorted(start, place[np.concatenate(([0], np.cumsum(size)))])]
        for i in np.flatnonzero(~slow).tolist():
            out[i] = ids[upto[i] : upto[i + 1]]
        return out

    def _one(self, text: str) -> np.ndarray:
        raw, words, special = self._slowly(text)
        data = np.frombuffer(raw, dtype=np.uint8)
        begin = np.zeros(len(data), dtype=bool)
        begin[words] = True
        start, final = self._fragments(data, begin)
        end = np.concatenate((start[1:], [len(data)]))
        if not special:
            return self._ids(data, start, end, final)[0]
        # Fragments of a special token give its id once.
        inside = {i: np.arange(i, i + len(self.tokenizer.id_to_token(t).encode())) for i, t in special.items()}
        held = np.isin(start, np.concatenate(list(inside.values())))
        ids, each = self._ids(data, start[~held], end[~held], final[~held])
        upto = np.concatenate(([0], np.cumsum(each)))
        places = start[~held]
        out, last = [], 0
        for i, t in special.items():
            cut = int(upto[np.searchsorted(places, i)])
            out += [ids[last:cut], np.array([t], dtype=ids.dtype)]
            last = cut
        return np.concatenate([*out, ids[last:]])

    def text_of(self, ids: np.ndarray) -> bytes:
        """The text of the ids' tokens: without a decoder their names joined by spaces, else their bytes, those that aren't UTF-8 replaced."""
        ids = ids.astype(np.int64)
        whole = self.token_bytes[spread(self.token_start[ids], self.token_size[ids])].tobytes()
        if self.joined:
            return whole[:-1]
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace").encode()

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(from, to, ids of each row) over a column of texts; a long text is encoded in pieces."""
        held: list[np.ndarray] = []
        # Only where white space is dropped may a text be cut before it.
        for i, j, data, offsets, last in pieces(column, _BLANKS if self.wordwise else re.compile(rb"(?!)")):
            found = self.block(data, offsets)
            if j == i + 1 and (held or not last):
                held += found
                if last:
                    yield i, j, [np.concatenate(held)]
                    held = []
                continue
            yield i, j, found


def _encode(tokenizer: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryCoder.of(tokenizer).width(4)
        for batch in batches:
            for i, j, ids in coder.texts(batch.column("text")):
                columns = [batch.column("doc_id").slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([coder.text_of(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of docs: the token ids of its whole text as little-endian unsigned 32-bit integers; with decoded, also the text of those ids.

    Null and empty texts have no ids.  Rows keep null and repeated ids; columns other than the two named are left out.
    Texts longer than a piece are cut before white space where the tokenizer drops that.  No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer or tokenizer_path(), decoded), "doc_id long, ids binary" + (", decoded string" if decoded else ""))


def bpe_decode(rows: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for each row of ids as bpe_encode gives them, special tokens written out; null ids give an empty text."""

    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryCoder.of(path).width(4)
        for batch in batches:
            texts = [coder.text_of(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
