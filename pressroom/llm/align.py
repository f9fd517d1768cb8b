"""Alignment of two tokenizers' tokens over the same bytes, as an Arrow pipeline.

In a task, the ids of a slice of documents are lists; flattened, with their parent indices and segmented
cumulative sums of token lengths, they give the byte where each token ends.  Acero joins both sides on (document, end):
ends that both have cut the document into groups, and the ends of either, in order, part it into the overlaps
of one token with another, which are the links.  Each task counts its links by pair of ids with Table.group_by; Spark
merges the counts and deals what each task's pairs count in the whole corpus back to it, and a second
Acero join sums those by document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BYTE_OF
from .files import read_all, replacing
from .pieces import Spans, pieces, spread
from .scratch import keep, new_folder
from .textops import U64
from .token_ids import REMEMBERED, tokenizer_path
from .token_ids import _by_value as by_value

#: Between printable ASCII characters, a space begins a token of both tokenizers.
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: White space outside ASCII.
_ODD_SPACE = re.compile(r"(?![\x00-\x7f])\s")
_PLAIN = re.compile(rb" [!-~]+")
#: Pairs that a task holds before it merges its counts, and that go into one row.
_PAIRS, _ROW = 1 << 21, 1 << 16

_tokenizers: dict[tuple[str, str], "TwoTokenizers"] = {}


class TwoTokenizers:
    """The ids of texts by a byte-level BPE (A, of a space and the text) and by a sentencepiece model that adds a space (B).

    Texts are cut before a space that follows no white space, where a token of either begins for certain: A's pattern takes a space along
    with what follows, and no piece of B has a space after anything else (checked here; if one has, texts stay whole).
    Each distinct unit is encoded once; units are told apart by 64-bit hashes.
    """

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        names = self.a.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(names.values()) + 1, self.b.get_piece_size()
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("pairs of ids take more than 32 bits")
        self.a_bytes = [b""] * self.n_a
        for name, i in names.items():
            self.a_bytes[i] = bytes(BYTE_OF[c] for c in name)
        pieces_of = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_of)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces_of) and json.loads(self.a.to_str())["pre_tokenizer"].get("use_regex", False)
        self.a_size, self.b_size = (pa.array([len(x) for x in side], pa.int32()) for side in (self.a_bytes, self.b_bytes))
        # Ids as text with each sign that may follow: A's table, then B's.
        top = max(self.n_a, self.n_b)
        self.words = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(top)], pa.string())
        self.top = top
        self.forget()

    @classmethod
    def of(cls, first: str, second: str) -> "TwoTokenizers":
        if (first, second) not in _tokenizers:
            _tokenizers[first, second] = cls(first, second)
        return _tokenizers[first, second]

    def forget(self) -> None:
        self.keys, self.start, self.flat = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.many, self.same = np.zeros((0, 2), dtype=np.int32), np.zeros(0, dtype=bool)

    def _plain(self, units: list[bytes]) -> list[list[int]]:
        """A's ids of units without inner white space: encoded as one text, cut where the units end."""
        ids = np.array(self.a.encode(b"".join(units).decode(), add_special_tokens=False).ids, dtype=np.int64)
        ends = np.cumsum(self.a_size.to_numpy()[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(u) for u in units]), side="left") + 1
        return [x.tolist() for x in np.split(ids, cuts[:-1])]

    def _learn(self, units: list[bytes], hashes: np.ndarray) -> None:
        a: list[list[int]] = [[]] * len(units)
        plain = [i for i, u in enumerate(units) if _PLAIN.fullmatch(u)] if self.cuts else []
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            for k, ids in zip(some, self._plain([units[k] for k in some])):
                a[k] = ids
        rest = [i for i, x in enumerate(a) if not x]
        texts = [u.decode("utf-8", "replace") for u in units]
        for k, e in zip(rest, self.a.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            a[k] = e.ids
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        same = [b"".join([self.a_bytes[i] for i in x]) == u and b"".join([self.b_bytes[i] for i in y]) == u for u, x, y in zip(units, a, b)]
        many = np.array([(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int32)
        total = many.sum(axis=1)
        start = len(self.flat) + np.cumsum(total, dtype=np.int64) - total
        self.flat = np.concatenate((self.flat, np.array([i for x, y in zip(a, b) for i in (*x, *y)], dtype=np.int32)))
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.start, self.same = np.insert(self.keys, at, hashes[order]), np.insert(self.start, at, start[order]), np.insert(self.same, at, np.array(same, dtype=bool)[order])
        self.many = np.insert(self.many, at, many[order], axis=0)

    def lists(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Both sides' ids of each text of a block, which begin with their leading space, and which texts both sides give back byte for byte; the others get no ids."""
        begin = np.zeros(len(data) + 1, dtype=bool)
        filled = np.diff(offsets) > 0
        if self.cuts and len(data):
            before, space = data[:-1], data[1:] == 0x20
            certain = (before > 0x20) & (before < 0x7F)
            if _ODD_SPACE.search(data.tobytes().decode("utf-8", "replace")):
                begin[1:-1] = space & certain
            else:
                begin[1:-1] = space & (certain | (before >= 0x80))
            # A space that ends a text stays with what stands before it: without text, B adds no space.
            begin[offsets[1:] - 1] = False
        begin[offsets[:-1][filled]] = True
        start = np.flatnonzero(begin[:-1])
        end = np.concatenate((start[1:], [len(data)]))
        hashes = Spans(data, start, end).hashes()
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if len(self.keys) + int((~known).sum()) > REMEMBERED:
            self.forget()
            known[:] = False
        new = first[~known]
        if len(new):
            raw = data.tobytes()
            self._learn([raw[i:j] for i, j in zip(start[new].tolist(), end[new].tolist())], unique[~known])
        at = np.searchsorted(self.keys, unique)[which]
        many = self.many[at].astype(np.int64)
        of_text = np.searchsorted(start, offsets)
        wrong = np.concatenate(([0], np.cumsum(~self.same[at])))[of_text]
        good = filled & (np.diff(wrong) == 0)
        many[np.repeat(~good, np.diff(of_text))] = 0
        sides = []
        for side, head in ((0, 0), (1, self.many[at, 0])):
            ids = self.flat[spread(self.start[at] + head, many[:, side])]
            upto = np.concatenate(([0], np.cumsum(many[:, side])))[of_text]
            sides.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids)))
        return sides[0], sides[1], good


def _ends(lists: pa.ListArray, size: pa.Array, name: str) -> pa.Table:
    """A row for each token: its document and end as one key, and its id."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.cast(pc.take(size, ids), pa.int64()))
    # What stood before a list's first token comes off the sums of all of its tokens.
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), pc.cast(lists.offsets.slice(0, len(lists)), pa.int64()))
    end = pc.subtract(total, pc.take(before, parent))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(pc.cast(parent, pa.int64()), 40), end), name: ids})


def align(a: pa.ListArray, b: pa.ListArray, two: TwoTokenizers) -> tuple[pa.Table, pa.StringArray, np.ndarray]:
    """Links (doc, code) in order, the documents' groups token by token as text, and the groups of each document.

    a and b are both sides' ids by document, of the same bytes.  A code is A's id times B's vocabulary and B's id.
    """
    rows = _ends(a, two.a_size, "a").join(_ends(b, two.b_size, "b"), "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    has_a, has_b = (rows[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in ("a", "b"))
    doc = pc.shift_right(rows["key"], 40)
    both = has_a & has_b
    groups = pa.table({"doc": doc.filter(pa.array(both))}).group_by("doc", use_threads=False).aggregate([([], "count_all")])
    n_groups = np.zeros(len(a), dtype=np.int64)
    n_groups[groups["doc"].to_numpy()] = groups["count_all"].to_numpy()
    # A byte range belongs to the tokens that end next.
    left, right = (pc.cast(pc.fill_null_backward(rows[c]), pa.int64()) for c in ("a", "b"))
    links = pa.table({"doc": doc, "code": pc.cast(pc.add(pc.multiply(left, two.n_b), right), pa.uint32())})
    # Groups in order, A's tokens before B's.
    group = np.cumsum(both) - both
    of_a, of_b = group[has_a], group[has_b]
    n = int(both.sum())
    in_a, in_b = np.cumsum(np.bincount(of_a, minlength=n)), np.cumsum(np.bincount(of_b, minlength=n))
    word = np.empty(len(of_a) + len(of_b), dtype=np.int64)
    word[np.arange(len(of_a)) + np.concatenate(([0], in_b))[of_a]] = a.flatten().to_numpy() + np.where(both[has_a], two.top, 0)
    word[np.arange(len(of_b)) + in_a[of_b]] = b.flatten().to_numpy() + np.where(both[has_b], 2 * two.top, 0)
    return links, pc.take(two.words, pa.array(word)), n_groups


_KEPT = "kind int, chunk int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, codes array<long>, counts array<long>"



def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])


def _counted(codes: pa.Array) -> pa.Table:
    return pa.table({"code": codes}).group_by("code", use_threads=False).aggregate([([], "count_all")]).rename_columns(["code", "n"])


class _Slice:
    """What align gives for the documents of a slice, cut by document: sizes (A, B, groups, links), codes and groups as text."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, two: TwoTokenizers) -> None:
        links, words, n_groups = align(a, b, two)
        self.codes = links["code"].combine_chunks()
        per_doc = np.bincount(links["doc"].to_numpy(), minlength=len(a))
        self.sizes = np.stack([np.diff(a.offsets), np.diff(b.offsets), n_groups, per_doc], axis=1).astype(np.int64)
        self.at_link = (4 * np.concatenate(([0], np.cumsum(per_doc)))).tolist()
        self.raw = self.codes.to_numpy().astype("<u4").tobytes()
        _, offs, text = words.buffers()
        places = np.frombuffer(offs, dtype=np.int32)[: len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
        self.at_word = places[np.concatenate(([0], np.cumsum(self.sizes[:, 0] + self.sizes[:, 1])))].tolist()
        self.text = memoryview(text if text is not None else b"")

    def links(self, k: int) -> bytes:
        return self.raw[self.at_link[k] : self.at_link[k + 1]]

    def groups(self, k: int) -> memoryview:
        """Without the sign after the last group."""
        return self.text[self.at_word[k] : max(self.at_word[k], self.at_word[k + 1] - 1)]


def _align(first: str, second: str, digest: bool):
    shown = (lambda x: hashlib.sha256(x).hexdigest() if len(x) else "") if digest else (lambda x: bytes(x).decode())
    names = [c.split()[0] for c in _KEPT.split(", ")]

    def row_batch(ids: pa.Array, chunk: int, sizes: np.ndarray, groups: list[str], links: list[bytes]) -> pa.RecordBatch:
        n, nothing = len(ids), pa.nulls(len(ids), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), ids, *[pa.array(sizes[:, c]) for c in range(4)], pa.array(groups, pa.string()), pa.array(links, pa.binary()), nothing, nothing], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, chunk = TwoTokenizers.of(first, second), TaskContext.get().partitionId()
        counts: list[pa.Table] = []
        held: list[_Slice] = []  # pieces of a long text
        fine = True
        for batch in batches:
            for i, j, data, offsets, last in pieces(batch.column("text"), _SAFE):
                if not held:  # each text gets its leading space; the later pieces of one begin with their own
                    filled = np.diff(offsets) > 0
                    data, offsets = np.insert(data, offsets[:-1][filled], 0x20), offsets + np.concatenate(([0], np.cumsum(filled)))
                a, b, good = two.lists(data, offsets)
                part = _Slice(a, b, two)
                if held or not last:
                    fine = bool(good[0]) and (fine or not held)
                    held.append(part)
                    if not last:
                        continue
                    # Pieces end groups.  A text that one piece spoils has no tokens at all.
                    whole = held if fine else []
                    sizes = sum((p.sizes for p in whole), np.zeros((1, 4), dtype=np.int64))
                    yield row_batch(batch.column("doc_id").slice(i, 1), chunk, sizes, [shown(b";".join(p.groups(0) for p in whole))], [b"".join(p.links(0) for p in whole)])
                    counts += [_counted(p.codes) for p in whole]
                    held = []
                else:
                    yield row_batch(batch.column("doc_id").slice(i, j - i), chunk, part.sizes, [shown(part.groups(k)) for k in range(j - i)], [part.links(k) for k in range(j - i)])
                    counts.append(_counted(part.codes))
                if sum(len(t) for t in counts) > _PAIRS:
                    counts = [_merged(counts)]
        if counts:
            total = _merged(counts)
            for i in range(0, len(total), _ROW):
                some = total.slice(i, _ROW)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pc.cast(some[c].combine_chunks(), pa.int64())) for c in ("code", "n")]
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([chunk], pa.int32()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *lists], names=names)

    return run


def _write_worth(folder: str):
    """Write what the pairs of each chunk count to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_value(batches, "chunk"):
            chunk = t["chunk"][0].as_py()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, t.select(["code", "n", "best"]).schema) as out:
                out.write_table(t.select(["code", "n", "best"]))
            with replacing(f"{folder}/worth-{chunk:06d}.arrow") as write:
                write(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([t.num_rows], pa.int64())], names=["chunk", "n"])

    return run


def _sum_worth(folder: str):
    """What the links of each row count, by a join with the file of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, worth = None, None
        for batch in batches:
            chunks, links = batch.column("chunk").to_numpy(), batch.column("links")
            size = pc.binary_length(links).to_numpy() // 4
            i = 0
            while i < len(chunks):
                # Rows of one chunk, of about a million links at once.
                upto = np.cumsum(size[i:])
                j = i + max(1, int(np.searchsorted(upto, 1 << 20, side="right")))
                other = np.flatnonzero(chunks[i:j] != chunks[i])
                j = i + int(other[0]) if len(other) else j
                sums = np.zeros((j - i, 2), dtype=np.int64)
                if size[i:j].any():
                    if chunks[i] != chunk:
                        chunk = int(chunks[i])
                        worth = pa.ipc.open_file(pa.BufferReader(read_all(f"{folder}/worth-{chunk:06d}.arrow"))).read_all()
                    codes = np.frombuffer(b"".join(links.slice(i, j - i).to_pylist()), dtype="<u4").astype(np.int64)
                    rows = pa.table({"doc": np.repeat(np.arange(j - i), size[i:j]), "code": codes})
                    # The shorter side is the one that is hashed.
                    rows = rows.join(worth, "code", join_type="inner", use_threads=False)
                    if len(rows) != len(codes):
                        raise ValueError(f"a pair of chunk {chunk} has no count")
                    found = rows.group_by("doc", use_threads=False).aggregate([("best", "sum"), ("n", "sum")])
                    sums[found["doc"].to_numpy()] = np.stack([found["best_sum"].to_numpy(), found["n_sum"].to_numpy()], axis=1)
                rest = [batch.column(c).slice(i, j - i) for c in _METRICS]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=[*_METRICS, "n_best", "count_sum"])
                i = j

    return run


_METRICS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]


class Alignment:
    """Both tokenizers' alignment of a corpus, written once in the shared folder.

    documents() gives a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, groups (as text `a1,a2|b1;...`, or its SHA-256 with digest),
    n_best (links whose pair of ids counts most of those with their B id, ties included) and count_sum (what the pairs of its links count, in sum).
    pairs() gives (a, b, n): how many links of the corpus hold each pair of ids.

    Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros and an empty groups.  Rows keep null and repeated
    ids, and each counts; other columns are left out; no rows give no rows.  Memory follows a slice of a million bytes, and for a longer text the links of that text.
    """

    def __init__(self, docs: DataFrame, first: str | None = None, second: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
        first, second = first or tokenizer_path("byte_bpe_50k.json"), second or tokenizer_path("piece_bpe_32k.model")
        self.folder = new_folder(docs.sparkSession, "alignment")
        self.n_b = TwoTokenizers.of(first, second).n_b
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.kept = keep(rows.mapInArrow(_align(first, second, digest), _KEPT), "aligned", compression="zstd")
        self.parts = self.kept.where("kind = 1").select("chunk", F.inline(F.arrays_zip("codes", "counts"))).select("chunk", F.col("codes").alias("code"), F.col("counts").alias("n"))
        self.totals = keep(self.parts.groupBy("code").agg(F.sum("n").alias("n")), "pairs")

    def pairs(self) -> DataFrame:
        return self.totals.select(F.floor(F.col("code") / self.n_b).cast("int").alias("a"), (F.col("code") % self.n_b).cast("int").alias("b"), "n")

    def documents(self) -> DataFrame:
        b = F.col("code") % self.n_b
        most = self.totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
        worth = self.totals.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
        dealt = self.parts.select("chunk", "code").join(worth, "code").repartition("chunk").sortWithinPartitions("chunk")
        keep(dealt.select("chunk", "code", "n", "best").mapInArrow(_write_worth(self.folder), "chunk int, n long"), "worth")
        rows = self.kept.where("kind = 0").select("chunk", *_METRICS, "links")
        return rows.mapInArrow(_sum_worth(self.folder), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).documents().withColumnRenamed("groups", "groups_sha256")
