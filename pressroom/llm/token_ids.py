"""Documents as raw token ids, with a minimal perfect hash index by document key."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import read_all, read_at, replacing
from .scratch import keep, new_folder
from .textops import SPACED, U64, Block, blocks, mix

SHARD_BYTES = 32 << 20
BUCKET_KEYS = 1 << 15
#: Words whose ids a worker remembers, at some 30 bytes each; beyond it, it starts afresh.
REMEMBERED = 1 << 20
#: Bytes of text that are encoded at once, or one whole longer text.
_PIECE = 1 << 20
_GAMMA, _MAGIC = 2.0, b"PRIX0001"
_ENTRY = "doc_id long, shard int, first long, n_tokens int, crc long"

#: Shards whose starts are summed in one group.
_GROUP = 4096

_encoders: dict[str, "Encoder"] = {}
# How a tokenizer whose ids can be taken word by word describes its rules.
_WORDWISE = (
    r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])',
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""",
)
#: UTF-8 of Latin letters (ß to ɏ) that are letters in every version of Unicode, and ASCII signs that no pattern joins to a letter.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
_SIGNS = b".,!?;:)]}\"*#$%&"


class Encoder:
    """Ids of whole texts, by encoding each distinct word once where the tokenizer's rules allow it.

    A tokenizer with the rules of _WORDWISE replaces white space by one space
    and drops it before merging, and none of its patterns crosses white space, so a text's
    ids are those of its words, split at ASCII white space, one after another.  It lower-cases, so
    words are kept in lower case in A-Z; a word of Latin letters and a tail of signs has the ids
    of both, since a pattern takes either letters or signs.  Words of letters are encoded together
    and told apart by the tokens that end a word.  Known words are told apart by 64-bit hashes, in sorted
    arrays beside their ids, which take a tenth of the memory of Python objects.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.top = max(vocab.values())
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.wordwise = bool(suffix) and (repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)) == _WORDWISE
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.top + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.forget()
        self.width(4)

    def forget(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=getattr(self, "dtype", "<u4"))

    def width(self, size: int) -> "Encoder":
        """Bytes of an id in what this returns."""
        if getattr(self, "dtype", None) != f"<u{size}":
            self.dtype = f"<u{size}"
            self.forget()
        return self

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _each(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 4096):
            out += [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 4096]], add_special_tokens=False)]
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of letters only: each should end with one token that ends a word; where the count differs, one by one."""
        out: list[bytes] = []
        for i in range(0, len(words), 1024):
            part = words[i : i + 1024]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part) or stop[-1] != len(ids):
                out += self._each(part)
                continue
            data, at = ids.astype(self.dtype).tobytes(), (stop * np.dtype(self.dtype).itemsize).tolist()
            out += [data[i:j] for i, j in zip([0, *at], at)]
        return out

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the known words, and whether it does."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def _add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        flat = np.frombuffer(b"".join([ids[i] for i in first.tolist()]), dtype=self.dtype)
        size = np.array([len(ids[i]) for i in first.tolist()], dtype=np.int32) // flat.itemsize
        start = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.start, self.size = np.insert(self.keys, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.flat = np.concatenate((self.flat, flat))

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Remember new words: a core of letters and a tail of signs have ids of their own, which may be known."""
        cut = [len(w.rstrip(_SIGNS)) for w in words]
        parts = [(w[:n], w[n:]) if 0 < n < len(w) and _LETTERS.fullmatch(w, 0, n) else (w, b"") for w, n in zip(words, cut)]
        atoms = list(dict.fromkeys(x for pair in parts for x in pair if x))
        data = np.frombuffer(b" ".join(atoms), dtype=np.uint8)
        own = Block(data, np.array([0, len(data)]), SPACED, lower=False).hashes()
        at, known = self._place(own)
        ids: dict[bytes, bytes] = {}
        for i in np.flatnonzero(known).tolist():
            j = at[i]
            ids[atoms[i]] = self.flat[self.start[j] : self.start[j] + self.size[j]].tobytes()
        new = [a for a, k in zip(atoms, known.tolist()) if not k]
        letters = [a for a in new if _LETTERS.fullmatch(a)]
        others = [a for a in new if not _LETTERS.fullmatch(a)]
        ids |= dict(zip(letters, self._together(letters))) | dict(zip(others, self._each(others)))
        self._add(np.concatenate((own[~known], hashes)), [ids[a] for a in new] + [ids[a] + ids[b] if b else ids[a] for a, b in parts])

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column of strings; null is empty."""
        out: list[bytes] = []
        for i, j, block in blocks(texts, SPACED, lower=self.wordwise, target=_PIECE):
            if not self.wordwise:
                whole = [t or "" for t in texts.slice(i, j - i).cast(pa.string()).to_pylist()]
                out += [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
                continue
            data = block.data.tobytes()
            if any(x in data for x in self.special):
                # Special tokens are written as they stand, in no other case.
                block = Block(block.raw, block.offsets, SPACED, lower=False)
                data = block.data.tobytes()
            unique, first, word = np.unique(block.hashes(), return_index=True, return_inverse=True)
            known = self._place(unique)[1]
            if len(self.keys) + 2 * int((~known).sum()) > REMEMBERED:
                self.forget()
                known[:] = False
            new = first[~known]
            if len(new):
                self._learn([data[i:j] for i, j in zip(block.starts[new].tolist(), block.ends[new].tolist())], unique[~known])
            at = self._place(unique)[0][word]
            each = self.size[at].astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(each)))
            whole = self.flat[np.repeat(self.start[at] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
            cuts = (ends[block.bounds] * self.flat.itemsize).tolist()
            out += [whole[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def __call__(self, text: bytes) -> bytes:
        return self.many(pa.array([text], pa.binary()))[0]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# ---- shards -------------------------------------------------------------------------------


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes of an id in the shards: two where all ids fit."""
    return 2 if max(Encoder.of(tokenizer).top, end_id) < 1 << 16 else 4


def _write_shards(folder: str, tokenizer: str, end_id: int, width: int):
    """Write the rows of a partition to one shard; return each row's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is None:
            return
        encoder, shard, place = Encoder.of(tokenizer).width(width), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(width, "little")
        out = []
        with replacing(f"{folder}/shard-{shard:06d}.bin") as write:
            for batch in chain([first_batch], batches):
                starts, counts, crcs = [], [], []
                for ids in encoder.many(batch.column("text")):
                    ids += end
                    write(ids)
                    starts.append(place)
                    counts.append(len(ids) // width)
                    crcs.append(zlib.crc32(_wide(ids, width)))
                    place += counts[-1]
                out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shard] * batch.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int32()), pa.array(crcs, pa.int64())], names=["doc_id", "shard", "first", "n_tokens", "crc"]))
        yield from out

    return run


def _wide(ids: bytes, width: int) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()


# ---- minimal perfect hash -----------------------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U64) + U64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def bucket_of(key: int, n_buckets: int) -> int:
    return int(_hash(np.array([key]), 101)[0] % U64(n_buckets))


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits, and the slot in 0..n-1 of each of the distinct keys.

    At each level a key whose hash no other remaining key shares sets a bit; its slot is the
    number of bits before it.  The others go on to the next, smaller level.
    """
    levels, slots = [], np.zeros(len(keys), dtype=np.int64)
    left, used = np.arange(len(keys)), 0
    while len(left):
        size = max(64, int(_GAMMA * len(left)))
        at = (_hash(keys[left], len(levels)) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = used + rank[at[placed]]
        used += int(placed.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 202) >> U64(32)).astype(np.uint32)


def pack_index(keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """One index file: levels with their ranks, then an entry (fingerprint, shard, tokens, first) for each slot."""
    levels, slots = build_mph(keys)
    entries = np.zeros(len(keys), dtype=[("print", "<u4"), ("shard", "<u4"), ("n", "<u8"), ("first", "<u8")])
    entries["print"][slots], entries["shard"][slots], entries["n"][slots], entries["first"][slots] = _fingerprint(keys), shard, count, first
    out = [_MAGIC, struct.pack("<II", len(keys), len(levels))]
    used = 0
    for bits in levels:
        words = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<u8")
        ranks = (used + np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1]))).astype("<u4")
        used += int(bits.sum())
        out += [struct.pack("<Q", len(bits)), words.tobytes(), ranks.tobytes()]
    return b"".join([*out, entries.tobytes()])


class IndexFile:
    """Constant-time lookup in one index file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        self.n, n_levels = struct.unpack_from("<II", data, 8)
        at, self.levels = 16, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", data, at)
            n = -(-size // 64)
            self.levels.append((size, np.frombuffer(data, "<u8", n, at + 8), np.frombuffer(data, "<u4", n, at + 8 + 8 * n)))
            at += 8 + 12 * n
        self.entries = np.frombuffer(data, [("print", "<u4"), ("shard", "<u4"), ("n", "<u8"), ("first", "<u8")], self.n, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and which of them are present by their fingerprints."""
        slot = np.full(len(keys), -1, dtype=np.int64)
        for level, (size, words, ranks) in enumerate(self.levels):
            open_ = np.flatnonzero(slot < 0)
            if not len(open_):
                break
            at = _hash(keys[open_], level) % U64(size)
            word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            hit = (words[word] >> bit) & U64(1) == 1
            below = np.bitwise_count(words[word] & ((U64(1) << bit) - U64(1)))
            slot[open_[hit]] = (ranks[word] + below)[hit]
        found = self.entries[np.maximum(slot, 0)] if self.n else np.zeros(len(keys), self.entries.dtype)
        return found, (slot >= 0) & (found["print"] == _fingerprint(keys)) if self.n else np.zeros(len(keys), bool)


def _by_value(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column, in partitions sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
        table = pa.Table.from_batches([batch])
        for i, j in zip(cuts, cuts[1:]):
            if held and values[i] != last:
                yield pa.concat_tables(held)
                held = []
            last = values[i]
            held.append(table.slice(i, j - i))
    if held:
        yield pa.concat_tables(held)


def _write_indexes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_value(batches, "bucket"):
            bucket = t["bucket"][0].as_py()
            data = pack_index(*(t[c].to_numpy() for c in ("doc_id", "shard", "first", "n_tokens")))
            with replacing(f"{folder}/index-{bucket:06d}.mph") as write:
                write(data)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([t.num_rows], pa.int64())], names=["bucket", "n"])

    return run


def _bucket(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = (_hash(batch.column("doc_id").to_numpy(), 101) % U64(n_buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _shard_starts(places: DataFrame) -> DataFrame:
    """(shard, base): the ids in all shards before each, summed within groups of _GROUP shards and then over the groups."""
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / F.lit(_GROUP)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("n").alias("n"))
    # One row for each _GROUP shards stands in this one window.
    groups = groups.select("group", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("group")), F.lit(0)).alias("of_group"))
    inner = totals.select("shard", "group", F.coalesce(F.sum("n").over(before("group").orderBy("shard")), F.lit(0)).alias("inner"))
    return inner.join(groups, "group").select("shard", (F.col("of_group") + F.col("inner")).cast("long").alias("base"))


def write_token_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Write docs as raw little-endian unsigned ids, and return the places written.

    Ids take two bytes where the vocabulary allows it, else four; the manifest says which.
    Files: shard-N.bin hold the ids of documents in ascending id order, each closed by end_id, and
    the order runs on over the shards; index-B.mph hold for the keys of hash bucket B a minimal perfect
    hash from key to (fingerprint, shard, first id in the shard, number of ids); starts is a Parquet
    table of the ids before each shard; manifest.json holds totals and parameters, whose size doesn't
    grow.  Result: doc_id, shard, first, n_tokens, crc (of the ids in 32 bits) and start, the ids of all documents before it.

    Null texts have the end id only.  Rows with a null id come first in the shards and
    have no index entry.  Rows that repeat an id stand together, by text; their index entry
    covers them all.  No rows give an empty folder with a manifest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    width = id_bytes(tokenizer, end_id)
    n_shards = max(1, -(-(size[0] or 0) // shard_bytes))
    ordered = docs.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text")
    places = keep(ordered.mapInArrow(_write_shards(folder, tokenizer, end_id, width), _ENTRY), "places")
    _shard_starts(places).write.mode("overwrite").parquet(f"{folder}/starts")
    base = spark.read.schema("shard int, base long").parquet(f"{folder}/starts")
    keys = places.where("doc_id is not null").groupBy("doc_id").agg(F.min("shard").alias("shard"), F.min("first").alias("first"), F.sum("n_tokens").alias("n_tokens"))
    n_buckets = max(1, -(-size[1] // bucket_keys))
    bucketed = keys.mapInArrow(_bucket(n_buckets), "bucket int, doc_id long, shard int, first long, n_tokens long").repartition("bucket").sortWithinPartitions("bucket")
    keep(bucketed.mapInArrow(_write_indexes(folder), "bucket int, n long"), "buckets")
    total = places.agg(F.sum("n_tokens")).first()[0] or 0
    manifest = {"tokenizer": os.path.basename(tokenizer), "end_id": end_id, "id_bytes": width, "n_buckets": n_buckets, "n_shards": n_shards, "tokens": total, "documents": size[1]}
    with replacing(f"{folder}/manifest.json") as write:
        write(json.dumps(manifest).encode())
    return places.join(base, "shard").select("doc_id", "shard", "first", "n_tokens", "crc", (F.col("base") + F.col("first")).alias("start"))


def _look_up(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_value(batches, "bucket"):
            index = IndexFile(read_all(f"{folder}/index-{t['bucket'][0].as_py():06d}.mph"))
            keys = t["doc_id"].to_numpy()
            entry, there = index.find(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(entry["shard"][there].astype(np.int32)), pa.array(entry["first"][there].astype(np.int64)), pa.array(entry["n"][there].astype(np.int64))], names=["doc_id", "shard", "first", "n_tokens"])

    return run


def _read_payload(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f = None, None
        for batch in batches:
            crcs, ids_out = [], []
            for s, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "n_tokens"))):
                if s != shard:
                    if f is not None:
                        f.close()
                    shard, f = s, read_at(f"{folder}/shard-{s:06d}.bin")
                f.seek(width * first)
                ids = f.read(width * n)
                if len(ids) != width * n:
                    raise OSError(f"shard {s} ends early")
                ids = _wide(ids, width)
                crcs.append(zlib.crc32(ids))
                ids_out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(ids_out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        if f is not None:
            f.close()

    return run


def read_places(places: DataFrame, folder: str) -> DataFrame:
    """For each row of places (doc_id, shard, first, n_tokens): doc_id, start, n_tokens, ids_crc32, ids (as unsigned 32-bit integers), read from the shards."""
    manifest = json.loads(read_all(f"{folder}/manifest.json"))
    base = places.sparkSession.read.schema("shard int, base long").parquet(f"{folder}/starts")
    found = places.select("doc_id", "shard", "first", F.col("n_tokens").cast("long").alias("n_tokens")).join(base, "shard").withColumn("start", F.col("base") + F.col("first"))
    found = found.repartition("shard").sortWithinPartitions("shard", "first").select("doc_id", "shard", "first", "n_tokens", "start")
    return found.mapInArrow(_read_payload(folder, manifest["id_bytes"]), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_token_ids(keys: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """For each distinct key of keys that the files hold: doc_id, start, n_tokens, ids_crc32, ids (as unsigned 32-bit integers).

    Each key's bucket file gives shard and offset in constant time; the payload is read there.
    Keys that are null or unknown give no row (an unknown key passes its fingerprint once in 2**32).
    """
    manifest = json.loads(read_all(f"{folder}/manifest.json"))
    asked = keys.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    asked = asked.mapInArrow(_bucket(manifest["n_buckets"]), "bucket int, doc_id long").repartition("bucket").sortWithinPartitions("bucket")
    return read_places(asked.mapInArrow(_look_up(folder), "doc_id long, shard int, first long, n_tokens long"), folder)


def token_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs as token ids in a new shared folder, read them back: doc_id, start, n_tokens, ids_crc32 for each row of docs.

    Ids are looked up in the index by key; rows that no key tells apart, of a null id or one that
    several rows have, are read at their places.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    places = write_token_ids(docs, folder, tokenizer or tokenizer_path(), end_id)
    tally = places.groupBy("doc_id").agg(F.count("*").alias("rows"))
    unclear = tally.where("doc_id is null or rows > 1").select("doc_id")
    found = read_token_ids(tally.where("rows = 1"), folder)
    if unclear.limit(1).count():
        found = found.unionByName(read_places(places.alias("p").join(unclear.alias("u"), F.col("p.doc_id").eqNullSafe(F.col("u.doc_id")), "left_semi"), folder))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
