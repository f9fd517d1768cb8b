"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import ALNUM, U64, Block, blocks, mix

#: Bytes of item text that one broadcast index covers; packed, it takes some 3.5 times as many. More items are joined in further blocks.
INDEX_BYTES = 16 << 20
#: Words are counted by the first bits of their hashes.
COUNT_BITS = 20
_STEP = U64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - COUNT_BITS)).astype(np.int64)


@dataclass
class Index:
    """Items as packed words, and their windows by the rarest word of each (the prefix that an exact match must hold).

    Equal windows of an item are one, so that a repeated word is as many entries as it has different windows.  Successive windows with the same
    rarest word are one entry: that word, the first and the last window's words before it, and the windows' length.
    """

    text: bytes  # all words, one space after each
    place: np.ndarray  # where each word begins in text, and the end
    words: np.ndarray  # hash of each word
    ids: np.ndarray  # of items
    bounds: np.ndarray  # words of item i are bounds[i] to bounds[i + 1]
    tokens: np.ndarray  # sorted hashes of prefix words
    of_token: np.ndarray  # entries of token i are of_token[i] to of_token[i + 1]
    at: np.ndarray  # the prefix word of each entry
    most: np.ndarray
    least: np.ndarray
    length: np.ndarray


def build_index(ids: np.ndarray, texts: pa.Array, counts: np.ndarray, window: int) -> Index:
    """counts: how often the words of each bucket stand in the corpus; the rarest word of a window is its prefix."""
    found, sizes, text = [], [], []
    for _, _, block in blocks(texts, ALNUM, lower=True):
        found.append(block.hashes())
        sizes.append(block.counts)
        text += [block.word_bytes(i) for i in range(len(block.starts))]
    h = np.concatenate(found) if found else np.zeros(0, dtype=U64)
    n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(n)))
    place = np.concatenate(([0], np.cumsum([len(w) + 1 for w in text]))).astype(np.int64)
    # Windows of all items: the first word of each, and its length.
    many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), many)
    first = bounds[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(window, n)[item]
    unique, back = np.unique(h, return_inverse=True)
    rank = np.empty(len(unique), dtype=np.int64)
    rank[np.lexsort((unique, counts[_bucket(unique)]))] = np.arange(len(unique))
    rarity = rank[back]
    at = first.copy()
    for j in range(1, window):
        inside = np.flatnonzero(j < length)
        rarer = inside[rarity[first[inside] + j] < rarity[at[inside]]]
        at[rarer] = first[rarer] + j
    # Windows of the same words, by their hashes, are one window of an item: their first stands for all.
    alike = np.zeros(len(first), dtype=U64)
    for j in range(window):
        inside = j < length
        alike[inside] = mix(alike[inside] * _STEP + h[first[inside] + j])
    order = np.lexsort((alike, item))
    once = np.sort(order[np.concatenate(([True], (alike[order[1:]] != alike[order[:-1]]) | (item[order[1:]] != item[order[:-1]])))]) if len(order) else order
    item, first, length, at = item[once], first[once], length[once], at[once]
    start = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (item[1:] != item[:-1])))) if len(at) else np.zeros(0, dtype=np.int64)
    end = np.append(start[1:], len(at)) - 1
    order = np.argsort(h[at[start]], kind="stable")
    start, end = start[order], end[order]
    tokens, of_token = np.unique(h[at[start]], return_index=True)
    return Index(b"".join(w + b" " for w in text), place, h, ids, bounds, tokens, np.append(of_token, len(start)), at[start].astype(np.int32), (at[start] - first[start]).astype(np.int16), (at[end] - first[end]).astype(np.int16), length[start].astype(np.int16))


def _find(block: Block, h: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """All occurrences of windows, successive ones as one: (document, first word, word after the last, item)."""
    if not len(index.tokens) or not len(h):
        return []
    near = np.minimum(np.searchsorted(index.tokens, h), len(index.tokens) - 1)
    word = np.flatnonzero(index.tokens[near] == h)
    low, high = index.of_token[near[word]], index.of_token[near[word] + 1]
    n = high - low
    row = np.repeat(np.arange(len(word)), n)
    entry = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    word = word[row]
    doc = np.searchsorted(block.bounds, word, side="right") - 1
    at, most, least, length = (x[entry].astype(np.int64) for x in (index.at, index.most, index.least, index.length))
    # How many words before and after the prefix word are the same, within the entry's windows and the document.
    before, after = np.zeros(len(word), dtype=np.int64), np.zeros(len(word), dtype=np.int64)
    for count, reach, room, sign in ((before, most, word - block.bounds[doc], -1), (after, length - 1 - least, block.bounds[doc + 1] - 1 - word, 1)):
        left, j = np.flatnonzero(np.minimum(reach, room) > 0), 1
        while len(left):
            left = left[h[word[left] + sign * j] == index.words[at[left] + sign * j]]
            count[left] = j
            j += 1
            left = left[np.minimum(reach, room)[left] >= j]
    # Windows that begin from `most` to `least` words before the prefix word.
    begin, last = np.minimum(most, before), np.maximum(least, length - 1 - after)
    out = []
    for i in np.flatnonzero(begin >= last).tolist():
        b, e, size, p, q = int(begin[i]), int(last[i]), int(length[i]), int(at[i]), int(word[i])
        item = int(index.ids[np.searchsorted(index.bounds, p, side="right") - 1])
        same = lambda b, e: b"".join(block.word_bytes(x) + b" " for x in range(q - b, q - e + size)) == index.text[index.place[p - b] : index.place[p - e + size]]  # noqa: B023, E731
        spans = [(b, e)] if same(b, e) else [(x, x) for x in range(e, b + 1) if same(x, x)]
        out += [(int(doc[i]), q - x, q - y + size, item) for x, y in spans]
    return out


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the words of a partition."""
    for batch in batches:
        for _, _, block in blocks(batch.column(0), ALNUM, lower=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(block.hashes())))], names=["bucket"])


def _count(shared):
    """(bucket, words in it) of a partition, for the buckets that items use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = shared.value
        total = np.zeros(len(used), dtype=np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0), ALNUM, lower=True):
                b = _bucket(block.hashes())
                found, n = np.unique(b[used[b]], return_counts=True)
                total[found] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return run


def _pack(shared, window: int):
    """The index of all items of a partition, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            texts = table["text"].cast(pa.large_string()).combine_chunks()
            index = build_index(table["item"].to_numpy(), texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, shared.value, window)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(index)], pa.large_binary()).cast(pa.binary())], names=["packed"])

    return run


def _match(shared):
    """Add the hits of one index to spans and items of each row."""
    pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            column = batch.column("text")
            counts: list[int] = []
            spans: list = batch.column("spans").to_pylist()
            items: list = batch.column("items").to_pylist()
            for i, _, block in blocks(column, ALNUM, lower=True):
                counts += block.counts.tolist()
                hits: dict[int, list[tuple[int, int, int]]] = {}
                for doc, first, last, item in _find(block, block.hashes(), index):
                    base = int(block.bounds[doc])
                    hits.setdefault(i + doc, []).append((first - base, last - base, item))
                for r, new in hits.items():
                    merged: list[list[int]] = []
                    for x, y in sorted([(x, y) for x, y, _ in new] + [(s["first"], s["last"]) for s in spans[r]]):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(y, merged[-1][1])
                        else:
                            merged.append([x, y])
                    spans[r] = [{"first": x, "last": y} for x, y in merged]
                    items[r] = sorted({*items[r], *(item for _, _, item in new)})
            out = {name: batch.column(name) for name in batch.schema.names} | {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pair)), "items": pa.array(items, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per row of docs: row (its columns as a struct), doc_id, n_words, spans, items, n_hit, n_items, contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.  An item's
    windows are its runs of `window` words, or all its words if they are fewer.  Words
    are ordered by their count in the whole corpus (that of the 2 ** COUNT_BITS buckets their hashes fall in, counted
    in one pass); for whole containment one prefix word, the rarest of a window, is enough.  Documents are joined
    on it, the window's place and length must fit the document, and the words are then compared in full.
    spans lists the hit ranges [first, last) of words, items the items of hitting windows.

    The index is packed in a task and broadcast in blocks of about index_bytes of item text (a
    single item may be longer); documents pass each block in turn without a shuffle.
    Null texts have no words; items without id or words are not looked for; items that repeat
    an id are one item.  Without documents the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // index_bytes))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"), F.array().cast("array<long>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema])
    share = spark.sparkContext.broadcast
    used = np.zeros(1 << COUNT_BITS, dtype=bool)
    used[items.select("text").mapInArrow(_used, "bucket long").distinct().toArrow()["bucket"].to_numpy()] = True
    counts = np.zeros(len(used), dtype=np.int64)
    if used.any():
        tally = base.select("text").mapInArrow(_count(share(used)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[tally["bucket"].to_numpy()] = tally["n"].to_numpy()
    shared, found = share(counts), base
    for b in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).repartition(1).sortWithinPartitions("item", "text")
        packed = rows.mapInArrow(_pack(shared, window), "packed binary").first()
        index = pickle.loads(packed[0]) if packed else build_index(np.zeros(0, dtype=np.int64), pa.array([], pa.string()), counts, window)
        found = found.mapInArrow(_match(share(index)), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("row", "doc_id", "n_words", "spans", "items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of a benchmark item, columns as they are."""
    return contamination(docs, benchmark, **options).where("not contaminated").select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(items, 256).alias("items_sha256"), "contaminated")
