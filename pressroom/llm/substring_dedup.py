"""Removal of word passages that an earlier document already has, by seed and extend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import SPACED, U64, Block, blocks, combine, mix

#: Words in an anchor.  A window of 13 words holds 9 such grams and selects the least.
ANCHOR = 5
#: An anchor of more rows than HOT is met by each of its windows apart; it is noticed where a block of _BLOCK bytes has it _NOTICED times.
HOT, _NOTICED, _BLOCK = 1 << 22, 4, 1 << 23
_SEED = "anchor long, windows binary, doc_id long, at long"
_SPAN = "doc_id long, tag int, first int, last int"
#: Bytes of a window's own hash that travel with its anchor's 64 bits.
_BYTES = 5


def _pack(word: np.ndarray, before: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Word position of an anchor, most words that its windows have before it, and a tag of the text, in one number."""
    return (word.astype(U64) << U64(32)) | (before.astype(U64) << U64(24)) | tag.astype(U64)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = at.view(U64)
    return (at >> U64(32)).astype(np.int64), ((at >> U64(24)) & U64(0xFF)).astype(np.int64), (at & U64(0xFFFFFF)).astype(np.int64)


def _anchors(block: Block, window: int) -> tuple[np.ndarray, ...]:
    """Winnowed anchors of a block: document, word, gram hash, most words before, windows; and all windows' hashes in the same order."""
    h = block.hashes()
    first, bounds = block.windows(window)
    if not len(first):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U64),) + (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U64),)
    gram = np.full(len(h), ~U64(0), dtype=U64)
    inner = np.arange(len(h) - ANCHOR + 1)
    gram[: len(inner)] = combine(h, inner, ANCHOR, seed=6)
    least = gram[first]
    place = np.zeros(len(first), dtype=np.int64)
    for j in range(1, window - ANCHOR + 1):
        less = gram[first + j] < least
        least[less] = gram[first + j][less]
        place[less] = j
    word = first + place
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Successive windows of a document with one anchor are one run.
    start = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))))
    size = np.diff(np.concatenate((start, [len(first)])))
    word, doc = word[start], doc[start]
    return doc, word - block.bounds[doc], gram[word], word - first[start], size, combine(h, first, window, seed=13)


def _runs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, each member's run and place in it."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _binary(rows: np.ndarray, size: np.ndarray, of: np.ndarray, start: np.ndarray, known: np.ndarray) -> pa.Array:
    """The low bytes of each run's window hashes, in the order of rows; zeros where the run is known."""
    size = size[rows]
    row, place = _runs(size)
    values = np.where(known[row], U64(0), of[start[rows][row] + place]).view(np.uint8).reshape(-1, 8)[:, :_BYTES]
    offsets = np.concatenate(([0], np.cumsum(size * _BYTES))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _frequent(window: int):
    """(anchor, rows) of anchors that a block has _NOTICED times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0), SPACED, target=_BLOCK):
                anchor, n = np.unique(_anchors(block, window)[2], return_counts=True)
                often = n >= _NOTICED
                yield pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(n[often])], names=["anchor", "n"])

    return run


def _apart(hot: np.ndarray, word: np.ndarray, doc: np.ndarray, gram: np.ndarray, before: np.ndarray, size: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs (document, word, anchor, words before, windows) with those of hot anchors as runs of one window, whose anchor holds the window's hash too."""
    of = np.isin(gram, hot)
    if not of.any():
        return doc, word, gram, before, size
    row, place = _runs(np.where(of, size, 1))
    of, size = of[row], np.where(of[row], 1, size[row])
    gram, before = gram[row], before[row] - np.where(of, place, 0)
    first = (np.cumsum(size) - size)[of]
    gram[of] = mix(gram[of] ^ mix(windows[first] + before[of].astype(U64)))
    return doc[row], word[row], gram, before, size


def _seeds(window: int, shared):
    """Rows of seeds.  Of equal runs in a block the smallest document asks for all; later ones are known repeats, with a null anchor and no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch.column("text"), SPACED, target=_BLOCK):
                ids = batch.column("doc_id").slice(i, j - i).to_numpy()
                tags = batch.column("tag").slice(i, j - i).to_numpy()
                doc, word, gram, before, size, windows = _anchors(block, window)
                if not len(doc):
                    continue
                doc, word, gram, before, size = _apart(shared.value, word, doc, gram, before, size, windows)
                start = np.cumsum(size) - size
                whole = np.add.reduceat(mix(windows + (np.arange(len(windows)) - np.repeat(start, size)).astype(U64)), start) + before.astype(U64)
                order = np.lexsort((ids[doc], whole, gram))
                g, w, d, s = gram[order], whole[order], ids[doc][order], size[order]
                head = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])))
                known = d > d[np.flatnonzero(head)][np.cumsum(head) - 1]
                at = _pack(word[order], before[order], tags[doc][order])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64), mask=known), _binary(order, size, windows, start, known), pa.array(d), pa.array(at.view(np.int64))], names=["anchor", "windows", "doc_id", "at"])

    return run


def _merged(ids: np.ndarray, at: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans of the windows at these places of their runs; overlapping ones of a document that stand together are joined."""
    word, before, t = _unpack(at)
    f = word - before + place
    order = np.lexsort((f, t, ids))
    d, t, f = ids[order], t[order], f[order]
    start = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (f[1:] > f[:-1] + window))))
    end = np.concatenate((start[1:], [len(d)])) - 1
    return pa.RecordBatch.from_arrays([pa.array(d[start]), pa.array(t[start].astype(np.int32)), pa.array(f[start].astype(np.int32)), pa.array((f[end] + window).astype(np.int32))], names=["doc_id", "tag", "first", "last"])


def _extend(window: int):
    """From seeds sorted by anchor and doc_id: spans of words that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the anchor that the last batch ended with: each window's place before it and hash, and its smallest document.
        open_anchor, open_before, open_key, open_doc = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("windows")
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + batch.num_rows + 1]
            size = np.diff(offsets) // _BYTES
            at, ids = batch.column("at").to_numpy(), batch.column("doc_id").to_numpy()
            known = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                row, place = _runs(size[known])
                yield _merged(ids[known][row], at[known][row], place, window)
            if known.all():
                continue
            asked = np.flatnonzero(~known)
            anchor = batch.column("anchor").fill_null(0).to_numpy().view(U64)[asked]
            last = anchor[-1]
            group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
            use = (np.bincount(group)[group] > 1) | (anchor == last)
            if open_anchor is not None:
                use |= anchor == open_anchor
            asked, anchor = asked[use], anchor[use]
            row, place = _runs(size[asked])
            data = np.frombuffer(data, dtype=np.uint8)
            eight = np.zeros((len(row), 8), dtype=np.uint8)
            eight[:, :_BYTES] = data[(offsets[asked].astype(np.int64)[row] + place * _BYTES)[:, None] + np.arange(_BYTES)]
            key = eight.reshape(-1).view(U64)
            before = _unpack(at[asked])[1][row] - place
            a, d = anchor[row], ids[asked][row]
            extra = 0
            if open_anchor is not None and open_anchor == anchor[0]:
                extra = len(open_key)
                a = np.concatenate((np.full(extra, open_anchor, dtype=U64), a))
                d, key, before = np.concatenate((open_doc, d)), np.concatenate((open_key, key)), np.concatenate((open_before, before))
            order = np.lexsort((d, key, before, a))
            a, b, k, d = a[order], before[order], key[order], d[order]
            head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1])))
            heads = np.flatnonzero(head)
            repeated = np.zeros(len(d), dtype=bool)
            repeated[order] = d > d[heads][np.cumsum(head) - 1]
            hit = np.flatnonzero(repeated[extra:])
            if len(hit):
                yield _merged(ids[asked][row[hit]], at[asked][row[hit]], place[hit], window)
            tail = heads[a[heads] == last]
            open_anchor, open_before, open_key, open_doc = last, b[tail], k[tail], d[tail]

    return run


def repeated_spans(docs: DataFrame, window: int = 13, hot: int = HOT) -> DataFrame:
    """Maximal repeats: (doc_id, tag, first, last) for words [first, last) of docs (doc_id, tag, text).

    Each window of words selects the least hash of its grams, so equal windows select
    the same anchor; documents are joined on anchors, and each seed is
    extended to both sides by comparing the hashes of the windows that selected it
    (64 bits of the anchor and 40 of each window).  A window is a repeat where a
    smaller doc_id has it; adjacent ones are merged into maximal spans.

    Anchors of more than hot rows, at most one for each hot rows of all, are counted in a pass before and broadcast;
    their windows meet one by one, so that a phrase in many contexts is spread over tasks.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "tag", "text")
    often = docs.select("text").mapInArrow(_frequent(window), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    shared = docs.sparkSession.sparkContext.broadcast(often.select("anchor").toArrow()["anchor"].to_numpy().view(U64))
    seeds = docs.mapInArrow(_seeds(window, shared), _SEED)
    # Rows that are settled already have no anchor to meet at: they stay spread.
    spread = F.coalesce("anchor", F.xxhash64("doc_id", "at"))
    met = seeds.repartition(spread).sortWithinPartitions("anchor", "doc_id")
    return met.mapInArrow(_extend(window), _SPAN)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, for the shuffle to their spans."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = [t.as_buffer() if t.is_valid else None for t in batch.column("text")]
        packed = [None if t is None else codec.compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array([0 if t is None else t.size for t in texts], pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "tag", "size", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        counts, removed, kept, spans_out = [], [], [], []
        for size, packed, spans in zip(batch.column("size").to_pylist(), batch.column("packed"), batch.column("spans").to_pylist()):
            words = codec.decompress(packed.as_buffer(), size, asbytes=True).split() if packed.is_valid else []
            n, out = len(words), []
            if spans:
                place, merged = 0, []
                for first, last in sorted((s["first"], s["last"]) for s in spans):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(last, merged[-1][1])
                    else:
                        merged.append([first, last])
                for first, last in merged:
                    out += words[place:first]
                    place = last
                words, out = out + words[place:], merged
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
            spans_out.append([{"first": a, "last": b} for a, b in out])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans_out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
        )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, spans.

    Words `[^\\x20\\x09-\\x0D]+` stay as they are written.  A word is removed if a window of
    `window` words over it also starts in a document with a smaller doc_id; kept_text joins
    the rest by one space, spans lists the removed word ranges [first, last).
    window is from ANCHOR + 1 to ANCHOR + 8.

    Null texts have no words; texts shorter than the window lose nothing.  Rows with a
    null id keep all words and remove none elsewhere.  Rows that repeat an id never remove
    words of each other.  Empty tables give empty tables.
    """
    if not ANCHOR < window <= ANCHOR + 8:
        raise ValueError(f"window must be from {ANCHOR + 1} to {ANCHOR + 8}")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tag = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    docs = docs.withColumn("tag", tag)
    spans = repeated_spans(docs, window, hot).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    texts = docs.select("doc_id", "tag", "text").mapInArrow(_pack_texts, "doc_id long, tag int, size int, packed binary")
    joined = texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "size", "packed", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<first:int,last:int>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
