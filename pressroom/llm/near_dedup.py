"""Near-duplicate documents by MinHash and an LSH forest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import keep
from .textops import SPACED, U64, Block, blocks, combine, mix

#: The forest: trees, and MinHash values in each tree's label.
TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
#: A region of more sets, or of more shingles in all, is split by deeper labels.
REGION, REGION_SHINGLES = 2048, 1 << 21
#: Rows of one prefix are joined with its figures in so many groups.
SALT = 16

_FACTORS = (mix(np.arange(1, TREES * DEPTH + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.BinaryType())])


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles; the whole sequence where it is shorter."""
    h = block.hashes()
    first, bounds = block.windows(k)
    shingles = combine(h, first, k)
    for i, n in enumerate(block.counts):
        if n >= k:
            yield np.unique(shingles[bounds[i] : bounds[i + 1]])
        elif n:
            yield combine(h, block.bounds[i : i + 1], int(n))
        else:
            yield np.zeros(0, dtype=U64)


def _minima(x: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    x = (x >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _FACTORS).min(axis=0), out=low)
    return low


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in blocks(batch.column(1), SPACED, lower=True):
                n, h1, h2, sig = [], [], [], []
                for x in shingle_sets(block, k):
                    n.append(len(x))
                    h1.append(int(mix(x).sum(dtype=U64).view(np.int64)))
                    h2.append(int(mix(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)))
                    low = _minima(x) if len(x) else None
                    sig.append(None if low is None else low.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=_SKETCH.names)

    return run


_ORDER = "members array<long>, tree int, label binary, doc_id long, n_shingles long"


def _neighbours(region: int, shingles: int):
    """From rows (tree, label, doc_id, n_shingles) in the order of tree and label: runs of neighbours by longest common prefix.

    Sets whose longest common prefix with the next in order is LEAST_DEPTH values or more are one run.  A run within the
    bounds gives one row of members; the rows of a larger one, and of those at the partition's ends, which may go
    on in the next one, are given back as they are.  Sets alone in a run are left out.  What is held is one batch and one run within the bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, doc, n = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        label = np.zeros((0, DEPTH), dtype="<u4")
        # Whether the open run touches the partition's start, and whether all its rows so far were given back.
        edge, given = True, False

        def loose(mask: np.ndarray) -> pa.RecordBatch:
            data = pa.py_buffer(np.ascontiguousarray(label[mask]))
            labels = pa.Array.from_buffers(pa.binary(), int(mask.sum()), [None, pa.py_buffer(np.arange(0, 4 * DEPTH * (mask.sum() + 1), 4 * DEPTH, dtype=np.int32)), data])
            return pa.RecordBatch.from_arrays([pa.nulls(len(labels), pa.list_(pa.int64())), pa.array(tree[mask]), labels, pa.array(doc[mask]), pa.array(n[mask])], names=["members", "tree", "label", "doc_id", "n_shingles"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype="<u4").reshape(-1, DEPTH)
            tree, label = np.concatenate((tree, batch.column("tree").to_numpy())), np.concatenate((label, new))
            doc, n = np.concatenate((doc, batch.column("doc_id").to_numpy())), np.concatenate((n, batch.column("n_shingles").to_numpy()))
            common = np.where(tree[1:] == tree[:-1], np.cumprod(label[1:] == label[:-1], axis=1, dtype=np.int8).sum(axis=1), 0)
            start = np.concatenate(([0], np.flatnonzero(common < LEAST_DEPTH) + 1))
            size, weight = np.diff(np.append(start, len(doc))), np.add.reduceat(n, start)
            fits = (size <= region) & ((weight <= shingles) | (size == 2))
            last = len(start) - 1
            back = ~fits
            back[0] |= given or (edge and last > 0)
            whole = ~back & (size > 1)
            whole[last] = False
            row = np.repeat(np.arange(len(start)), size)
            out = back[row]
            out[0] &= not given
            if whole.any():
                offsets = np.concatenate(([0], np.cumsum(size[whole]))).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[whole[row]]))
                k = len(members)
                yield pa.RecordBatch.from_arrays([members, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["members", "tree", "label", "doc_id", "n_shingles"])
            if out.any():
                yield loose(out)
            # The last run stays open; of one that was given back, its last row alone, to be compared with the next.
            edge, given = edge and last == 0, bool(back[last])
            keep_from = len(doc) - 1 if given else int(start[last])
            tree, label, doc, n = tree[keep_from:], label[keep_from:], doc[keep_from:], n[keep_from:]
        if len(doc) and not given:
            yield loose(np.ones(len(doc), dtype=bool))

    return run


def _deepen(rows: DataFrame, region: int, shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """Regions (key, part, doc_id) of rows (tree, label, doc_id, n_shingles) that share a prefix, and those that were split.

    Where more than region sets, or sets of more than shingles in all, share a prefix, it grows, for that region alone.
    A region that is split is dealt into parts by set as well, and its smallest set joins each part, at LEAST_DEPTH and
    where it is still too large at full depth.  The second result has the regions that were
    split, as they are at LEAST_DEPTH, in such parts (key, part, doc_id, n_shingles): what meets deeper is within one of them.
    """
    fits = (F.col("size") <= region) & ((F.col("weight") <= shingles) | (F.col("size") == 2))
    parts = F.greatest(F.ceil(F.col("size") / F.lit(region)), F.ceil(F.col("weight") / F.lit(shingles)))
    part = F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")).alias("part")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt")
    found, split = [], None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        level = rows.select("*", F.xxhash64("tree", F.lit(depth), F.substring("label", 1, 4 * depth)).alias("key"), salt)
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("doc_id").alias("hub")).where("size > 1")
        sizes = keep(sizes.withColumn("parts", parts), "regions")
        # A prefix that many sets share is no hot key of this join.
        level = level.join(sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")), ["key", "salt"])
        found.append(level.where(fits).select("key", F.lit(0).cast("long").alias("part"), "doc_id"))
        if not sizes.where(~fits).limit(1).count():
            break
        large = keep(level.where(~fits), "large")
        if depth in (LEAST_DEPTH, DEPTH):
            found.append(large.select("key", part, "doc_id"))
            found.append(sizes.where(~fits).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("doc_id")))
        if depth == LEAST_DEPTH:
            split = large.select("key", part, "doc_id", "n_shingles")
        rows = large.select("tree", "label", "doc_id", "n_shingles")
    return reduce(DataFrame.unionByName, found), split


def _distinct_regions(members: DataFrame) -> DataFrame:
    """(region, doc_id) of lists of members: the same ones often meet in many trees, and one region of each kind stays."""
    one = members.groupBy(F.xxhash64("members").alias("region"), F.size("members").alias("size")).agg(F.first("members").alias("members"))
    return one.select("region", F.explode("members").alias("doc_id"))


def _regions(sets: DataFrame, region: int, shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """Members (region, doc_id) of the regions of two sets or more, and those regions that were split (see _deepen).

    Each tree has the sets in the sorted order of their labels, dealt over partitions by range, so that no prefix is too
    common for one.  Neighbours with a common prefix of LEAST_DEPTH values or more are candidates.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = sets.select("doc_id", "n_shingles", "sig", trees).select("tree", F.substring(F.col("sig"), F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("label"), "doc_id", "n_shingles")
    ordered = rows.repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    orders = keep(ordered.mapInArrow(_neighbours(region, shingles), _ORDER), "orders")
    crowded, split = _deepen(orders.where("doc_id is not null").drop("members"), region, shingles)
    met = crowded.groupBy("key", "part").agg(F.sort_array(F.collect_set("doc_id")).alias("members")).where("size(members) > 1").select("members")
    return _distinct_regions(orders.where("members is not null").select(F.sort_array("members").alias("members")).unionByName(met)), split


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of similar sets that join all sets which any links between these sets join; every link is exact."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    label, found = np.arange(n), []
    for i in range(n - 1):
        other = label[i + 1 :] != label[i]
        if not other.any():
            continue
        own = flat[start[i] : start[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[start[i + 1] :]], start[i + 1 : n] - start[i + 1])
        mark[own] = 0
        for j in i + 1 + np.flatnonzero(other & (100 * common >= percent * (size[i] + size[i + 1 :] - common))):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def _links(k: int, percent: int):
    """For rows of (region, doc_id, text) sorted by region: exact links between its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            # A repeated id may bring several sets; all of them are the one node.
            return [(ids[i], ids[j]) for i, j in spanning_links(sets, percent) if ids[i] != ids[j]] if len(sets) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            region, doc = batch.column("region").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j, block in blocks(batch.column("text"), SPACED, lower=True):
                for r, x in zip(range(i, j), shingle_sets(block, k)):
                    if region[r] != last:
                        out += close()
                        last, ids, sets = region[r], [], []
                    if len(x):
                        ids.append(doc[r])
                        sets.append(x)
            yield _pairs(out)
        yield _pairs(close())

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


def _rest(split: DataFrame, labels: DataFrame, region: int, shingles: int) -> DataFrame:
    """(region, doc_id): what is left open in the regions that were split.

    Members that aren't in the component of most members are a region's query set; in blocks of at most
    about region sets or shingles they meet every part, whose members are all other rows.
    """
    rows = split.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    tally = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = tally.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    asking = keep(rows.join(main, "key").where("component <> main").select("key", "doc_id", "n_shingles"), "asking")
    sizes = asking.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(region)), F.ceil(F.sum("n_shingles") / F.lit(shingles))).alias("blocks"))
    asking = asking.join(sizes, "key").select("key", "doc_id", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).alias("block"))
    parts = split.select("key", "part").distinct()
    met = asking.join(parts, "key").select("key", "part", "block", "doc_id")
    held = split.select("key", "part", "doc_id").join(sizes, "key").select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "doc_id")
    every = met.unionByName(held).groupBy("key", "part", "block").agg(F.sort_array(F.collect_set("doc_id")).alias("members"))
    return _distinct_regions(every)


def _meet(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within each region of members (region, doc_id)."""
    met = members.join(texts, "doc_id").repartition("region").sortWithinPartitions("region")
    return met.mapInArrow(_links(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, region: int = REGION, shingles: int = REGION_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, set_id.

    Words are lower-cased in A-Z; documents whose sets of k-word shingles have
    Jaccard similarity of at least percent / 100 are linked, and a component is
    named after its smallest doc_id.  Documents of equal sets are one node of the
    graph (set_id), so copies in any number cost one row each.  Each other set takes its
    neighbours from TREES sorted orders of MinHash labels, by their longest common prefix (see _regions), and every
    link is confirmed on the whole sets.  Two sets of similarity s meet in a region
    with probability 1 - (1 - s**LEAST_DEPTH)**TREES: 0.99998 at 0.75.

    The texts of a region meet in one task, bounded by REGION and REGION_SHINGLES, which
    compares all whose components differ so far; it returns the links of a spanning forest only.
    Regions beyond the bounds are split by deeper labels, and compared in parts, each with the
    region's smallest set.  These links only join most members early: then those that are outside a split region's main
    component are compared with all of its members, in blocks, so that no split loses a link.

    Nulls and empties: a null or wordless text has an empty set and is linked with
    nothing; a null id is returned with null component_id and kept true.  Rows that
    repeat an id count as one document of all its texts.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = keep(docs.mapInArrow(_sketches(k), _SKETCH), "sketches")
    full = sketches.where("doc_id is not null and n_shingles > 0")
    sets = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
    sets = keep(sets.select("h1", "h2", "x.*"), "sets")
    members, split = _regions(sets, region, shingles)
    texts = docs.where("doc_id is not null")
    links = _meet(members, texts, k, percent)
    ids = full.groupBy("doc_id").agg(F.count("*").alias("rows"))
    # Rows that repeat an id may stand for several sets.
    same_id = full.join(ids.where("rows > 1").select("doc_id"), "doc_id", "left_semi").join(sets.select("h1", "h2", F.col("doc_id").alias("rep")), ["h1", "h2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = links.unionByName(same_id)
    if split is None:
        labels = components(links)
    else:
        links = keep(links, "links")
        labels = components(links)
        labels = components(links.unionByName(_meet(_rest(split, labels, region, shingles), texts, k, percent)))
    of_set = sets.select("h1", "h2", F.col("doc_id").alias("set_id")).join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component_id", F.coalesce("component", "set_id")).drop("component")
    rows = sketches.select("doc_id", "n_shingles", "h1", "h2")
    linked = rows.where("doc_id is not null and n_shingles > 0").join(of_set, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "set_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "set_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each group, columns as they are.

    A document that stands in several rows with one id stays in all of them.
    """
    kept = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(options.get("id_col", "doc_id"))).distinct()
    return docs.join(kept, options.get("id_col", "doc_id"), "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_id")
