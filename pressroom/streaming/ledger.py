"""A ledger of keys that batches look up in part: hash buckets with a Bloom filter each, in generations that are merged as they grow in number."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 24, 8
U64 = np.uint64


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: HASHES steps from one half of its hash, as wide as the other."""
    h = hashes.view(U64)
    step = (h >> U64(32)) * U64(0x9E3779B1) | U64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=U64) * step[:, None]) >> U64(7)) % U64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    out = np.zeros(bits, dtype=bool)
    out[_places(hashes, bits).ravel()] = True
    return np.packbits(out, bitorder="little").tobytes()


def might_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filter_, dtype=np.uint8)
    at = _places(hashes, len(data) * 8)
    return (data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).all(axis=1)


class KeyLedger:
    """The keys that batches have taken in, in a folder.

    Each batch adds a generation: `keys/gen=G/bucket=B` with its keys as texts, and `filters/gen=G` with a Bloom filter of each bucket.  A batch meets the filters of its own
    buckets, bucket by bucket, and reads the keys of those buckets and generations only that may hold one of its own: one in some
    25,000 that they don't hold, however long the history.  When `fan` generations of one level are there, they become one of the next, so their number
    grows with the logarithm of the batches.

    A batch that is run again finds the ledger as it was before: it looks at generations of earlier batches only, merges none of its own, and overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, fan: int = 8) -> None:
        self.spark, self.folder, self.buckets, self.fan = spark, folder.rstrip("/"), buckets, fan
        #: Rows of keys that the last lookup read.
        self.rows_read = 0

    # ---- what there is: a small file that is replaced as a whole ----

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self, before: int | None = None) -> list[dict]:
        """Generations by age, each with its name, level and the last batch in it."""
        path, files = self._path("generations.json")
        if not files.exists(path):
            return []
        text = self.spark.read.text(f"{self.folder}/generations.json", wholetext=True).first()
        found = json.loads(text[0]) if text else []
        return [g for g in found if before is None or g["batch"] < before]

    def _replace(self, generations: list[dict]) -> None:
        path, files = self._path("generations.json")
        new, _ = self._path("generations.json.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps(generations).encode()))
        out.close()
        # Between the two steps there is no list; then the new one is under its other name.
        files.delete(path, False)
        files.rename(new, path)

    def _recover(self) -> None:
        path, files = self._path("generations.json")
        new, _ = self._path("generations.json.new")
        if not files.exists(path) and files.exists(new):
            files.rename(new, path)

    # ---- keys ----

    def _hashed(self, rows: DataFrame, key: str) -> DataFrame:
        h = F.xxhash64(F.col(key).cast("string"))
        return rows.select(F.col(key).cast("string").alias("key"), h.alias("hash"), F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket")).where("key is not null").distinct()

    def _write(self, keys: DataFrame, name: str) -> None:
        keys.select("key", "hash", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/keys/gen={name}")
        written = self.spark.read.schema("key string, hash long, bucket int").parquet(f"{self.folder}/keys/gen={name}")
        filters = written.select("bucket", "hash").groupBy("bucket").applyInArrow(lambda t: pa.table({"bucket": t["bucket"].slice(0, 1), "n": pa.array([len(t)], pa.int64()), "bits": pa.array([bloom(t["hash"].to_numpy())], pa.binary())}), "bucket int, n long, bits binary")
        filters.write.mode("overwrite").parquet(f"{self.folder}/filters/gen={name}")

    def add(self, rows: DataFrame, key: str, batch: int) -> None:
        """Take the keys of rows into the ledger as those of a batch; null keys aren't kept."""
        self._recover()
        self._write(self._hashed(rows, key), f"b{batch}")
        self._replace([*[g for g in self.generations() if g["batch"] != batch], {"name": f"b{batch}", "level": 0, "batch": batch}])

    def merge(self, before: int) -> None:
        """Make one generation of the next level out of each fan of one level, of batches before this one."""
        self._recover()
        live = self.generations()
        while True:
            levels: dict[int, list[dict]] = {}
            for g in live:
                if g["batch"] < before:
                    levels.setdefault(g["level"], []).append(g)
            full = next((level for level, some in sorted(levels.items()) if len(some) >= self.fan), None)
            if full is None:
                return
            old = levels[full][: self.fan]
            last = max(g["batch"] for g in old)
            name = f"m{full + 1}-{last}"
            schema = "key string, hash long, bucket int"
            keys = [self.spark.read.schema(schema).parquet(f"{self.folder}/keys/gen={g['name']}") for g in old]
            whole = keys[0]
            for k in keys[1:]:
                whole = whole.unionByName(k)
            self._write(whole.distinct(), name)
            live = [{"name": name, "level": full + 1, "batch": last}, *[g for g in live if g not in old]]
            self._replace(live)
            for g in old:
                for kind in ("keys", "filters"):
                    path, files = self._path(f"{kind}/gen={g['name']}")
                    files.delete(path, True)

    def _candidates(self, keys: DataFrame, generations: Iterable[dict]) -> DataFrame:
        """(gen, bucket, key): keys that a filter may hold."""
        filters = None
        for g in generations:
            rows = self.spark.read.schema("bucket int, n long, bits binary").parquet(f"{self.folder}/filters/gen={g['name']}").withColumn("gen", F.lit(g["name"]))
            filters = rows if filters is None else filters.unionByName(rows)

        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            hashes = mine["hash"].to_numpy()
            found = [(gen, i) for gen, bits in zip(theirs["gen"].to_pylist(), theirs["bits"].to_pylist()) if len(hashes) for i in np.flatnonzero(might_hold(bits, hashes)).tolist()]
            at = pa.array([i for _, i in found], pa.int64())
            return pa.table({"gen": pa.array([g for g, _ in found], pa.string()), "bucket": mine["bucket"].take(at), "key": mine["key"].take(at)})

        return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(meet, "gen string, bucket int, key string")

    def unseen(self, rows: DataFrame, key: str, before: int) -> DataFrame:
        """Rows whose key no batch before this one took in; rows with a null key are always unseen."""
        self._recover()
        live = self.generations(before)
        self.rows_read = 0
        if not live:
            return rows
        path = f"{self.folder}/candidates/batch={before}"
        self._candidates(self._hashed(rows, key), live).write.mode("overwrite").parquet(path)
        maybe = self.spark.read.schema("gen string, bucket int, key string").parquet(path)
        # At most a row for each bucket of each generation.
        where = [f"{self.folder}/keys/gen={r['gen']}/bucket={r['bucket']}" for r in maybe.select("gen", "bucket").distinct().collect()]
        if not where:
            return rows
        held = self.spark.read.schema("key string, hash long").parquet(*where)
        self.rows_read = held.count()
        seen = held.join(maybe.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("_seen")).distinct()
        return rows.join(seen, F.col(key).cast("string") == F.col("_seen"), "left_anti")


def taken_once(ledger: KeyLedger, batch: DataFrame, key: str, batch_id: int, path: str) -> DataFrame:
    """Write the rows of a batch that the ledger hasn't seen to path, take their keys into the ledger, and return them."""
    ledger.merge(batch_id)
    ledger.unseen(batch, key, batch_id).write.mode("overwrite").parquet(path)
    fresh = batch.sparkSession.read.schema(batch.schema).parquet(path)
    ledger.add(fresh, key, batch_id)
    return fresh
