"""Structured Streaming forms of ingest, coverage, the funnel and the job ledger."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, is_folder, shared_base
from .jobs import stream_jobs as stream_jobs
from .ledger import KeyLedger, taken_once

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB, which timers and several state variables need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for checkpoints and sinks of streams, where all machines share them."""
    return f"{shared_base(spark)}/streams-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files, its time as an event time."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if is_folder(spark, f"{d}/events.parquet") else f"{d}/events*.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, folder: str | None, mode: str, write_batch) -> DataFrame:
    """Run a stream over what there is; write_batch(batch, id, path, folder) writes each batch to its own part of folder/out, and all of that is returned.

    A batch that is run again overwrites its part.  With a folder given, the next run goes on where this one ended.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, f"{folder}/out/batch={batch_id}", folder)

    with rocksdb_state(spark):
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = f"{folder}/out"
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)


def run_to_table(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what there is, into Parquet, and read that; a folder lets a later run go on from its checkpoint."""
    return _run(stream, folder, mode, lambda batch, _, path, __: batch.write.mode("overwrite").parquet(path))


def stream_ingest(stream: DataFrame, event_key: str, ledger: DataFrame, delay: str = "7 days", folder: str | None = None) -> DataFrame:
    """Take in an at-least-once stream of messages (key, ts) once each, and return all that was taken in so far.

    Repeats within delay are dropped by the stream's state, later ones by a ledger of what earlier batches took in, of which a batch reads
    only the parts that may hold its own (KeyLedger), and keys of the ledger given by an anti-join.  A batch that is run again overwrites its own part, and with a
    folder given a later run goes on where this one ended, so nothing is doubled.
    """
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([event_key])

    def write(batch: DataFrame, batch_id: int, path: str, folder: str) -> None:
        taken_once(KeyLedger(batch.sparkSession, f"{folder}/ledger"), batch.join(ledger, "key", "left_anti").select(*batch.columns), event_key, batch_id, path)

    return _run(once, folder, "append", write)


def stream_articles(stream: DataFrame, store: str, key: list[str], order: list, date: str = "published", undated: str | None = None, folder: str | None = None) -> None:
    """Write an article stream to a store where the first writing of a key stays; undated articles go to their own table, or nowhere.

    With a folder given, a later run goes on from its checkpoint; a batch that is run again changes nothing in either table.
    """
    from ..sources.tables import append_articles

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        append_articles(batch.where(F.col(date).isNotNull()), store, key, order)
        if undated:
            batch.where(F.col(date).isNull()).write.mode("overwrite").parquet(f"{undated}/batch={batch_id}")
        batch.unpersist()

    folder = folder or shared_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_coverage(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(theme, start, n): themes by windows of three days that begin each day; closed windows only, undated rows in none."""
    windows = stream.where("ts is not null").withWatermark("ts", delay).groupBy(F.window("ts", "3 days", "1 day"), F.col("event_type").alias("theme")).agg(F.count("*").alias("n"))
    return windows.select("theme", F.col("window.start").alias("start"), "n")


def stream_funnel(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, stage, n): counts of each stage by day, closed days only."""
    days = stream.where("ts is not null").withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "stage", "n")


def stream_job_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "reset")
    rows = event_stream(spark, d).select(F.col("user_id").alias("job_id"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("failure "), F.col("event_id").cast("string")).alias("error"))
    return rows.where("kind is not null")


def stream_alerts(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """(run_id, ts): the first alert of each run, as rows of a table; sending them is left to its reader.

    Runs that earlier batches alerted are told by a ledger that is read in part, so the stream keeps no state.
    """

    def write(batch: DataFrame, batch_id: int, path: str, folder: str) -> None:
        first = batch.groupBy("run_id").agg(F.min("ts").alias("ts"))
        taken_once(KeyLedger(batch.sparkSession, f"{folder}/ledger"), first, "run_id", batch_id, path)

    return _run(stream.select("run_id", "ts"), folder, "append", write)
