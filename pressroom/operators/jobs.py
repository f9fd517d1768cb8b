"""The job ledger: due and stale jobs, the fold of job events, and enqueueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import next_retry


def due_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Pending jobs whose time has come, oldest first."""
    return jobs.where((F.col("status") == "pending") & (F.col("process_after") <= as_of)).orderBy("process_after", "job_id")


def list_jobs(jobs: DataFrame, feed: str, status: str, feeds: tuple[str, ...]) -> DataFrame:
    """Jobs of a feed and status, newest date first; a feed that isn't among feeds is refused."""
    if feed not in feeds:
        raise ValueError(f"unknown feed: {feed}")
    return jobs.where((F.col("feed_slug") == feed) & (F.col("status") == status)).orderBy(F.desc("job_date"), "job_id")


def stale_jobs(jobs: DataFrame, today: Column) -> DataFrame:
    """Jobs that are still pending or errored after their day."""
    return jobs.where(F.col("status").isin("pending", "errored") & (F.col("job_date") < today)).orderBy("job_date", "job_id")


def failure_runs(events: DataFrame) -> DataFrame:
    """events (job_id, ts, seq, kind) with failures: those in a row up to this event, since the last success or reset."""
    w = Window.partitionBy("job_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    since = F.sum(F.col("kind").isin("complete", "reset").cast("long")).over(w)
    runs = events.withColumn("_run", since)
    v = Window.partitionBy("job_id", "_run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("failures", F.sum((F.col("kind") == "fail").cast("long")).over(v)).drop("_run")


def fold_jobs(events: DataFrame, limit: int = 51) -> DataFrame:
    """Each job's state after all its events: status, failure_count, last_error (500 characters) and process_after.

    A job waits longer after each failure and is errored at limit of them; reset makes it
    pending at once, complete ends it.
    """
    runs = failure_runs(events.where(F.col("kind").isin("fail", "complete", "reset")))
    last = runs.groupBy("job_id").agg(F.max_by(F.struct("kind", "ts", "failures", F.substring("error", 1, 500).alias("error")), F.struct("ts", "seq")).alias("e"))
    retry = next_retry(F.col("e.failures"), F.col("e.ts"), limit)
    failed = F.col("e.kind") == "fail"
    return last.select(
        "job_id",
        F.when(failed, retry["status"]).when(F.col("e.kind") == "complete", "completed").otherwise("pending").alias("status"),
        F.when(failed, F.col("e.failures")).otherwise(0).cast("long").alias("failure_count"),
        F.when(failed, F.col("e.error")).alias("last_error"),
        F.when(failed, retry["process_after"]).when(F.col("e.kind") == "reset", F.col("e.ts")).alias("process_after"),
    )


def enqueue_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (feed_slug, date_str) once each, with outcome: queued, exists:<status>, or bad_date unless the date is zero-padded and real."""
    asked = requests.select("feed_slug", "date_str").distinct().withColumn("job_date", F.when(F.col("date_str").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date_str", "yyyy-MM-dd")))
    held = jobs.groupBy("feed_slug", "job_date").agg(F.min_by("status", "job_id").alias("_status"))
    rows = asked.join(held, ["feed_slug", "job_date"], "left")
    outcome = F.when(F.col("job_date").isNull(), "bad_date").when(F.col("_status").isNotNull(), F.concat(F.lit("exists:"), F.col("_status"))).otherwise("queued")
    return rows.select("feed_slug", "date_str", outcome.alias("outcome"))
