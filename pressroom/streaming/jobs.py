"""The job ledger as a stream with timers: states after each batch, and wake-ups of jobs whose wait is over."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "job_id LONG, event STRING, status STRING, failure_count LONG, last_error STRING, last_ts LONG, last_seq LONG, process_after LONG"
_OUT = Row(*[c.split()[0] for c in OUT.split(", ")])
_JOB = "kind STRING, failures LONG, error STRING, ts LONG, seq LONG, due LONG"
_STATUS = {"complete": "completed", "reset": "pending"}


def waits(failures: np.ndarray, most: int = 15) -> np.ndarray:
    """Milliseconds to wait after so many failures in a row."""
    return np.minimum(most, 2 ** np.clip(failures - 1, 0, 30)) * 60_000


class JobMachine(StatefulProcessor):
    """Folds a job's events and keeps a timer for the end of its wait.

    State: `job` is the last event with the failures in a row up to it, and the time at which the job wakes, if it waits.  A later
    event moves or ends the wait; a wait that ends before that event, or with no event at all, gives one `wake` row.
    Whether the timer or the next event tells of it depends on the batches, the row doesn't.  Most jobs have few events in a batch, so what counts is what is
    done for each job: rows go in and out as they are, without a frame for each job, and state is read and written once.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _JOB)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get()
        kind, failures, error, last_ts, last_seq, waiting = held if held is not None else ("reset", 0, None, None, -1, None)
        held_kind = kind
        times, seqs, fails, top = array("q"), array("q"), bytearray(), None
        for _, _, packed in rows:
            at, seq, event, *text = packed.split("\t", 3)
            at, seq = int(at), int(seq)
            if last_ts is None or (at, seq) > (last_ts, last_seq):
                # Of the texts only that of the last event is kept; of the others their time, order and kind.
                times.append(at)
                seqs.append(seq)
                fails.append(event == "fail")
                if top is None or (at, seq) >= top:
                    top, kind, error = (at, seq), event, text[0] if text else None
        if top is None:
            return
        ts, seq, fail = np.frombuffer(times, dtype=np.int64), np.frombuffer(seqs, dtype=np.int64), np.frombuffer(fails, dtype=bool)
        order = np.lexsort((seq, ts))
        ts, seq, fail = ts[order], seq[order], fail[order]
        place = np.arange(len(ts))
        # Failures in a row: since the last other event, or with those that the state holds.
        other = np.maximum.accumulate(np.where(fail, -1, place))
        run = np.where(fail, np.where(other < 0, place + 1 + (failures if held_kind == "fail" else 0), place - other), 0)
        due = np.where(fail & (run < self.limit), ts + waits(run), np.iinfo(np.int64).max)
        ended = np.flatnonzero(due[:-1] < ts[1:])
        woken = list(zip(due[ended].tolist(), run[ended].tolist()))
        if waiting is not None:
            self.handle.deleteTimer(waiting)
            if waiting < ts[0]:
                woken.insert(0, (waiting, failures))
        failures, last_ts, last_seq = int(run[-1]), *top
        pending = kind == "fail" and failures < self.limit
        wake = int(due[-1]) if pending else None
        error = error if kind == "fail" else None
        self.job.update((kind, failures, error, last_ts, last_seq, wake))
        for end, n in woken:
            yield self._wake(key, n, end)
        if kind == "fail":
            if pending:
                self.handle.registerTimer(wake)
            yield _OUT(key[0], "state", "pending" if pending else "errored", failures, error, last_ts, last_seq, wake)
        else:
            yield _OUT(key[0], "state", _STATUS[kind], 0, None, last_ts, last_seq, last_ts if kind == "reset" else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get()
        self.job.update((*held[:-1], None))
        yield self._wake(key, held[1], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    @staticmethod
    def _wake(key: tuple, failures: int, end: int) -> Row:
        return _OUT(key[0], "wake", "pending", failures, None, None, None, end)


def stream_job_machine(events: DataFrame, limit: int = 51, delay: str = "1 hour") -> DataFrame:
    """`state` rows, each job's state after every batch with events of it, and `wake` rows, one for each wait that ended.

    events is a stream of (job_id, ts, seq, kind, error).  fail makes a job wait 1, 2, 4, 8, then 15 minutes and errors it at limit failures in a
    row; complete ends it, reset makes it pending at once.  Time is that of the events: a wait ends when an event of the job comes after it, or when events of any
    job have passed it by delay.  Events that come more than delay late, and those no later than their job's state, are left out, as are other kinds and null times.
    State is kept by RocksDB (rocksdb_state); of a batch, a job's events are held as 17 bytes each, so the trigger's file limit bounds them.
    """
    # Each cell of a row is taken over by itself, so an event is one text, its error cut to what is kept, beside the time that the watermark needs.
    error = F.when(F.col("kind") == "fail", F.substring("error", 1, 500))
    packed = F.concat_ws("\t", F.unix_millis("ts").cast("string"), F.col("seq").cast("string"), "kind", error)
    rows = events.where("kind in ('fail', 'complete', 'reset') and ts is not null").select("job_id", "ts", packed.alias("packed")).withWatermark("ts", delay)
    out = rows.groupBy("job_id").transformWithState(JobMachine(limit), OUT, "Update", "EventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("last_ts", "process_after")})


def stream_jobs(events: DataFrame, limit: int = 51, delay: str = "7 days") -> DataFrame:
    """Each job's state after every batch: pending with back-off, errored at limit failures in a row, or completed; wake-ups are left out."""
    return stream_job_machine(events, limit, delay).where("event = 'state'").drop("event")


def due_wakes(events: DataFrame, limit: int = 51, delay: str = "1 hour") -> DataFrame:
    """(job_id, failure_count, process_after) of a table of events: the wake rows that a stream of them gives.

    The batch twin of stream_job_machine: a wait that ends before the job's next event, or before the last event of all less delay.
    """
    from pyspark.sql import Window

    from ..functions.time import next_retry
    from ..operators.jobs import failure_runs

    rows = events.where("kind in ('fail', 'complete', 'reset') and ts is not null")
    runs = failure_runs(rows).withColumn("next", F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "seq")))
    last = rows.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("passed"))
    due = runs.where("kind = 'fail'").withColumn("process_after", next_retry(F.col("failures"), F.col("ts"), limit)["process_after"])
    # One row of one value: the last time of all.
    ended = due.join(F.broadcast(last)).where("process_after < next or (next is null and process_after <= passed)")
    return ended.select("job_id", F.col("failures").alias("failure_count"), "process_after")
