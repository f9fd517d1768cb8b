"""The job machine: waits, timers and restarts."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pressroom.operators.jobs import fold_jobs
from pressroom.streaming.jobs import due_wakes, stream_job_machine
from pressroom.streaming.streams import run_to_table

EVENTS = "job_id long, ts timestamp, seq long, kind string, error string"


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture
def machine(spark, tmp_path):
    """Feeds events and gives all rows so far, going on from the checkpoint."""

    def go(rows: list[tuple], delay: str = "1 minute", limit: int = 51) -> list[tuple]:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        out = run_to_table(stream_job_machine(stream, limit, delay), "update", folder=f"file://{tmp_path}/work")
        return [tuple(r) for r in out.orderBy("last_ts", "last_seq").select("job_id", "event", "status", "failure_count", "last_error", "process_after").collect()]

    return go


def wakes(rows: list[tuple]) -> list[tuple]:
    return sorted((r[0], r[3], r[5]) for r in rows if r[1] == "wake")


def test_a_job_wakes_without_an_event_of_its_own(machine):
    rows = machine([(1, at(0), 1, "fail", "x"), (2, at(0.5), 2, "reset", None)])
    assert wakes(rows) == [] and (1, "state", "pending", 1, "x", at(1)) in rows
    # Another job's event lets the time go by; the timer was set before the restart.
    rows = machine([(2, at(9), 3, "complete", None)])
    assert wakes(rows) == [(1, 1, at(1))]
    # It wakes once, and the next failure counts on.
    rows = machine([(1, at(10), 4, "fail", "y"), (2, at(30), 5, "reset", None)])
    assert wakes(rows) == [(1, 1, at(1)), (1, 2, at(12))] and (1, "state", "pending", 2, "y", at(12)) in rows


def test_an_event_within_the_wait_ends_it(machine):
    rows = machine([(1, at(0), 1, "fail", "a"), (1, at(1), 2, "fail", "b"), (1, at(2), 3, "complete", None), (1, at(60), 4, "fail", "c"), (3, at(90), 5, "reset", None)])
    assert wakes(rows) == [(1, 1, at(61))]
    assert (1, "state", "pending", 0, None, at(91)) in machine([(1, at(91), 6, "reset", None)])


def test_the_limit_ends_a_job(machine):
    rows = machine([(1, at(20 * i), i, "fail", "e" * 600) for i in range(4)] + [(2, at(500), 9, "reset", None), (None, at(3), 10, "fail", None), (3, None, 11, "fail", None), (4, at(3), 12, "odd", None)], limit=3)
    mine = [r for r in rows if r[0] == 1 and r[1] == "state"]
    assert mine == [(1, "state", "errored", 4, "e" * 500, None)]
    assert {r[0] for r in rows} == {1, 2, None}
    assert wakes(r for r in rows if r[0] == 1) == [(1, 1, at(1)), (1, 2, at(22))]


def test_batches_and_one_table_give_the_same(spark, machine):
    r = random.Random(4)
    events = sorted((r.randrange(6), at(r.randrange(400) / 2), i, r.choice(["fail", "fail", "fail", "complete", "reset"]), f"e{i}") for i in range(300))
    events.sort(key=lambda e: (e[1], e[2]))
    for i in range(0, 300, 100):
        rows = machine(events[i : i + 100], "0 seconds")
    table = spark.createDataFrame(events, EVENTS)
    assert wakes(rows) == sorted((w["job_id"], w["failure_count"], w["process_after"]) for w in due_wakes(table, delay="0 seconds").collect())
    last = {x[0]: x[2:] for x in rows if x[1] == "state"}
    assert last == {f["job_id"]: (f["status"], f["failure_count"], f["last_error"], f["process_after"]) for f in fold_jobs(table).collect()}


def test_state_is_read_and_written_once_for_a_job():
    from pressroom.streaming.jobs import JobMachine

    calls, held = [], [None]

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            calls.append("get")
            return held[0]

        def update(self, value):
            calls.append("update")
            held[0] = value

        def registerTimer(self, at):  # noqa: N802
            calls.append(f"timer {at}")

        def deleteTimer(self, at):  # noqa: N802
            calls.append(f"no timer {at}")

    job = JobMachine(51)
    job.init(Handle())
    rows = lambda *x: iter([(1, None, p) for p in x])
    out = list(job.handleInputRows((1,), rows("0\t1\tfail\ta\tb", "60001\t2\tfail"), None))
    assert calls == ["get", "update", "timer 180001"]
    assert [tuple(r) for r in out] == [(1, "wake", "pending", 1, None, None, None, 60000), (1, "state", "pending", 2, None, 60001, 2, 180001)]
    calls.clear()
    assert [r[1] for r in job.handleInputRows((1,), rows("60001\t2\tfail\tlate", "70000\t3\treset"), None)] == ["state"]
    assert calls == ["get", "no timer 180001", "update"]
