"""The bucketed ledger: lookups against a set, merging, repeated batches, and what a batch reads."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pressroom.streaming.ledger import BITS_PER_KEY, KeyLedger, bloom, might_hold, taken_once


def test_bloom_filters():
    r = np.random.default_rng(1)
    held, others = r.integers(-(1 << 63), 1 << 63, 20_000), r.integers(-(1 << 63), 1 << 63, 200_000)
    filter_ = bloom(held)
    assert len(filter_) * 8 == len(held) * BITS_PER_KEY
    assert might_hold(filter_, held).all() and might_hold(filter_, others).sum() < 60
    assert not might_hold(bloom(held[:0]), others).any()


def test_batches_against_a_set(spark, tmp_path):
    r, seen, got = random.Random(3), set(), []
    ledger = KeyLedger(spark, f"file://{tmp_path}/ledger", buckets=4, fan=3)
    for batch in range(9):
        rows = [(r.randrange(150), i) for i in range(40)] + [(None, -1)]
        frame = spark.createDataFrame(rows, "k long, key int").repartition(2)
        for _ in range(1 + (batch % 4 == 2)):  # some batches are run twice
            fresh = taken_once(ledger, frame, "k", batch, f"file://{tmp_path}/out/batch={batch}")
            got = sorted((x["k"], x["key"]) for x in fresh.collect() if x["k"] is not None)
            assert got == sorted(x for x in rows if x[0] is not None and x[0] not in seen)
            assert sum(x["k"] is None for x in fresh.collect()) == 1
        seen |= {k for k, _ in got}
    assert len(ledger.generations()) <= 5
    # A crash between the two steps of replacing the list leaves the new one.
    (tmp_path / "ledger" / "generations.json").rename(tmp_path / "ledger" / "generations.json.new")
    assert ledger.unseen(spark.createDataFrame([(k,) for k in range(200)], "k long"), "k", 9).count() == 200 - len(seen)


def test_rows_read_do_not_grow_with_history(spark, tmp_path):
    ledger = KeyLedger(spark, f"file://{tmp_path}/ledger", buckets=16, fan=2)
    keys = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    read = []
    for batch in range(5):
        ledger.merge(batch)
        # New keys and one of the first batch.
        asked = keys(10_000 * batch, 10_000 * batch + 300).unionByName(keys(0, 1))
        assert ledger.unseen(asked, "k", batch).count() == 300 + (batch == 0)
        read.append(ledger.rows_read)
        ledger.add(keys(10_000 * batch, 10_000 * batch + 5_000), "k", batch)
    assert read[0] == 0 and max(read) < 5_000 and ledger.unseen(keys(90_000, 90_100), "k", 5).count() == 100
    assert ledger.rows_read < 2_000


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_a_ledger_of_nothing(spark, tmp_path, rows):
    ledger = KeyLedger(spark, f"file://{tmp_path}/ledger")
    frame = spark.createDataFrame(rows, "k string")
    for batch in range(2):
        assert taken_once(ledger, frame, "k", batch, f"file://{tmp_path}/out{batch}").count() == len(rows)
