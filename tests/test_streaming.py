"""Streams in several batches against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tidepanel.operators import signals
from tidepanel.plans import stream_queries
from tidepanel.streaming import live, machines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(stream_queries.ORACLE))
def test_matches_sql(spark, name):
    assert_same(stream_queries.QUERIES[name](spark, SF), connect(SF), stream_queries.ORACLE[name])


def stream_of(spark, folder, batches, schema, delay):
    """A file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", delay)


def at(day, hour=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_late_versions_inside_and_outside_the_watermark(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq long, close double"
    batches = [
        [("A", at(0), 1, 10.0), ("A", at(1), 1, 11.0), ("B", at(0), 1, 5.0)],
        [("A", at(1), 2, 11.5), ("A", at(3), 1, 13.0)],  # a later version in time; the watermark goes to day 2
        [("A", at(0), 9, 99.0), ("A", at(3), 3, 13.5), ("A", at(3), 2, 13.2)],  # day 0 has been emitted
        [("A", at(9), 1, 19.0)],
    ]
    stream = stream_of(spark, tmp_path / "in", batches, schema, "1 day")
    out = machines.drained(spark, machines.last_versions(stream, ["symbol"], "ts", "seq", ["close"]))
    got = sorted((r.symbol, r.ts, r.seq, r.close) for r in out.collect())
    assert got == [("A", at(0), 1, 10.0), ("A", at(1), 2, 11.5), ("A", at(3), 3, 13.5), ("B", at(0), 1, 5.0)]
    # the batch twin sees the late row of day 0 as well, and is equal elsewhere
    every = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("key", F.concat_ws("/", "symbol", "ts"))
    twin = sorted((r.symbol, r.ts, r.seq, r.close) for r in live.latest(every, "key", "seq").collect())
    assert [r for r in twin if r[1] not in (at(0), at(9))] == [r for r in got if r[1] != at(0)] and ("A", at(0), 9, 99.0) in twin


def test_positions_across_batches_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, at(d), None if rng.random() < 0.05 else rng.gauss(0, 2)) for s in "AB" for d in range(60)]
    shuffled = [[r for r in rows if lo <= r[1] < hi] for lo, hi in ((at(0), at(20)), (at(20), at(41)), (at(41), at(60)))]
    shuffled[0].append(shuffled[1].pop(0))  # early
    moved = next(r for r in shuffled[0] if r[1] == at(18))
    shuffled[0].remove(moved)
    shuffled[1].append(moved)  # two days late, within the delay
    for batch in shuffled:
        rng.shuffle(batch)
    schema = "symbol string, ts timestamp, z double"
    stream = stream_of(spark, tmp_path / "in", shuffled, schema, "4 days")
    options = {"entry": 1.5, "exit": 0.4, "stop": 4.5, "max_hold": 6, "cooldown": 2}
    out = machines.drained(spark, machines.positions(stream, [at(d) for d in range(60)], lag=2, **options)).collect()
    table = spark.createDataFrame([(s, t.date(), z) for s, t, z in rows], "symbol string, ts date, z double")
    want = {(r.symbol, r.ts): r.pos for r in signals.positions(table, **options).collect() if r.ts <= at(55).date()}
    assert {(r.symbol, r.ts.date()): r.pos for r in out if r.kind == "position"} == want
    exits = sorted((s, d) for (s, d), pos in want.items() if not pos and want.get((s, d - dt.timedelta(days=1))))
    settled = sorted((r.symbol, r.exit_ts.date(), r.ts.date()) for r in out if r.kind == "settled")
    assert settled == [(s, d, d + dt.timedelta(days=2)) for s, d in exits if d + dt.timedelta(days=2) <= at(55).date()] and settled
