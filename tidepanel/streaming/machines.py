"""Stateful streams: a position machine per key that walks its rows in event time, and a queue of settlements; the last of late versions.

Rows of a key wait in its state until the watermark has passed them, so they are walked in order whatever batch they came in; a timer stands at the earliest one that waits. Rows
behind the watermark are dropped by the engine. What is to settle waits in the same queue, at its own day.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.operators.storage import shared_folder

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "symbol string, ts timestamp, kind string, z double, pos int, exit_ts timestamp"


def _emitted(symbol: str, rows: list[tuple]) -> pd.DataFrame:
    at, kinds, z, pos, left = ([r[i] for r in rows] for i in range(5))
    plain = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({"symbol": plain([symbol] * len(rows)), "ts": pd.to_datetime(at, unit="ms"), "kind": plain(kinds), "z": pd.Series(z, dtype="float64"), "pos": plain(pos), "exit_ts": pd.to_datetime(left, unit="ms")})


class Machine:
    """The position rules of signals.positions, one row at a time. State: position, rows held, rows to wait, the z before."""

    def __init__(self, entry: float, exit: float, stop: float, max_hold: int, cooldown: int) -> None:
        self.entry, self.exit, self.stop, self.max_hold, self.cooldown = entry, exit, stop, max_hold, cooldown

    def step(self, state: tuple[int, int, int, float], z: float) -> tuple[int, int, int, float]:
        pos, held, wait, before = state
        if wait:
            return pos, held, wait - 1, z
        if z != z:
            return (0, 0, self.cooldown, z) if pos else (0, held, 0, z)
        if not pos:
            if -self.stop < z <= -self.entry and not before <= -self.entry:
                return 1, 0, 0, z
            if self.entry <= z < self.stop and not before >= self.entry:
                return -1, 0, 0, z
            return 0, 0, 0, z
        held += 1
        if abs(z) <= self.exit or abs(z) >= self.stop or 0 < self.max_hold <= held or pos * z >= self.entry:
            return 0, held, self.cooldown, z
        return pos, held, 0, z


class Positions(StatefulProcessor):
    """Emits a position for each row and a settlement for each exit, `lag` sessions later (the last session, if there are fewer)."""

    def __init__(self, machine: Machine, sessions: list[int], lag: int) -> None:
        self.machine, self.sessions, self.lag = machine, sessions, lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "pos int, held int, wait int, before double")
        self.waiting = handle.getListState("waiting", "at long, kind int, z double, exit long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            at = frame["ts"].to_numpy().astype("datetime64[ms]").astype("int64")
            new += [(int(t), 0, None if z != z else float(z), None) for t, z in zip(at, frame["z"].astype(float), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(x[0] for x in new))
        yield _emitted(key[0], [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        nan = float("nan")
        queue = [(at, kind, nan if z is None else z, left) for at, kind, z, left in self.waiting.get()] if self.waiting.exists() else []
        heapq.heapify(queue)
        found = self.state.get() if self.state.exists() else None
        state = (0, 0, 0, nan) if found is None else (found[0], found[1], found[2], nan if found[3] is None else found[3])
        out = []
        while queue and queue[0][0] <= passed:
            at, kind, z, left = heapq.heappop(queue)
            if kind == 1:
                out.append((at, "settled", None, None, left))
                continue
            before = state[0]
            state = self.machine.step(state, z)
            out.append((at, "position", z, state[0], None))
            if before and not state[0]:
                i = bisect_right(self.sessions, at) - 1 + self.lag
                heapq.heappush(queue, (max(at, self.sessions[min(i, len(self.sessions) - 1)]), 1, nan, at))
        if out:
            self.state.update((state[0], state[1], state[2], None if state[3] != state[3] else state[3]))
            self.waiting.clear()
            if queue:
                self.waiting.put([(at, kind, None if z != z else z, left) for at, kind, z, left in queue])
                self.handle.registerTimer(queue[0][0])
        yield _emitted(key[0], out)

    def close(self) -> None:
        pass


def positions(scores: DataFrame, sessions: list, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0, max_hold: int = 20, cooldown: int = 5, lag: int = 2) -> DataFrame:
    """symbol, ts, kind (position or settled), z, pos, exit_ts of a stream of scores (symbol, ts, z) that has a watermark on ts. sessions: the calendar's days, sorted; they are sent to
    every task, so they are days and not rows. A row is final when it is emitted."""
    at = [int(pd.Timestamp(s).value // 1_000_000) for s in sessions]
    machine = Machine(entry, exit, stop, max_hold, cooldown)
    return scores.groupBy("symbol").transformWithStateInPandas(Positions(machine, at, lag), _OUT, "Append", "EventTime")


def last_versions(updates: DataFrame, keys: list[str], ts: str, order: str, fields: list[str]) -> DataFrame:
    """Of the versions of a row (keys and ts) the one with the greatest order, once the watermark has passed ts: emitted once, in append mode. Versions that come behind the watermark are dropped.
    updates: a stream with a watermark on ts; of equal orders the greatest fields win. Kept as an aggregation, so a row's state is its last version only."""
    best = F.max(F.struct(order, *fields)).alias("_v")
    return updates.groupBy(*keys, ts).agg(best).select(*keys, ts, f"_v.{order}", *[f"_v.{f}" for f in fields])


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs an append stream over all that its source has, timers and closed groups of the last watermark included, and returns what it has emitted."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, _ROCKS)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/rows").start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def as_stream(rows: DataFrame, order: str, parts: int = 1, delay: str = "0 seconds") -> DataFrame:
    """The rows as a stream with a watermark on `order`, written to the shared folder in `parts` files by ranges of it, a file a batch; for replays of a table."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder).withWatermark(order, delay)
