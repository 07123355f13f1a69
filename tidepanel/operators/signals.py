"""Signals of spreads: entry crossings, position state machine, Markov gate, exits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import by_time
from tidepanel.functions.scalars import markov_state


def entries(scored: DataFrame, entry: float, stop: float, key: str = "symbol") -> DataFrame:
    """Rows where z comes below -entry (side 1) or above entry (side -1) and is not at the stop. The z before counts with its sign, so a jump from one side to the other
    enters and a return from beyond the stop does not; a missing z before it is no hindrance."""
    now, prev = F.col("z"), F.lag("z").over(by_time(key))
    low = (now <= -entry) & (now > -stop) & (prev.isNull() | (prev > -entry))
    high = (now >= entry) & (now < stop) & (prev.isNull() | (prev < entry))
    return scored.withColumn("side", F.when(low, 1).when(high, -1)).where("side is not null")


def positions(scored: DataFrame, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0, max_hold: int = 20, cooldown: int = 5, nan_holds: bool = False, key: str = "symbol") -> DataFrame:
    """key, ts, z, pos: the position after each row. Each row depends on the position before it, so a key's rows are walked in order.

    Enters as `entries`; leaves within exit, at the stop, after max_hold rows, or once z reaches the entry level on the other side; then `cooldown` rows pass without entry.
    nan_holds: a missing z keeps the position (else it closes it).
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        pos, held, wait, prev, out = 0, 0, 0, np.nan, []
        for z in rows["z"].to_numpy(dtype=float):
            if wait:
                wait -= 1
            elif z != z:
                if pos and not nan_holds:
                    pos, wait = 0, cooldown
            elif not pos:
                held = 0
                if -stop < z <= -entry and not prev <= -entry:
                    pos = 1
                elif entry <= z < stop and not prev >= entry:
                    pos = -1
            else:
                held += 1
                if abs(z) <= exit or abs(z) >= stop or 0 < max_hold <= held or pos * z >= entry:
                    pos, wait = 0, cooldown
            prev = z
            out.append(pos)
        return rows.assign(pos=out)

    return scored.select(key, "ts", "z").groupBy(key).applyInPandas(walk, f"{key} string, ts date, z double, pos int")


def transitions(scored: DataFrame, inner: float = 0.5, outer: float = 1.5, smoothing: float = 0.0, by: tuple[str, ...] = (), key: str = "symbol") -> DataFrame:
    """state, next_state, n, share: adjacent present states, shares of the row; per `by`. With smoothing every next state of a row is there, its count raised by it."""
    state = markov_state(F.col("z"), inner, outer)
    at = scored.withColumn("state", state).withColumn("next_state", F.lead(state).over(by_time(key)))
    n = at.where("state is not null and next_state is not null").groupBy(*by, "state", "next_state").agg(F.count(F.lit(1)).alias("n"))
    if smoothing:
        full = n.select(*by, "state").distinct().select(*by, "state", F.explode(F.array(*[F.lit(i) for i in range(-2, 3)])).alias("next_state"))
        n = full.join(n, [*by, "state", "next_state"], "left").fillna(0, ["n"])
    raised = F.col("n") + smoothing
    return n.withColumn("share", raised / F.sum(raised).over(Window.partitionBy(*by, "state")))


def hit_probability(moves: DataFrame, horizon: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """state, p per `by`: probability that the neutral state is reached within the horizon. A state that nothing leaves stays where it is. At most 25 moves make a row."""
    cell = F.map_from_entries(F.collect_list(F.struct(F.col("state") * 10 + F.col("next_state"), "share")))
    states = [F.lit(i) for i in range(-2, 3)]
    table = moves.groupBy(*by).agg(cell.alias("m"), F.collect_set("state").alias("left"))

    def step(p: F.Column) -> F.Column:
        at = lambda i: sum((F.coalesce(F.try_element_at("m", F.lit(10 * i + j)), F.lit(0.0)) * p[j + 2] for j in range(-2, 3)), F.lit(0.0))
        return F.array(*[F.lit(1.0) if i == 0 else F.when(F.array_contains("left", i), at(i)).otherwise(p[i + 2]) for i in range(-2, 3)])

    start = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(-2, 3)])
    done = table.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, lambda p, _: step(p)))
    return done.select(*by, F.explode(F.arrays_zip(F.array(*states).alias("state"), F.col("p").alias("p"))).alias("x")).select(*by, F.col("x.state").cast("int").alias("state"), "x.p")


def entry_gate(scored: DataFrame, train: F.Column, horizon: int = 10, least: float = 0.6, min_train: int = 60, min_state: int = 10, inner: float = 0.5, outer: float = 2.0, smoothing: float = 0.0, key: str = "symbol") -> DataFrame:
    """Rows out of training with state, hit_prob and gate: entry is barred where the state's probability of reaching neutral is under `least`. States seen less than
    min_state times in training, or never left, bar nothing, nor do keys with less than min_train training states (their hit_prob is null)."""
    state = markov_state(F.col("z"), inner, outer)
    past = scored.where(train)
    moves = transitions(past, inner, outer, smoothing, (key,), key)
    seen = past.withColumn("state", state).where("state is not null").groupBy(key, "state").agg(F.count(F.lit(1)).alias("visits"))
    seen = seen.withColumn("total", F.sum("visits").over(Window.partitionBy(key)))
    known = hit_probability(moves, horizon, (key,)).join(seen, [key, "state"], "left").join(moves.select(key, "state").distinct().withColumn("leaves", F.lit(True)), [key, "state"], "left")
    total = seen.groupBy(key).agg(F.max("total").alias("n_train"))
    rows = scored.where(~train).withColumn("state", state).join(known.drop("total"), [key, "state"], "left").join(total, key, "left")
    enough = F.coalesce(F.col("n_train") >= min_train, F.lit(False))
    barred = enough & (F.col("visits") >= min_state) & F.col("leaves") & (F.col("p") < least)
    return rows.select(key, "ts", "z", "state", F.when(enough, F.col("p")).alias("hit_prob"), (~F.coalesce(barred, F.lit(False))).alias("gate"))


def exit_hits(open_trades: DataFrame, scored: DataFrame, entry: float, exit: float, stop: float, max_hold: int, key: str = "symbol") -> DataFrame:
    """trade rows (key, entry_ts, side) with exit_ts: the first later row that reverts, stops, reaches the entry level on the other side, has no z, or is the max_hold-th; the
    key's last row if none does. Rows are numbered per key, so the search is an equi-join on the row number with max_hold rows a trade."""
    w = by_time(key)
    rows = scored.select(key, "ts", "z", F.row_number().over(w).alias("_n"), F.max("ts").over(Window.partitionBy(key)).alias("_last"))
    at = open_trades.join(rows.select(key, F.col("ts").alias("entry_ts"), F.col("_n").alias("_at"), "_last"), [key, "entry_ts"])
    steps = at.withColumn("_held", F.explode(F.sequence(F.lit(1), F.lit(max_hold)))).withColumn("_n", F.col("_at") + F.col("_held"))
    seen = steps.join(rows.drop("_last"), [key, "_n"])
    due = F.col("z").isNull() | (F.abs("z") <= exit) | (F.abs("z") >= stop) | (F.col("_held") >= max_hold) | (F.col("side") * F.col("z") >= entry)
    found = seen.where(due).groupBy(key, "entry_ts").agg(F.min("ts").alias("hit"))
    return at.join(found, [key, "entry_ts"], "left").withColumn("exit_ts", F.coalesce("hit", "_last")).drop("hit", "_at", "_last")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"threshold": positions}


def register(name: str, strategy: Callable[..., DataFrame]) -> None:
    STRATEGIES[name] = strategy
