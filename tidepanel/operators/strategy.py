"""The baseline pair strategy: hedge ratios of a training span, past-only scores, entries of a test window, gated by what training shows of their reversion."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import past_zscore
from tidepanel.operators import signals


@dataclass(frozen=True)
class Span:
    """Days of a run, both ends included: training, entries of the test window, and the last day on which positions may still be open."""

    train_start: dt.date
    train_end: dt.date
    test_start: dt.date
    entry_end: dt.date
    exit_end: dt.date


def _within(start: dt.date, end: dt.date) -> Column:
    return F.col("ts").between(F.lit(start), F.lit(end))


def hedge_ratios(pairs: DataFrame, span: Span, least: int) -> DataFrame:
    """pair, beta of the pairs that training can fit: at least ten rows and `least`, both sides moving, a positive slope of y on x with intercept."""
    fit = pairs.where(_within(span.train_start, span.train_end)).groupBy("pair")
    fit = fit.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sy"), F.stddev_pop("x").alias("sx"), F.regr_slope("y", "x").alias("beta"))
    return fit.where((F.col("n") >= max(10, least)) & (F.col("sy") > 0) & (F.col("sx") > 0) & (F.col("beta") > 0)).select("pair", "beta")


def scores(pairs: DataFrame, span: Span, window: int, least: int) -> DataFrame:
    """pair, ts, beta, spread, z, training: rows of training before the pair's first test row, and of the test up to the last exit day; z from the `window` rows before. pairs: pair, ts, y, x, both present."""
    present = pairs.where(F.col("y").isNotNull() & F.col("x").isNotNull())
    fit = hedge_ratios(present, span, least)
    test = _within(span.test_start, max(span.exit_end, span.entry_end))
    first = F.min(F.when(test, F.col("ts"))).over(Window.partitionBy("pair"))
    at = present.join(fit, "pair").withColumn("_first", first).where(F.col("_first").isNotNull())
    training = _within(span.train_start, span.train_end) & (F.col("ts") < F.col("_first"))
    at = at.where(training | test).select("pair", "ts", "beta", (F.col("y") - F.col("beta") * F.col("x")).alias("spread"), training.alias("training"))
    return at.withColumn("z", past_zscore(F.col("spread"), window, least, "pair"))


def baseline(pairs: DataFrame, span: Span, entry: float = 2.0, stop: float = 4.0, window: int = 60, least: int | None = None, gate: dict | None = None) -> DataFrame:
    """Intents: pair, ts, side, z, beta, entry_end. A row of the entry window enters as signals.entries says; the score before the window's first row does not count. gate: options of signals.entry_gate, trained on
    the training rows; none: every entry passes."""
    least = max(1, -(-window // 2)) if least is None else max(1, min(window, least))
    scored = scores(pairs, span, window, least)
    rows = scored.where(_within(span.test_start, span.entry_end))
    found = signals.entries(rows, entry, stop, "pair")
    if gate is not None:
        passes = signals.entry_gate(scored.select("pair", "ts", "z", "training"), F.col("training"), key="pair", **gate)
        found = found.join(passes.select("pair", "ts", "gate"), ["pair", "ts"]).where("gate")
    return found.select("pair", "ts", "side", "z", "beta", F.lit(span.entry_end).alias("entry_end"))


signals.register("baseline", baseline)
