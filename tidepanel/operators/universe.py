"""Universe selection: liquidity, filter chain with reasons, symbol rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.rolling import at_least, median, trailing
from tidepanel.operators.reports import first_reason


def adv(bars: DataFrame, window: int, min_ratio: float = 0.5) -> DataFrame:
    """Per symbol over its last `window` days with price and volume: median traded value and price, mean volume; null-free and long enough only."""
    valid = bars.where("close > 0 and volume > 0").withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_r") <= window)
    out = valid.groupBy("symbol").agg(median(F.col("close") * F.col("volume")).alias("adv"), median(F.col("close")).alias("price"), F.avg("volume").alias("volume"), F.count(F.lit(1)).alias("days"))
    return out.where(F.col("days") >= -(-window * min_ratio // 1))


def rolling_adv(bars: DataFrame, window: int, least: int, stat: str = "median") -> DataFrame:
    """Adds adv: rolling mean or median of traded value."""
    value = F.col("close") * F.col("volume")
    at = bars.withColumn("_x", value)
    agg = median(F.col("_x")) if stat == "median" else F.avg("_x")
    return at.withColumn("adv", at_least(agg, F.col("_x"), trailing(window), least)).drop("_x")


def adv_gate(rolled: DataFrame, floor: float, min_share: float) -> DataFrame:
    """Per symbol: rows with a window, rows at the floor or above, their share, and whether it passes."""
    out = rolled.groupBy("symbol").agg(F.count("adv").alias("n"), F.count_if(F.col("adv") >= floor).alias("n_ok"))
    share = F.coalesce(F.try_divide(F.col("n_ok"), F.col("n")), F.lit(0.0))
    return out.withColumn("share", share).withColumn("passes", share >= min_share)


def screen(rows: DataFrame, rules: Sequence, whitelist: Sequence[str] = (), key: str = "symbol") -> DataFrame:
    """Adds reason (first failed rule, null if none) and selected; whitelisted keys come back with their reason kept."""
    reason = first_reason(rules)
    return rows.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull() | F.col(key).isin(*whitelist) if whitelist else F.col("reason").isNull())


def is_junk(symbol) -> F.Column:
    """Warrants, units, rights, preferreds and test issues: by the end of the symbol, a leading $, or a mark inside it."""
    token = F.upper(F.trim(symbol))
    return token.rlike(r"^\$|(\.W|\.U|\.R|-W|-U|-R|-WS|\.WS|-P[A-Z]?)$|\^")


def keep_symbols(symbols: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), patterns: Sequence[str] = (), contains: Sequence[str] = (), column: str = "symbol") -> DataFrame:
    """Symbols (trimmed, upper case) without those that begin or end with, hold or match any of the lists."""
    token = F.upper(F.trim(column))
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | token.startswith(p.upper())
    for s in suffixes:
        bad = bad | token.endswith(s.upper())
    for c in contains:
        bad = bad | token.contains(c.upper())
    for r in patterns:
        bad = bad | token.rlike(f"(?i){r}")
    return symbols.withColumn(column, token).where(~bad)


def bounded_number(text, default: float, least: float | None = None, positive: bool = False) -> F.Column:
    """A finite number read from text, else the default; not positive where it must be: the default; under the least: the least."""
    x = F.expr(f"try_cast(`{text}` AS double)")
    x = F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")), default).otherwise(x)
    x = F.when(x <= 0, default).otherwise(x) if positive else x
    return F.greatest(x, F.lit(float(least))) if least is not None else x


#: Texts that mean yes.
YES = ("1", "true", "yes", "on", "force")


def truthy(text, default: bool = False) -> F.Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*YES), F.lit(default))


def float_share(df: DataFrame) -> DataFrame:
    """Adds float_pct and float_source: floating over outstanding shares (native); shares short over their part of the float (derived); else the least of what holders leave
    (conservative); else missing (low_confidence). Columns: float_shares, shares_out, shares_short, short_of_float, insiders, institutions, institutions_of_float."""
    unit = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    out, native = F.col("shares_out"), F.try_divide(F.col("float_shares"), F.nullif("shares_out", F.lit(0.0)))
    derived = F.try_divide(F.col("shares_short"), F.when(F.col("short_of_float") > 0, F.col("short_of_float")))
    derived = F.when((derived > 0) & (derived <= out * 1.5) & (out > 0), derived / out)
    kept = F.least(unit(1 - F.col("insiders")), unit(F.col("institutions_of_float")), unit(F.col("institutions")))
    native = F.when((native > 0) & (native <= 1.2), native)
    source = F.when(native.isNotNull(), "native").when(derived.isNotNull(), "derived").when(kept.isNotNull(), "conservative").otherwise("low_confidence")
    return df.withColumns({"float_pct": F.when(source != "low_confidence", unit(F.coalesce(native, derived, kept))), "float_source": source})


def effective(df: DataFrame) -> DataFrame:
    """Adds price_eff, volume_eff and dollar_adv_eff: the warm-up statistic where df has that column at all, else the snapshot."""
    pick = lambda warm, now: F.expr(f"try_cast(`{warm}` AS double)") if warm in df.columns else F.expr(f"try_cast(`{now}` AS double)") if now in df.columns else F.lit(None).cast("double")
    return df.withColumns({"price_eff": pick("price_warmup_med", "price"), "volume_eff": pick("volume_warmup_avg", "volume"), "dollar_adv_eff": pick("dollar_adv_hist", "dollar_adv")})


def standard_rules(df: DataFrame, cfg: dict) -> list[tuple[str, F.Column]]:
    """The ordered chain of universe filters that cfg asks for, as (reason, failed). Missing values fail a bound; a missing float share passes if cfg says so."""
    c = F.col
    core = [x for x in ("price_eff", "market_cap", "volume_eff") if x in df.columns]
    rules = []
    if cfg.get("drop_na", True):
        rules.append(("REASON_NA_CORE_FIELD", F.greatest(*[c(x).isNull() for x in core])))
    if cfg.get("drop_zero", True):
        rules.append(("REASON_ZERO_CORE_FIELD", ~F.coalesce((c("price_eff") > 0) & (c("volume_eff") > 0), F.lit(False))))
    for column, name, low, high in (("price_eff", "PRICE", "min_price", "max_price"), ("market_cap", "MCAP", "min_market_cap", "max_market_cap"), ("volume_eff", "VOL", "min_avg_volume", "max_avg_volume")):
        if column in df.columns and cfg.get(low) is not None:
            rules.append((f"REASON_LOW_{name}", ~F.coalesce(c(column) >= cfg[low], F.lit(False))))
        if column in df.columns and cfg.get(high) is not None:
            rules.append((f"REASON_HIGH_{name}", ~F.coalesce(c(column) <= cfg[high], F.lit(False))))
    if cfg.get("min_dollar_adv") is not None:
        rules += [("REASON_NO_HIST_ADV", c("dollar_adv_eff").isNull()), ("REASON_LOW_DADV", c("dollar_adv_eff") < cfg["min_dollar_adv"])]
    if cfg.get("min_float_pct") is not None and "float_pct" in df.columns:
        rules.append(("REASON_FLOAT_PCT", ~F.coalesce(c("float_pct") >= cfg["min_float_pct"], F.lit(bool(cfg.get("treat_missing_float_as_pass"))))))
    for bound, shares, name in (("min_free_float_shares", "shares_out", "REASON_FF_SHARES"), ("min_free_float_dollar_cap", "market_cap", "REASON_FF_DOLLAR_CAP")):
        if cfg.get(bound) is not None and {"float_pct", shares} <= set(df.columns):
            rules.append((name, F.coalesce(c("float_pct") * c(shares), F.lit(0.0)) < cfg[bound]))
    if cfg.get("require_dividend") and "dividend" in df.columns:
        rules.append(("REASON_DIVIDEND_REQ", ~F.coalesce(c("dividend"), F.lit(False))))
    return rules


def canary(df: DataFrame, min_rows: int, max_missing: float) -> DataFrame:
    """One row: n, core_missing (share over price, market_cap and volume), float_missing, ok."""
    core = [x for x in ("price", "market_cap", "volume") if x in df.columns]
    share = lambda cols: F.coalesce(sum((F.count_if(F.col(x).isNull()) for x in cols), F.lit(0)) / (F.count(F.lit(1)) * len(cols)), F.lit(1.0)) if cols else F.lit(0.0)
    out = df.agg(F.count(F.lit(1)).alias("n"), share(core).alias("core_missing"), share([x for x in ("float_pct",) if x in df.columns]).alias("float_missing"))
    return out.withColumn("ok", (F.col("n") >= min_rows) & (F.greatest("core_missing", "float_missing") <= max_missing))


def merge_fundamentals(base: DataFrame, store: DataFrame, fields: Sequence[str], key: str = "symbol") -> DataFrame:
    """base with each field from itself, else from the store's last row of the key. store: key, updated_at and fields."""
    last = store.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("updated_at"))).alias(f"_{f}") for f in fields])
    out = base.join(last, key, "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.col(f"_{f}")) if f in base.columns else F.col(f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def shift_period(day, period: str) -> F.Column:
    """The day a period such as 5d, 2w, 6mo or 1y earlier."""
    amount, unit = int("".join(x for x in period if x.isdigit()) or 1), "".join(x for x in period if x.isalpha()).lower()
    if unit in ("d", "w", "wk"):
        return F.date_sub(day, amount * (1 if unit == "d" else 7))
    if unit not in ("mo", "y"):
        raise ValueError(f"no period: {period}")
    return F.add_months(day, -amount * (12 if unit == "y" else 1))
