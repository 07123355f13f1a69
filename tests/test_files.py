"""Round trips and broken inputs of the file readers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.operators import liquidity
from tidepanel.sources import files


def test_long_and_wide_bars(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Ticker,Date,Close,High\na,2021-01-04,1.5,2\nb,bad,1,1\nb,2021-01-05,inf,x\n")
    rows = {(r.symbol, r.ts): (r.close, r.high, r.volume) for r in files.read_bars(spark, str(tmp_path / "long.csv")).collect()}
    assert rows == {("A", dt.date(2021, 1, 4)): (1.5, 2.0, None), ("B", dt.date(2021, 1, 5)): (None, None, None)}
    (tmp_path / "wide.tsv").write_text("date\tA_close\tA_volume\tB\tBRK_A\n2021-01-04\t1\t10\t2\t3\n2021-01-05\t\t\t4\t\n")
    rows = {(r.symbol, r.ts.day): (r.close, r.volume) for r in files.read_bars(spark, str(tmp_path / "wide.tsv")).collect()}
    assert rows == {("A", 4): (1.0, 10.0), ("B", 4): (2.0, None), ("BRK_A", 4): (3.0, None), ("B", 5): (4.0, None)}


def test_pairs_in_one_column_or_two(spark, tmp_path):
    (tmp_path / "one.csv").write_text("pair\nA-B\na/b\nC-C\nD\n")
    (tmp_path / "two.csv").write_text("Y,X\na,b\nA,B\nc,\n")
    for name in ("one.csv", "two.csv"):
        assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / name)).collect()] == [("A", "B")]


def test_volumes_universe_and_screener(spark, tmp_path):
    (tmp_path / "adv.csv").write_text("symbol,adv\na.b,10\na.b,20\nc,-1\nd,x\n")
    adv = files.read_adv(spark, str(tmp_path / "adv.csv"))
    files.write_adv(adv, str(tmp_path / "adv"))
    assert [tuple(r) for r in files.read_adv(spark, str(tmp_path / "adv")).collect()] == [("A-B", 20.0)]
    (tmp_path / "u.csv").write_text("Ticker,Start\na,2021-01-01\n ,2021-01-01\n")
    assert [tuple(r) for r in files.read_universe(spark, str(tmp_path / "u.csv")).collect()] == [("A", dt.date(2021, 1, 1), None)]
    (tmp_path / "s.csv").write_text('Symbol,Name,Market Cap\nx/y,Foo,"$1,200"\nx/y,Foo,1\nz,Bar,n/a\n')
    rows = {r.symbol: r.market_cap for r in files.read_screener(spark, str(tmp_path / "s.csv")).collect()}
    assert set(rows) == {"X-Y", "Z"} and rows["Z"] is None


def test_store_of_fundamentals(spark, tmp_path):
    store = files.Fundamentals(spark, str(tmp_path / "store"))
    day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=i)
    store.append(spark.createDataFrame([("A", day(0), 1.0), ("B", day(0), 5.0)], "symbol string, updated_at date, price double"))
    store.append(spark.createDataFrame([("A", day(9), 2.0, True)], "symbol string, updated_at date, price double, dividend boolean"))
    assert {r.symbol: (r.price, r.dividend) for r in store.latest().collect()} == {"A": (2.0, True), "B": (5.0, None)}
    assert [r.symbol for r in store.latest(5).collect()] == ["A"]


def test_reports_in_two_formats_and_pairs(spark, tmp_path):
    df = spark.createDataFrame([("B-C", 0.5), ("A-B", 0.7)], "pair string, corr double")
    files.write_both(df, str(tmp_path / "r"))
    assert files.read_table(spark, str(tmp_path / "r.csv")).count() == 2 == spark.read.parquet(str(tmp_path / "r.parquet")).count()
    files.write_pairs(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().pair == "A-B"


def test_costs_and_availability(spark):
    rows = spark.createDataFrame([(None, 10.0, 10.0), (2.0, 10.0, -20.0)], "size double, a double, b double")
    cost = [r[0] for r in rows.select(liquidity.event_cost(F.col("size"), F.col("a"), F.col("b"), 1.0, F.lit(0.01))).collect()]
    assert cost == [2.0, 2.6]
    legs = spark.createDataFrame([(5.0, None, 1.0, 1.0), (-5.0, None, None, 1.0), (None, -1.0, 9.0, None), (-1.0, None, 9.0, 9.0)], "notional double, units double, price double, adv double")
    assert [r.blocked for r in liquidity.short_blocked(legs, 5.0, 5.0).collect()] == [None, "missing_price", "missing_adv", None]


def test_plausibility(spark):
    rows = spark.createDataFrame([(float(i), float(i)) for i in range(1, 101)], "bps double, adv double")
    r = liquidity.plausibility(rows, 90.0, 0.05, 10.0, 80.0).first()
    assert abs(r.outlier_share - 0.1) < 1e-9 and abs(r.outlier_penalty - 500) < 1e-6 and r.decile_penalty > 0
