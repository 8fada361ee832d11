"""Segmented scans against windows over whole series: one key in all partitions, null keys, ties, helper names, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlake.operators import joins, scans, series

NAMES = "k string, t int, x double, _part string, _key int, _tie int, _past int, _rank int, _at int, _sum int, _before int"


def rows(spark, n=400):
    made = [(None if i % 9 == 4 else "hot" if i % 3 else f"k{i % 5}", i * 7919 % n, None if i % 4 == 1 or i < 30 else float(i % 13), "p", 1, 2, 3, 4, 5, 6, 7) for i in range(n)]
    return spark.createDataFrame(made, NAMES)


def same(got, want):
    assert got.columns == want.columns
    order = lambda d: sorted(([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in d.collect()), key=repr)
    assert order(got) == order(want)


@pytest.mark.parametrize("by", [["k"], []])
def test_scans_equal_windows(spark, by):
    df = rows(spark)
    w = Window.partitionBy(*by).orderBy("t")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-5, -1)
    same(series.running_sum(df, by, "t", "x", "s"), df.withColumn("s", F.sum(F.coalesce("x", F.lit(0.0))).over(upto)))
    same(series.forward_fill(df, by, "t", ["x"]), df.withColumn("x", F.last("x", ignorenulls=True).over(upto)))
    same(series.lags(df, by, "t", "x", [1, 150]), df.withColumns({f"x_lag_{k}": F.lag("x", k).over(w) for k in (1, 150)}))
    full = F.count("x").over(past) == 5
    want = {"x_win_mean": F.avg("x").over(past), "x_win_range": F.max("x").over(past) - F.min("x").over(past), "x_win_change": F.last("x").over(past) - F.first("x").over(past)}
    same(series.window_stats(df, by, "t", "x", 5), df.withColumns({n: F.when(full, c) for n, c in want.items()}))
    for policy in ("reset", "hold"):
        wet = F.coalesce((F.col("x") >= 11).cast("int"), F.lit(int(policy == "reset")))
        islands = df.withColumn("i", F.sum(wet).over(upto))
        dry = F.sum(1 - wet).over(Window.partitionBy(*by, "i").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) / 24.0
        same(series.dry_spell(df, by, "t", "x", 11, policy), islands.withColumn("dry_days", dry).drop("i"))


def test_ties_repeat(spark):
    df = spark.createDataFrame([("k", i % 3, float(i), i) for i in range(60)], "k string, t int, x double, id int")
    runs = [sorted((r.id, r.s) for r in series.running_sum(df.repartition(n), ["k"], "t", "x", "s").collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and max(s for _, s in runs[0]) == sum(range(60))


def test_more_rows_take_more_ranges(spark):
    df = spark.range(1000)
    assert scans.ranges(df) == 4 and scans.ranges(df, 100) == 10


def test_empty_tables(spark):
    df = rows(spark).limit(0)
    for out in (series.running_sum(df, ["k"], "t", "x", "s"), series.lags(df, ["k"], "t", "x", [2]), series.dry_spell(df, ["k"], "t", "x"), series.window_stats(df, ["k"], "t", "x", 3), series.forward_fill(df, ["k"], "t", ["x"])):
        assert out.count() == 0


def test_as_of_over_a_hot_and_a_null_key(spark):
    df = rows(spark, 200).select("k", "t", F.col("t").alias("_side"))
    past = spark.createDataFrame([(k, i * 10, float(i) if i % 3 else None, i) for k in ("hot", None, "k1") for i in range(12)], "k string, t int, v double, o int")
    known = [(r.k, r.t, r.v) for r in past.orderBy("t").collect()]
    for fill in (True, False):
        got = joins.as_of(df, past, ["k"], "t", ["v"], ["o"], fill).collect()
        assert len(got) == 200
        for r in got:
            before = [v for k, t, v in known if k == r.k and t <= r.t]
            before = [v for v in before if v is not None] if fill else before
            assert r.v == (before[-1] if before else None), r


def test_joins_take_helper_names(spark):
    left = spark.createDataFrame([(1, 5, 6)], "k int, matched int, _hit int")
    right = spark.createDataFrame([(1, 2.5)], "k int, v double")
    assert [tuple(r) for r in joins.join_m1(left.withColumnRenamed("matched", "m"), right, ["k"]).collect()] == [(1, 5, 6, 2.5, True)]
    assert [tuple(r) for r in joins.lookup_with_fallback(left.withColumnRenamed("matched", "own"), right, ["k"], {"v": "own"}).collect()] == [(1, 2.5, 6, "dimension")]
    points = spark.createDataFrame([(1, 0.0, 0.0, 7, 8, 9)], "d int, la double, lo double, _b int, _by int, _times int")
    grid = spark.createDataFrame([(1, 0.1, 0.0, "v")], "d int, la double, lo double, v string")
    got = joins.nearest_cell(points, grid, day="d", lat="la", lon="lo", value="v", step=1.0, tolerance=0.5)
    assert [tuple(r) for r in got.collect()] == [(1, 0.0, 0.0, 7, 8, 9, "v")]


def test_dense_periods(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d, 5)
    df = spark.createDataFrame([("a", at(1), 1.0), ("a", at(4), 3.0), (None, at(7), 5.0), (None, at(8), 7.0), ("b", None, 1.0)], "k string, t timestamp, x double")
    days = series.resample_mean(df, ["k"], "t", ["x"], dense=True).collect()
    assert {(r.k, r.period.day, r.x) for r in days} == {("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 3.0), (None, 7, 5.0), (None, 8, 7.0)}
    weeks = series.resample_mean(df, [], "t", ["x"], "week", dense=True).collect()  # 7 and 14 January are Sundays
    assert [(r.period.day, r.x) for r in sorted(weeks)] == [(7, 3.0), (14, 7.0)]
