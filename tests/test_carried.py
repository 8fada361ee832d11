"""State between batches and streams whose files come in any order, against the batch operators."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.operators import series
from emberlake.streaming import carried


def T(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def parts(df, column, *cuts):
    edges = [None, *cuts, None]
    upto = lambda a, b: (F.lit(a is None) | (F.col(column) >= F.lit(a))) & (F.lit(b is None) | (F.col(column) < F.lit(b)))
    return [df.where(upto(a, b)) for a, b in zip(edges, edges[1:])]


def test_dry_spells_and_sums_go_on(spark):
    rng = np.random.default_rng(1)
    rows = [(c, T(i), float(rng.choice([0.0, 0.0, 0.0, 3.0])) if i % 11 else None) for c in (1, 2, 3) for i in range(40) if c < 3 or i > 20]
    df = spark.createDataFrame(rows, "city int, ts timestamp, rain double")
    dry = {(r.city, r.ts): round(r.dry_days, 9) for r in series.dry_spell(df, ["city"], "ts", "rain").collect()}
    total = {(r.city, r.ts): round(r.s, 9) for r in series.running_sum(df, ["city"], "ts", "rain", "s").collect()}
    states, got, sums = carried.States(spark), {}, {}
    batches = parts(df, "ts", T(13), T(14))
    for i in (0, 1, 1, 2):  # the second batch runs twice
        one = states.run("dry", i, batches[i], "city int, dry_hours double", lambda b, s: carried.dry_spell_step(b, s, "city", "ts", "rain"))
        got |= {(r.city, r.ts): round(r.dry_days, 9) for r in one.collect()}
        two = states.run("sum", i, batches[i], "city int, total double", lambda b, s: carried.sum_step(b, s, "city", "ts", "rain", "s"))
        sums |= {(r.city, r.ts): round(r.s, 9) for r in two.collect()}
    assert got == dry and sums == total


def test_places_go_on(spark):
    rng = np.random.default_rng(2)
    walk = {k: np.cumsum(rng.choice([0, 20, 35, 400], 30)) / 111_195 for k in (1, 2, None)}
    rows = [(k, 2000 + i, float(y), 0.0) for k, w in walk.items() for i, y in enumerate(w)]
    df = spark.createDataFrame(rows, "s long, y int, lat double, lon double")
    want = {}
    for k, w in walk.items():  # a plain fold
        at, version = w[0], 1
        for i, y in enumerate(w):
            d = abs(y - at) * 111_194.92664455873
            event = d > 50
            version += event
            want[k, 2000 + i] = (version, bool(event), bool(event and d >= 500))
            at = y if event else at
    as_rows = lambda d: {(r.s, r.y): (r.version, r.event, r.alert) for r in d.collect()}
    assert as_rows(series.anchored_drift(df, "s", "y", "lat", "lon")) == want
    whole = df.where("s IS NOT NULL")
    states, got = carried.States(spark), {}
    for i, b in enumerate(parts(whole, "y", 2007, 2008, 2020)):
        got |= as_rows(states.run("places", i, b, "s long, lat double, lon double, version int", lambda b, s: carried.place_step(b, s, "s", "y", "lat", "lon")))
    assert got == {k: v for k, v in want.items() if k[0] is not None}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_stream_in_any_order_equals_batch(spark, tmp_path, kind):
    """Three files, the newest read first, rows of equal time, nulls, and rows without a time."""
    rows = [(i * 2 + c, c, T(i // 2), None if i % 7 == 2 else float(i * c % 11)) for i in range(30) for c in (1, 2)]
    df = spark.createDataFrame([*rows, (900, 1, None, 1.0)], "id int, city int, ts timestamp, x double").withColumn("ts", F.col("ts").cast(kind))
    for n, (a, b) in enumerate(((10, 20), (5, 10), (0, 5))):
        df.where((F.col("ts") >= F.lit(T(a))) & (F.col("ts") < F.lit(T(b)))).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for f in os.listdir(f"{tmp_path}/in/{n}"):
            os.utime(f"{tmp_path}/in/{n}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    df.where("ts IS NULL").coalesce(1).write.parquet(f"{tmp_path}/in/3")
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    marks, close = carried.closing(spark)
    out = carried.replay(carried.feature_stream(src, "city", "ts", "x", tie="id", alpha=0.4, lag=3, delay="2 days", marks=marks), "features", close)
    got = {r.id: (r.city, None if r.ewma is None else round(r.ewma, 9), r.lagged) for r in out.collect()}
    # times that differ stand for the order of time and id
    known = df.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 1000))
    batch = series.ewma(series.lags(known, ["city"], "ts", "x", [3]), ["city"], "ts", "x", {"e": 0.4})
    want = {r.id: (r.city, None if r.e is None else round(r.e, 9), r.x_lag_3) for r in batch.collect()}
    assert got == want and len(got) == 60 and dict(out.dtypes)["ts"] == kind


def test_late_rows_are_left_out_and_others_wait(spark, tmp_path):
    df = spark.createDataFrame([(1, T(h), float(h)) for h in (0, 10, 20, 2, 19)], "k int, t timestamp, v double")
    for n, hours in enumerate(((0, 10), (20,), (2, 19))):  # the last file comes after the watermark has passed hour 10
        df.where(F.hour("t").isin(*hours)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        for f in os.listdir(f"{tmp_path}/in/{n}"):
            os.utime(f"{tmp_path}/in/{n}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    features = carried.feature_stream(src, "k", "t", "v", alpha=0.5, lag=1, delay="10 hours")
    assert [r.v for r in carried.replay(features, "waiting").orderBy("t").collect()] == [0.0, 10.0]
    marks, close = carried.closing(spark)
    closed = carried.replay(carried.feature_stream(src, "k", "t", "v", alpha=0.5, lag=1, delay="10 hours", marks=marks), "closed", close)
    assert [(r.v, r.lagged) for r in closed.orderBy("t").collect()] == [(0.0, None), (10.0, 0.0), (19.0, 10.0), (20.0, 19.0)]


def test_places_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    import compare
    import duckdb

    from emberlake.plans import catalog

    # means that end in half a thousandth: sums of fractions fall to either side of it
    rng = np.random.default_rng(9)
    rows = []
    for s in range(200):
        for y in range(1995, 1999):
            d = rng.integers(0, 11, 40)
            while d.sum() % 4 != 2:
                d = rng.integers(0, 11, 40)
            rows += [(s, dt.datetime(y, 1, 1), int(c) / 100, int(c) / 200 if c % 2 == 0 else 0.01) for c in d]
    want = {}
    for s, t, a, b in rows:
        n, p, q = want.get((s, t.year), (0, 0, 0))
        want[s, t.year] = (n + 1, p + round(a * 100), q + round(b * 100))
    want = {k: (-15 + (20 * p + n) // (2 * n) / 10000, -47 + (20 * q + n) // (2 * n) / 10000) for k, (n, p, q) in want.items()}
    names = "l_suppkey long, l_shipdate timestamp, l_discount double, l_tax double"
    for i in range(2):
        order = rng.permutation(len(rows))
        spark.createDataFrame([rows[j] for j in order], names).coalesce(1 + i).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert {(r.station, r.year): (r.lat, r.lon) for r in catalog._yearly_places(spark, f"{tmp_path}/{i}").collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/1/lineitem.parquet/*.parquet')")
    assert compare.compare(catalog.QUERIES["drift"](spark, f"{tmp_path}/0"), con, catalog.ORACLE_SQL["drift"]) == ""


def test_waiting_rows_are_held_a_slot_at_a_time(spark, tmp_path):
    """Two days of one key in slots of an hour, out of order: each frame of results comes from one slot only."""
    rows = [(i, 1, T(0) + dt.timedelta(seconds=(i * 7919) % 172_800), float(i % 13)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, city int, ts timestamp, x double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    outs = []
    for slot in (3_600_000_000, 10**15):
        marks, close = carried.closing(spark)
        out = carried.replay(carried.feature_stream(src, "city", "ts", "x", tie="id", alpha=0.4, lag=3, delay="90 days", marks=marks, slot=slot), "slots", close)
        outs.append(sorted(out.select("id", "ewma", F.coalesce("lagged", F.lit(-1.0))).collect()))
    assert outs[0] == outs[1] and len(outs[0]) == 4000
