"""Hand-made cases: nulls, ties, gaps, repeated keys, and independence of partitioning."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.functions import scalars, text
from emberlake.operators import embedding, forecast, joins, models, profiles, sampling, selection, series, stats
from emberlake.sources import tables
from emberlake.storage import shared_root


def T(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def test_text_keys(spark):
    rows = [("  São João d’Aliança ", "sao joao d alianca"), (None, ""), ("STRAẞE--7", "strasse 7"), ("ﬁm\t\x07x", "fim x")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "s string")
    assert [r[0] for r in df.select(text.normalize_key(F.col("s"))).collect()] == [b for _, b in rows]


@pytest.mark.parametrize("raw,hour", [("0100 UTC", 1), ("0200", 2), ("7", 7), ("7:00", 7), ("07:00", 7), ("12:34", 12), ("", 0), (None, 0), ("x", 0), ("2900", 23)])
def test_hours(spark, raw, hour):
    assert spark.createDataFrame([(raw,)], "s string").select(scalars.parse_hour(F.col("s"))).first()[0] == hour


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("1,5",), ("-9999",), (" ",), (None,), ("abc",), ("-999.0",), ("NaN",)], "s string")
    assert [r[0] for r in df.select(scalars.number(F.col("s"))).collect()] == [1.5] + [None] * 6


def test_label_and_ties(spark):
    ev = spark.createDataFrame([(1, T(0), 5.0, 2), (1, T(0), 5.0, 1), (1, T(0), None, 0), (2, T(0), None, 9)], "city int, hour timestamp, power double, id long")
    best = joins.strongest(ev, ["city", "hour"], "power", "id")
    assert {(r.city, r.id) for r in best.collect()} == {(1, 1), (2, 9)}
    obs = spark.createDataFrame([(1, T(0)), (1, T(1)), (3, T(0))], "city int, hour timestamp")
    assert sorted((r.city, r.has_event) for r in joins.label_observations(obs, best, ["city", "hour"], "id").collect()) == [(1, 0), (1, 1), (3, 0)]


def test_contract_is_checked(spark):
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(joins.NotUnique):
        joins.join_m1(right.select("k"), right, ["k"])


def test_dry_spell_policies(spark):
    rain = [0.0, 2.0, 0.0, None, 0.5, 1.0, 0.0]
    df = spark.createDataFrame([(1, T(i), r) for i, r in enumerate(rain)], "city int, ts timestamp, rain double")
    run = lambda p: [round(r.dry_days * 24) for r in series.dry_spell(df.repartition(3), ["city"], "ts", "rain", 1.0, p).orderBy("ts").collect()]
    assert run("reset") == [1, 0, 1, 0, 1, 0, 1]
    assert run("hold") == [1, 0, 1, 2, 3, 0, 1]


def test_ewma_nulls(spark):
    import pandas as pd

    x = [None, 1.0, None, None, 4.0, 2.0, None, 8.0]
    df = spark.createDataFrame([(1, T(i), v) for i, v in enumerate(x)], "city int, ts timestamp, x double")
    got = [r.e for r in series.ewma(df, ["city"], "ts", "x", {"e": 0.3}).orderBy("ts").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False, ignore_na=False).mean()
    assert got[0] is None and np.allclose(got[1:], want[1:])


def test_drift_keeps_anchor(spark):
    lat = [0.0, 40 / 111_195, 80 / 111_195, 80 / 111_195, 700 / 111_195]
    df = spark.createDataFrame([(1, 2000 + i, y, 0.0) for i, y in enumerate(lat)], "s long, y int, lat double, lon double")
    got = [(r.version, r.event, r.alert) for r in series.anchored_drift(df, "s", "y", "lat", "lon").orderBy("y").collect()]
    assert got == [(1, False, False), (1, False, False), (2, True, False), (2, False, False), (3, True, True)]


def test_as_of_ties_and_gaps(spark):
    rows = spark.createDataFrame([(1, T(i)) for i in range(4)] + [(2, T(0))], "k int, ts timestamp")
    ser = spark.createDataFrame([(1, T(1), 1.0, 0), (1, T(1), 2.0, 1), (1, T(2), None, 2)], "k int, ts timestamp, v double, o int")
    one = lambda fill: [r.v for r in joins.as_of(rows, ser, ["k"], "ts", ["v"], ["o"], fill).orderBy("k", "ts").collect()]
    assert one(True) == [None, 2.0, 2.0, 2.0, None]
    assert one(False) == [None, 2.0, None, None, None]


def test_inputs_may_have_the_names_of_helper_columns(spark):
    rows = spark.createDataFrame([(1, 10, 7, 8, 9, 5), (1, 20, 7, 8, 9, 6)], "k long, t long, _side int, _v int, _rank int, _row int")
    past = spark.createDataFrame([(1, 5, 1.5, 3), (1, 15, None, 4)], "k long, t long, v double, _rank int")
    for fill, want in ((True, 1.5), (False, None)):
        got = joins.as_of(rows, past, ["k"], "t", ["v"], ["_rank"], fill).orderBy("t").collect()
        assert [tuple(r) for r in got] == [(1, 10, 7, 8, 9, 5, 1.5), (1, 20, 7, 8, 9, 6, want)]
    assert [tuple(r) for r in series.latest(past, ["k"], ["t"]).collect()] == [(1, 15, None, 4)]
    wet = spark.createDataFrame([(1, 1, 2.0, 5, 6), (1, 2, 0.0, 5, 6)], "k long, t long, rain double, _wet int, _island int")
    assert [tuple(r) for r in series.dry_spell(wet, ["k"], "t", "rain").orderBy("t").collect()] == [(1, 1, 2.0, 5, 6, 0.0), (1, 2, 0.0, 5, 6, 1 / 24)]


def test_impute_ties_and_partitions(spark):
    rng = np.random.default_rng(3)
    data = [(i, *[None if rng.random() < 0.3 else float(v) for v in rng.integers(0, 4, 3)]) for i in range(60)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    out = [sorted(tuple(r) for r in sampling.knn_impute(df.repartition(n), ["a", "b", "c"], df, ["id"], 3).collect()) for n in (1, 5)]
    assert out[0] == out[1]
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in data])
    for i, row in enumerate(x):
        for j in np.flatnonzero(np.isnan(row)):
            both = ~np.isnan(row) & ~np.isnan(x)
            n = both.sum(1)
            d = np.where(n > 0, np.sqrt(np.where(both, (x - row) ** 2, 0).sum(1) * 3 / np.maximum(n, 1)), np.inf)
            d[np.isnan(x[:, j])] = np.inf
            near = [k for k in np.argsort(d, kind="stable")[:3] if np.isfinite(d[k])]
            want = x[near, j].mean() if near else np.nanmean(x[:, j])
            assert abs(out[0][i][j + 1] - want) < 1e-12


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 50 == 0).cast("int")).withColumn("g", F.col("id") % 3)
    for f in (lambda d: sampling.downsample(d, "y", ["id"], 2.0), lambda d: sampling.proportional_sample(d, ["g"], ["id"], 90), lambda d: sampling.stride_sample(d, ["id"], 100)):
        a, b = (sorted(r.id for r in f(df.repartition(n)).collect()) for n in (2, 7))
        assert a == b and 0 < len(a) < 1000


def test_first_by_hash_equals_a_sort(spark):
    from pyspark.sql import Window

    df = spark.range(4000).withColumn("g", F.when(F.col("id") % 5 > 0, F.col("id") % 5)).withColumn("k", F.col("id") % 1300)
    quotas = spark.createDataFrame([(None, 17), (1, 0), (2, 5000), (3, 400)], "g long, _quota long")
    got = sampling.first_by_hash(df, ["g"], ["k", "id"], quotas)
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*sampling.hash_order(["k", "id"]))))
    want = {r.id for r in ranked.join(quotas, ranked.g.eqNullSafe(quotas.g)).where("r <= _quota").collect()}
    assert {r.id for r in got.collect()} == want and got.count() == 17 + 800 + 400
    one = sampling.first_by_hash(df, [], ["id"], spark.createDataFrame([(123,)], "_quota int"))
    assert one.count() == 123 and one.columns == df.columns
    same = spark.createDataFrame([(1,)] * 50, "id int")  # ties: as many as asked
    assert sampling.first_by_hash(same, [], ["id"], spark.createDataFrame([(7,)], "_quota int")).count() == 7


def test_nearest_cell_keeps_repeated_points(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 9.0, 9.0)], "d int, la double, lo double")
    grid = spark.createDataFrame([(1, 0.9, 0.0, "far"), (1, 5.0, 5.0, "none")], "d int, gla double, glo double, v string").withColumnsRenamed({"gla": "la", "glo": "lo"})
    near = joins.nearest_cell(points, grid, day="d", lat="la", lon="lo", value="v", step=0.25, tolerance=1.0)  # four buckets away
    assert sorted((r.la, r.v or "") for r in near.collect()) == [(0.0, "far"), (0.0, "far"), (9.0, "")] and near.columns == [*points.columns, "v"]


def test_method_ranking_and_years(spark):
    q = spark.createDataFrame([("a", 1, 1, 3, 1.0, 2.0, 0.5), ("a", 1, 2, 3, 3.0, 4.0, None), ("b", 1, 1, 3, 1.0, 1.0, 0.9)], "m string, y int, c int, n long, mae double, mse double, r2 double")
    roll = stats.quality_rollup(q, ["m", "y"], "c")
    assert {(r.m, r.n_entities, r.mae, r.r2) for r in roll.collect()} == {("a", 2, 2.0, 0.5), ("b", 1, 1.0, 0.9)}
    assert [r.m for r in stats.method_ranking(roll, "m").orderBy("place").collect()] == ["b", "a"]
    t = lambda *years: spark.createDataFrame([(y,) for y in years], "y int")
    rows = profiles.year_alignment(t(1, 1, 2, 3), {"x": t(1, 2, 2, 4)}, "y").collect()
    assert {(r.year, r.status) for r in rows} == {(1, "FEWER"), (2, "MORE"), (3, "ONLY_IN_BASE"), (4, "ONLY_IN_TABLE")}


def test_smote_lies_between(spark):
    df = spark.createDataFrame([(i, float(i % 5), 0.0, int(i < 6)) for i in range(200)], "id int, x double, y double, t int")
    out = sampling.smote(df, "t", ["x", "y"], ["id"], 0.2)
    made = out.where("t = 1").collect()
    assert len(made) >= int(0.2 * 194) and all(0 <= r.x <= 4 and r.y == 0 for r in made)


def test_folds_and_holdout(spark):
    df = spark.createDataFrame([(2000 + i, int(i != 5)) for i in range(8)], "year int, y int")
    assert {r.fold for r in sampling.year_folds(df, "year", "y", 3).collect()} == {1, 2, 3}
    split = {r.year: r.split for r in sampling.holdout(df, "year", 2, gap=1).collect()}
    assert split[2007] == "test" and 2005 not in split and split[2004] == "train"
    assert {r.split for r in sampling.holdout(df.where("year < 2002"), "year", 2).collect()} == {"train"}


def test_metrics_against_loops(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    m = stats.ranking_metrics(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "p double, y int"), "p", "y").first()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        r = (y[s >= t] == 1).sum() / (y == 1).sum()
        ap += (r - last) * y[s >= t].mean()
        last = r
    assert abs(m.roc_auc - auc) < 1e-9 and abs(m.average_precision - ap) < 1e-9


def test_p_values():
    assert abs(stats.t_tail(0.5, 20) - 0.02479) < 1e-4 and stats.t_tail(1.0, 9) == 0.0 and stats.t_tail(None, 9) is None
    assert abs(stats.t_tail(0.0, 9) - 1) < 1e-9


def test_greedy_selection():
    c = {("a", "b"): 0.9, ("b", "a"): 0.9}
    assert selection.greedy(["a", "b", "c", "d"], c, 2) == (["a", "c"], ["b"])


def test_forecast_protocol(spark):
    rows = [(1, T(i), float(np.sin(i / 4) + 0.1 * i), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, y double, x double")
    out = forecast.rolling_forecast(df, ["k"], "ts", "y", ["x"], horizon=10, history=60, least=30, lags=(1, 2)).orderBy("ts").collect()
    assert [r.status for r in out[:30]] == ["skipped"] * 30 and all(r.status == "ok" for r in out[30:])
    assert np.mean([abs(r.residual) for r in out[30:]]) < 1.0


def test_embedding_windows(spark):
    df = spark.createDataFrame([(1, T(i), float(i % 5), None if i == 30 else 1.0) for i in range(60)], "k int, ts timestamp, a double, b double")
    out = embedding.embed(df, ["k"], "ts", ["a", "b"], length=12).orderBy("ts").collect()
    whole = [r.embedding is not None for r in out]
    assert whole[:12] == [False] * 12 and whole[12:31] == [True] * 19 and not any(whole[31:43]) and all(whole[43:])
    assert all(0 <= v <= 1 for v in out[12].embedding)
    with pytest.raises(ValueError):
        embedding.embed(df, ["k"], "ts", ["a"])


def test_models_learn(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), int(a + b > 1.1), 2000 + i % 6) for i, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, year int")
    split = sampling.holdout(df, "year", 2)
    out = {r.model: r.roc_auc for r in models.experiment(split, "F", ["logistic", "svm", "boosted"], ["a", "b"], "y").collect()}
    assert all(v > 0.9 for v in out.values())
    best, scores = models.grid_search("logistic", df, sampling.year_folds(df, "year", "y", 2), "year", ["a", "b"], "y")
    assert [x["C"] for x, _ in scores] == [0.01, 0.1, 1, 10] and best.importances()[0][1] > 0  # the whole grid
    assert models.evaluate(models.baseline(df, "y", ["id"], "stratified"), "y").count() == 1
    svm = models.train("svm", df, ["a", "b"], "y", time="year")
    assert svm.params["C"] in models.GRIDS["svm"]["C"]
    assert models.evaluate(svm.score(df), "y").first().roc_auc > 0.9


def test_variations_of_an_experiment(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + b > 1.6), 2000 + i % 6) for i, (a, b) in enumerate(rng.random((500, 2)))]
    split = sampling.holdout(spark.createDataFrame(rows, "id int, a double, b double, y int, year int"), "year", 2)
    store = f"{tmp_path}/best"
    run = lambda: models.experiment(split, "F", ["logistic"], ["a", "b"], "y", year="year", keys=["id"], variations=models.VARIATIONS[:2], store=store).collect()
    out = run()
    assert [r.variation for r in out] == [v[0] for v in models.VARIATIONS[:2]] and all(r.roc_auc > 0.9 and r.n_test == 166 for r in out)
    assert models.load_best(spark, store, models.cache_key("logistic", "F", "fast/gridsearch_smote_weight", models.FAST_GRIDS["logistic"])) is not None
    assert models.load_best(spark, f"{tmp_path}/none", "x") is None
    assert [r.params for r in run()] == [r.params for r in out] and spark.read.parquet(store).count() == 1  # nothing was searched again
    assert len(models.settings(models.GRIDS["forest"])) == 18 and len(models.settings(models.GRIDS["boosted"])) == 48
    assert models.cache_key("svm", "F", "weight").startswith("svm/F/weight/")


def test_scalars_keep_unknown_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, None, None), (1, nan, -3), (2, inf, 7), (3, 0.5, 0), (4, -inf, 1 << 40)], "id int, x double, n long")
    x, zero = F.col("x"), F.lit(0.0)
    row = df.select("id", scalars.sanitize(x).alias("clean"), scalars.sigmoid(x).alias("p"), scalars.haversine(x, zero, zero, zero).alias("m"), scalars.label_01(F.col("n"), "int").alias("y"))
    out = sorted(row.collect())
    assert [r.clean for r in out] == [None, None, 1e15, 0.5, -1e15] and [r.y for r in out] == [0, 0, 1, 0, 1]
    assert out[0].p is None and out[1].p != out[1].p and out[2].p == pytest.approx(1) and out[0].m is None and out[1].m != out[1].m
    assert out[3].m == pytest.approx(55597.5, rel=1e-4)
    # gaps count as gaps in the screen, and a feature with too many goes
    t = df.selectExpr("explode(sequence(1, 40)) AS k", "id", "n").selectExpr("k * 10 + id AS key", "CASE WHEN id = 2 THEN k END AS gappy", "double(id + k) AS full", "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS y")
    picked = selection.select_features(t, ["gappy", "full"], "y", ["key"], 2)
    assert [(r.feature, r.gap_share) for r in picked.collect()] == [("full", 0.0)]


def test_sources(spark, tmp_path):
    head = "REGIAO;CO\r\nUF;GO\r\nESTACAO;São João\r\nCODIGO;A1\r\nLATITUDE;-15,5\r\nLONGITUDE;-47,1\r\nALT;1\r\nFUND;2000\r\nData;Hora;Chuva;\r\n"
    (tmp_path / "a.csv").write_bytes((head + "2020/01/01;0100 UTC;1,5;\r\n2020/01/01;0200 UTC;-9999;\r\nbad\r\n").encode("latin1"))
    rows = tables.read_stations(spark, str(tmp_path / "a.csv")).orderBy("Hora").collect()
    assert [(r.city, r.lat, r.Chuva) for r in rows] == [("São João", "-15,5", "1,5"), ("São João", "-15,5", "-9999")]
    (tmp_path / "st").mkdir()
    days = "".join(f"2020/01/{i % 28 + 1:02d};{i % 24:02d}00 UTC;{i};\r\n" for i in range(3000))
    (tmp_path / "st" / "big.csv").write_bytes((head.replace("São João", "Ipê") + days).encode("latin1"))
    (tmp_path / "st" / "other.csv").write_bytes((head.replace("Chuva", "Vento") + "2020/01/01;0100 UTC;7;\r\n").encode("latin1"))
    (tmp_path / "st" / "short.csv").write_bytes(head[:40].encode("latin1"))
    (tmp_path / "st" / "empty.csv").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # a header then stands in several blocks
    try:
        rows = tables.read_stations(spark, str(tmp_path / "st"), drop=("Hora",))
        assert set(rows.columns) == {"city", "lat", "lon", "Data", "Chuva", "Vento"} and rows.rdd.getNumPartitions() > 4
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r.Chuva) for r in got if r.city == "Ipê") == list(range(3000))
    assert [(r.city, r.Chuva, r.Vento) for r in got if r.city != "Ipê"] == [("São João", None, "7")]
    (tmp_path / "e.csv").write_bytes("Municipio,FRP\nGoiânia,1.5\nbad\n".encode("latin1"))
    (tmp_path / "f.csv").write_bytes("Municipio,FRP,Id\nBrasília,2,7\n".encode())
    ev = tables.read_events(spark, [str(tmp_path / "e.csv"), str(tmp_path / "f.csv")])
    assert {(r.Municipio, r.FRP, r.Id) for r in ev.collect()} == {("Goiânia", "1.5", None), ("Brasília", "2", "7")}
    assert set(ev.columns) == {"Municipio", "FRP", "Id"}
    assert tables.column_of(ev, ["frp"]) == "FRP" and tables.column_of(ev, ["none"], required=False) is None
    run = tmp_path / "r" / "forest" / "base" / "D"
    run.mkdir(parents=True)
    (run / "metrics_1.json").write_text('{"timestamp": "1", "metrics": {"f1": 0.5}}')
    m = tables.read_metrics(spark, str(tmp_path / "r")).first()
    assert (m.model, m.variation, m.scenario, m.f1) == ("forest", "base", "D", 0.5)
    df = spark.createDataFrame([(2000, 1), (2001, 2)], "year int, v int")
    tables.write_yearly(df, str(tmp_path / "y"))
    tables.write_yearly(spark.createDataFrame([(2001, 5)], "year int, v int"), str(tmp_path / "y"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "y")).select("year", "v").collect()) == [(2000, 1), (2001, 5)]
    got, lacking = tables.read_columns(spark, str(tmp_path / "y"), ["v", "w"], as_float=True)
    assert got.dtypes == [("v", "float")] and lacking == ["w"]
    tables.append_issues(spark.createDataFrame([("t", "s", "i", "warn", "m")], "at string, stage string, item string, severity string, message string"), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1


def test_events_are_read_by_lines(spark, tmp_path):
    """Quoted commas, a byte-order mark, names with commas, CRLF, Latin-1 with a valid line first, and blocks of a few bytes."""
    (tmp_path / "a.csv").write_bytes('\ufeffId,"Lat, Lon",City\r\n1,"-1,5",Belém\r\n\r\n2,"x ""y"", z",\r\n3,too,many,fields\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("City,Id\nplain,4\nSão,5\nCity,Id\n".encode("latin1"))
    (tmp_path / "c.csv").write_bytes(b"")
    for size in ("128m", "8b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {(r["Id"], r["Lat, Lon"], r["City"]) for r in tables.read_events(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {("1", "-1,5", "Belém"), ("2", 'x "y", z', None), ("4", None, "plain"), ("5", None, "São")}


def test_feature_sets_and_months(spark):
    df = spark.createDataFrame([(1, 1, 2.0, None), (2, 1, 1.0, 4.0), (3, 2, None, 5.0), (4, None, 3.0, 6.0)], "id int, month int, a double, tsf_b double")
    assert selection.feature_columns(df, ["a", "zz"], {"points": ["month"]}, "points") == ["a", "tsf_b", "month"]
    assert selection.feature_columns(df, ["a"], {"points": ["month"]}, "slow_only") == ["month"]
    out = {r.id: (r.a, r.tsf_b) for r in sampling.impute_by_month(df, ["a", "tsf_b"], "month", ["id"], k=1, least=2).collect()}
    assert out[1] == (2.0, 4.0) and out[3] == (3.0, 5.0) and out[4] == (3.0, 6.0)


def test_ewma_over_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(k, T(i), None if rng.random() < 0.4 or (k == 2 and i < 150) else float(rng.random())) for k in (None, 1, 2) for i in range(200)] + [(7, T(0), None)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, x double").withColumn("_part", F.lit("own"))
    got = series.ewma(df, ["k"], "ts", "x", {"e": 0.3, "f": 0.9}).collect()
    assert len(got) == len(rows) and all(r._part == "own" for r in got)
    for k in (None, 1, 2, 7):
        mine = sorted((r.ts, r.x, r.e, r.f) for r in got if r.k == k) if k != 7 else [(r.ts, r.x, r.e, r.f) for r in got if r.k == 7]
        for i, a in ((2, 0.3), (3, 0.9)):
            y, w = None, 1.0
            for r in mine:
                if y is not None:
                    w *= 1 - a
                if r[1] is not None:
                    y, w = (r[1], 1.0) if y is None else ((w * y + a * r[1]) / (w + a), 1.0)
                assert (r[i] is None) == (y is None) and (y is None or abs(r[i] - y) < 1e-12)
    assert series.ewma(df.limit(0), ["k"], "ts", "x", {"e": 0.3}).count() == 0


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(k, T(i), float(np.sin(i / 4) + 0.1 * rng.random()), None if i % 41 == 5 else float(rng.random())) for k in (None, 1) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, y double, x double")
    f = lambda n: sorted((str(r.k), r.ts, r.status, r.predicted) for r in forecast.rolling_forecast(df, ["k"], "ts", "y", ["x"], horizon=10, history=40, least=20, lags=(1, 2), block_rows=n).collect())
    assert f(40) == f(4096) and len(f(40)) == 300
    e = lambda n: sorted((str(r.k), r.ts, r.embedding) for r in embedding.embed(df, ["k"], "ts", ["y", "x"], length=12, block_rows=n).collect())
    assert e(12) == e(4096) and len(e(12)) == 300
    assert forecast.rolling_forecast(df.limit(0), ["k"], "ts", "y", ["x"]).count() == 0 and embedding.embed(df.limit(0), ["k"], "ts", ["y", "x"]).count() == 0


def test_nearest_mutual_information(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.3).astype(int)
    a, b = rng.random(300) + 0.5 * y, rng.random(300)
    rows = [(i, float(u), float(v), None, int(c)) for i, (u, v, c) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, none double, y int")
    got = {r.feature: r.mutual_information for r in stats.nearest_mutual_information(df, ["a", "b", "none"], "y", ["id"]).collect()}
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    for name, x in (("a", a), ("b", b)):
        inside = []
        for i in range(300):
            radius = np.sort(np.abs(x[y == y[i]] - x[i]))[3]
            inside.append(int((np.abs(x - x[i]) < radius).sum()))
        want = psi(300) + psi(3) - np.mean([psi(int((y == c).sum())) for c in y]) - np.mean([psi(max(n, 1)) for n in inside])
        assert abs(got[name] - max(0.0, want)) < 1e-7
    assert got["a"] > 0.05 > got["b"] and got["none"] < 0.05
    # a class of two has one neighbour, a class of one does not count, nothing is scored without rows
    few = spark.createDataFrame([(i, float(i * i % 17), c) for i, c in enumerate([0] * 20 + [1] * 2 + [2])], "id int, a double, y int")
    x, y = np.array([i * i % 17 for i in range(22)], float), np.array([0] * 20 + [1] * 2)
    few = few.withColumn("a", F.col("a") + F.col("id") / 1000)
    x += np.arange(22) / 1000
    inside, near = [], []
    for i in range(22):
        near.append(min(3, int((y == y[i]).sum()) - 1))
        radius = np.sort(np.abs(x[y == y[i]] - x[i]))[near[-1]]
        inside.append(max(1, int((np.abs(x - x[i]) < radius - 1e-12).sum())))
    want = psi(22) + np.mean([psi(n) for n in near]) - np.mean([psi(int((y == c).sum())) for c in y]) - np.mean([psi(n) for n in inside])
    assert abs(stats.nearest_mutual_information(few, ["a"], "y", ["id"]).first()[1] - max(0.0, want)) < 1e-6
    assert [tuple(r) for r in stats.nearest_mutual_information(few.limit(0), ["a"], "y", ["id"]).collect()] == [("a", 0.0)]


def test_period_p_values(spark):
    df = spark.createDataFrame([(1, T(24 * i), i % 3, float(i * i % 7), None) for i in range(20)], "k int, ts timestamp, y int, x double, z double")
    r = {q.variable: q for q in stats.period_correlation(df, ["k"], "ts", "day", "y", ["x", "z"]).collect()}
    assert set(r) == {"x"} and r["x"].n == 20
    assert abs(r["x"].pearson_p - stats.t_tail(r["x"].pearson, 20)) < 1e-12 and abs(r["x"].spearman_p - stats.t_tail(r["x"].spearman, 20)) < 1e-12


def test_consolidate(spark, tmp_path):
    p = str(tmp_path / "out")
    df = spark.createDataFrame([(2001, 1), (2002, 2), (None, 3)], "year int, v int")
    assert len(tables.consolidate(df, p, "both")) == 2
    more = spark.createDataFrame([(2002, 9), (2003, 4)], "year int, v int")
    tables.consolidate(more, p, "both")
    assert sorted((r.year, r.v) for r in spark.read.parquet(p + "/split").collect()) == [(2001, 1), (2002, 2), (2003, 4)]
    assert spark.read.parquet(p + "/all").count() == 2
    tables.consolidate(more, p, "both", overwrite=True)
    assert sorted((r.year, r.v) for r in spark.read.parquet(p + "/split").collect()) == [(2001, 1), (2002, 9), (2003, 4)]
    assert sorted(r.v for r in spark.read.parquet(p + "/all").collect()) == [4, 9]
    with pytest.raises(ValueError):
        tables.consolidate(df, p, "other")


def test_years_in_names(spark, tmp_path):
    for n in ("feed_2003_x.csv", "feed_2004_x.csv", "notes.txt"):
        (tmp_path / n).write_text("a")
    years = tables.years_in_names(spark, str(tmp_path), r"^feed_(\d{4})_")
    assert sorted(r.year for r in years.collect()) == [2003, 2004]
    assert [r.year for r in tables.chosen_years(years, years.where("year > 2003"), 2000, None).collect()] == [2004]


def test_reports_of_empty_tables(spark):
    df = spark.createDataFrame([], "k int, lat double, lon double, c string, o int")
    assert profiles.box_report(df, "lat", "lon", (0, 1, 0, 1)).first()[:] == (0, 0, 0.0, False)
    assert joins.pair_report(df, df, ["k"]).first()[:] == (0, 0, 0)
    assert joins.propagate_report(df, df, ["k"], ["lat"], [F.col("o")]).first()[:] == (0, 0, 0)
    assert profiles.station_years(df, ["k"], "lat", "lon", "c", ["o"]).count() == 0


def test_nearest_mutual_information_deals_points_once(spark):
    rng = np.random.default_rng(8)
    y = rng.choice(4, 6000, p=[0.6, 0.39, 0.009, 0.001])
    a, b = np.round(rng.normal(size=6000) + y, 1), np.where(rng.random(6000) < 0.2, np.nan, rng.random(6000) ** 3)
    df = spark.createDataFrame([(i % 5900, float(u), float(v), int(c)) for i, (u, v, c) in enumerate(zip(a, b, y))], "id int, a double, b double, y int")
    whole, parts = ({r.feature: r.mutual_information for r in stats.nearest_mutual_information(df, ["a", "b"], "y", ["id"], rows=n).collect()} for n in (1_000_000, 150))
    assert all(abs(whole[f] - parts[f]) < 1e-9 for f in "ab") and whole["a"] > 0.1
    # no table of all points is written: the files are those of distinct values and open rows
    from emberlake.storage import shared_root

    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    stats.nearest_mutual_information(df, ["a", "b"], "y", ["id"], rows=1500).collect()
    written = [spark.read.parquet(f"{root}/{n}").count() for n in set(os.listdir(root)) - before]
    assert max(written) < 2 * 6000


def test_rows_are_not_dealt_out_by_a_few_groups(spark):
    df = spark.range(2_000_000).selectExpr("id", "id % 3 AS g", "id AS x", "id AS y")
    quotas = df.groupBy("g").agg((F.count(F.lit(1)) - F.count(F.lit(1)) + 5).alias("_quota"))
    assert "SortMergeJoin" not in sampling.first_by_hash(df, ["g"], ["id"], quotas)._jdf.queryExecution().executedPlan().toString()
    years = spark.range(50).selectExpr("CAST(1990 + id % 5 AS INT) AS year")
    both = tables.chosen_years(years, years.where("year <> 1992"), 1991, [1992, 1993, 1994])
    assert sorted(r.year for r in both.collect()) == [1993, 1994]
    assert "Aggregate" in both._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]


def test_cleaning_of_numbers_does_not_go_through_text(spark):
    df = spark.createDataFrame([(1.5, 7, "1,5"), (-999.0, -9999, "-999"), (float("nan"), None, " "), (float("inf"), 0, "x"), (0.1 + 0.2, 3, "2")], "x double, n int, s string")
    clean = scalars.clean_missing(df, ["x", "n", "s"])
    assert [tuple(r) for r in clean.collect()] == [(1.5, 7.0, 1.5), (None, None, None), (None, None, None), (float("inf"), 0.0, None), (0.1 + 0.2, 3.0, 2.0)]
    plan = scalars.clean_missing(df, ["x", "n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan


def test_hash_samples_read_their_table_three_times(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "id % 3 AS g").write.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.read.parquet(f"{tmp_path}/t").mapInPandas(count, "id long, g long")
    quotas = spark.createDataFrame([(0, 700), (1, 0), (2, 9_000_000)], "g long, _quota long")
    got = sampling.first_by_hash(df, ["g"], ["id"], quotas).toPandas()
    assert seen.value <= 4 * 20_000
    order = sorted(range(0, 20_000, 3), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert set(got[got.g == 0].id) == set(order[:700]) and (got.g == 1).sum() == 0 and (got.g == 2).sum() == 6666 and got.id.is_unique


def test_selection_counts_values_once(spark):
    df = spark.range(3000).selectExpr("id", "double(id % 50) AS a", "double(id % 7) AS b", "int(id % 3 = 0) AS y")
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    selection.select_features(df, ["a", "b"], "y", ["id"], 2).collect()
    made = [n.rsplit("-", 5)[0].split("-")[0] for n in set(os.listdir(root)) - before]
    assert made.count("cells") == 1 and made.count("sample") == 1


def test_redundancy_is_judged_on_all_rows(spark):
    n = 240_000  # more than the 200,000 of the sample that was taken before
    df = spark.range(n).selectExpr("id", "double(hash(id) % 997) AS a", "double(hash(id) % 997 + hash(id, 1) % 700) AS b", "CASE WHEN id % 6 <> 0 THEN double(id % 7) END AS c", "5.0D AS same")
    got, want = selection.correlations(df, ["a", "b"], ["id"]), df.select("a", "b").toPandas().rank().corr().abs()
    assert all(abs(got[f, g] - want.loc[f, g]) < 1e-9 for f in "ab" for g in "ab")
    some = selection.correlations(df, ["a", "b"], ["id"], most=1000)
    assert abs(some["a", "b"] - got["a", "b"]) > 1e-6
    gappy, want = selection.correlations(df, ["a", "b", "c", "same"], ["id"]), df.where("c IS NOT NULL").select("a", "b", "c").toPandas().rank().corr().abs()
    assert all(abs(gappy[f, g] - want.loc[f, g]) < 1e-9 for f in "abc" for g in "abc") and np.isnan(gappy["a", "same"])
    assert all(np.isnan(x) for x in selection.correlations(df.limit(0), ["a", "b"], ["id"]).values())


def test_values_are_not_dealt_out_by_feature(spark):
    df = spark.range(2000).selectExpr("double(id) AS a", "double(id % 7) AS b", "int(id % 3 = 0) AS y")
    off = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in off}
    try:
        for k in off:
            spark.conf.set(k, "-1")  # no join by Spark's own size check
        plan = stats.binned_mutual_information(df, ["a", "b"], "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan  # the sizes of features are sent, ranks are joined by value
