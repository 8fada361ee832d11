"""Splits with their audit, saved models, budgets, forecasts by orders, embeddings fitted on early rows."""

from __future__ import annotations

import datetime as dt
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.operators import embedding, forecast, models, sampling


def T(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def panel(spark, n=4000):
    rng = np.random.default_rng(0)
    rows = [(i, 2000 + i % 8 if i % 50 else None, float(x) if i % 7 else None, float(z), "1" if z + x > 1.2 else "0" if i % 31 else "unknown") for i, (x, z) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "id int, y int, a double, b double, t string")


def test_split_counts_every_row(spark):
    df = panel(spark)
    kept, audit = sampling.load_split(df.withColumn("split", F.lit("own")).withColumn("_g", F.lit(1)), ["a", "b"], "t", "y", ["id"], test_years=2, gap=1, ratio=2.0, least=10)
    found = {(r["split"], r["rule"]): r["n"] for r in audit.collect()}
    assert sum(found.values()) == 4000
    rows = df.collect()
    where = lambda y: "none" if y is None else "test" if y > 2005 else "gap" if y > 2004 else "train"
    want = {}
    for r in rows:
        rule = "year" if r.y is None else "label" if r.t == "unknown" else "missing" if r.a is None else "gap" if where(r.y) == "gap" else "kept"
        want[where(r.y), rule] = want.get((where(r.y), rule), 0) + 1
    positives = sum(r.t == "1" and r.a is not None and where(r.y) == "train" for r in rows)
    take = min(want["train", "kept"] - positives, max(10, 2 * positives))
    want["train", "negatives"] = want["train", "kept"] - positives - take
    want["train", "kept"] = positives + take
    assert found == {k: v for k, v in want.items() if v}
    assert kept.columns == ["id", "a", "b", "y", "t", "split"] and {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()} == {"train": want["train", "kept"], "test": want["test", "kept"]}
    with pytest.raises(ValueError):
        sampling.load_split(df.where("y = 2001"), ["a"], "t", "y", ["id"])


def test_budget_bounds_a_sample(spark):
    df = spark.range(1000).select("id", (F.col("id") < 100).cast("int").alias("y"), F.lit(0).alias("_row"), F.lit(1).alias("_h"))
    n = lambda **k: {r["y"]: r["count"] for r in sampling.downsample(df, "y", ["id"], 5.0, **k).groupBy("y").count().collect()}
    assert n() == {1: 100, 0: 500} and n(budget=300) == {1: 100, 0: 200} and n(budget=60) == {1: 60} and n(least=700) == {1: 100, 0: 700}
    assert sampling.downsample(df, "y", ["id"], 1.0).columns == df.columns


def test_share_of_dropped_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (5, 6)], "a int, b int")
    rows, report = sampling.complete_rows(df, ["a", "b"])
    assert rows.count() == 2 and tuple(report.first()) == (4, 2, 0.5)
    assert tuple(sampling.complete_rows(df.limit(0), ["a"])[1].first()) == (0, 0, 0.0)


@pytest.mark.parametrize("kind", ["logistic", "boosted", "svm"])
def test_saved_models_score_alike(spark, tmp_path, kind):
    kept, _ = sampling.load_split(panel(spark, 1500), ["a", "b"], "t", "y", ["id"])
    train, test = kept.where("split = 'train'"), kept.where("split = 'test'")
    params = {"maxIter": 3} if kind == "boosted" else {}
    model = models.train(kind, train, ["a", "b"], "t", **params)
    folder = f"file://{tmp_path}/model"
    models.save_model(model, folder)
    again = models.load_model(spark, folder)
    assert (again.kind, again.features, again.params) == (kind, ["a", "b"], params)
    score = lambda m: sorted((r["id"], r["probability_1"]) for r in m.score(test).collect())
    assert score(again) == score(model)
    metrics = models.evaluate_saved(spark, folder, kept, ["id"], "t").first()
    con = duckdb.connect()
    pred = f"read_parquet('{tmp_path}/model/predictions/*.parquet')"
    tp, fp, n = con.execute(f"SELECT count(*) FILTER (label = 1 AND probability_1 >= 0.5), count(*) FILTER (label = 0 AND probability_1 >= 0.5), count(*) FROM {pred}").fetchone()
    assert (metrics["tp"], metrics["fp"], n) == (tp, fp, test.count())
    p, y = (np.array([r[i] for r in con.execute(f"SELECT probability_1, label FROM {pred}").fetchall()]) for i in (0, 1))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(metrics["roc_auc"] - auc) < 1e-9
    points = con.execute(f"SELECT threshold, tp, fp FROM read_parquet('{tmp_path}/model/curves/*.parquet')").fetchall()
    assert len(points) == len(set(p)) and all(t == ((p >= s) & (y == 1)).sum() and f == ((p >= s) & (y == 0)).sum() for s, t, f in points)


def test_terms_of_orders():
    t = forecast.terms((2, 1, 1), (1, 1, 1, 24))
    assert (t.lags, t.errors, t.difference, t.seasonal, t.season) == ((1, 2, 24, 25, 26), (1, 24, 25), 1, 1, 24)
    assert forecast.terms((1, 0, 0)).lags == (1,)


def test_forecasts_by_orders():
    rng = np.random.default_rng(3)
    hours = np.arange(400)
    y = 10 + 0.05 * hours + 4 * np.sin(hours * 2 * np.pi / 24) + rng.normal(0, 0.05, 400)
    none = np.zeros((376, 0))
    got = forecast._fit_predict(y[:376], none, 24, forecast.terms((1, 1, 1), (0, 1, 0, 24)))
    assert np.abs(np.array(got) - y[376:]).max() < 0.6  # trend and season go on
    noise = rng.normal(size=3000)
    moving = noise[1:] + 0.8 * noise[:-1]
    at = forecast._fit_predict(moving[:-1], np.zeros((2998, 0)), 2, forecast.terms((0, 0, 1)))
    assert abs(at[0] - 0.8 * noise[-2]) < 0.15 and abs(at[1]) < 0.15  # a moving average is over after its order
    assert forecast._fit_predict(y[:20], none[:20], 3, forecast.terms((1, 1, 1), (0, 1, 0, 24))) is None


def test_embedding_parameters_see_only_early_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(1, T(i), float(rng.random()), float(rng.random())) for i in range(120)]
    other = [r if i < 60 else (1, r[1], r[2] * 50 + 7, -r[3]) for i, r in enumerate(rows)]
    run = lambda data, **k: {r.ts: r.embedding for r in embedding.embed(spark.createDataFrame(data, "k int, ts timestamp, a double, b double"), ["k"], "ts", ["a", "b"], length=12, **k).collect()}
    early = F.col("ts") < F.lit(T(60))
    one, two = run(rows, fitted_on=early), run(other, fitted_on=early)
    assert all(one[T(i)] == two[T(i)] for i in range(60)) and one[T(100)] != two[T(100)]
    assert any(run(rows)[T(i)] != run(other)[T(i)] for i in range(13, 60))


def test_experiments_have_a_row_for_each_kind(spark):
    kept, _ = sampling.load_split(panel(spark, 1200), ["a", "b"], "t", "y", ["id"])
    out = models.experiments({"x": (kept, ["a", "b"]), "y": (kept, ["b"])}, ["naive_bayes", "prior", "stratified"], "t", ["id"]).collect()
    assert {(r["scenario"], r["model"]) for r in out} == {(s, m) for s in "xy" for m in ("naive_bayes", "prior", "stratified")}
    prior = next(r for r in out if r["model"] == "prior")
    assert prior["roc_auc"] == 0.5 and prior["n_test"] == kept.where("split = 'test'").count()


def test_equal_rows_train_and_count_together(spark):
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b), int(rng.random() < (0.8 if a + b > 5 else 0.3)), 2000 + i % 5) for i, (a, b) in enumerate(rng.integers(0, 6, (3000, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int, year int").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    models.train("svm", df.mapInPandas(count, df.schema), ["a", "b"], "y", time="year")
    assert seen.value == len(rows)  # rows are read once, whatever the number of iterations
    apart = models.told_apart(df, ["a", "b", "y"])
    assert apart.count() <= 72 and apart.agg(F.sum("_times")).first()[0] == len(rows)
    for kind in ("logistic", "naive_bayes", "boosted"):
        plain = models._fit(kind, df, ["a", "b"], "y", None, {})
        model = models.train(kind, df, ["a", "b"], "y")
        points = apart.select("a", "b").distinct()
        one, two = ({(r.a, r.b): r.probability_1 for r in models.Trained(kind, m, ["a", "b"]).score(points).collect()} for m in (plain, model.model))
        assert all(abs(one[k] - two[k]) < 1e-4 for k in one)
        whole, told = models.evaluate(model.score(df), "y").first(), models.evaluate(model.score(apart), "y").first()
        assert all(abs(whole[c] - told[c]) < 1e-9 for c in whole.asDict())


def test_forest_draws_numbers_of_equal_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), int(rng.random() < (0.8 if a * b > 6 else 0.2))) for a, b in rng.integers(0, 6, (6000, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    apart = models.told_apart(df, ["a", "b", "y"])
    points = apart.select("a", "b").distinct()
    score = lambda m: {(r.a, r.b): r.probability_1 for r in m.score(points).collect()}
    made = [models.train("forest", d, ["a", "b"], "y", numTrees=6) for d in (apart, apart.repartition(3))]
    assert score(made[0]) == score(made[1])  # whatever the partitions
    single = score(models.train("forest", df, ["a", "b"], "y", numTrees=20))
    assert all(abs(p - single[k]) < 0.15 for k, p in score(made[0]).items())
    assert abs(sum(v for _, v in made[0].importances()) - 1) < 1e-9
    models.save_model(made[0], f"file://{tmp_path}/forest")
    assert score(models.load_model(spark, f"file://{tmp_path}/forest")) == score(made[0])
    with pytest.raises(ValueError):
        models.train("forest", apart, ["a", "b"], "y", minInstancesPerNode=3)


def test_experiment_writes_distinct_rows_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), int(rng.random() < 0.2 + 0.15 * a), 2000 + i % 5) for i, a in enumerate(rng.integers(0, 4, 4000))]
    split = sampling.holdout(spark.createDataFrame(rows, "id int, a double, y int, year int"), "year", 1)
    most, plain = [], models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, name: (most.append((name, plain(df, name).count())), plain(df, name))[1])
    out = models.experiment(split, "F", ["naive_bayes", "forest"], ["a"], "y", year="year", keys=["id"], variations=models.VARIATIONS[:1]).collect()
    out += models.experiment(split, "F", ["naive_bayes"], ["a"], "y", year="year", keys=["id"], variations=models.VARIATIONS[1:2]).collect()
    assert max(n for _, n in most) <= 4 * 2 * 5, most  # values, labels, years
    assert all((r.n_train, r.n_test, r.tp + r.fp + r.tn + r.fn) == (3200, 800, 800) for r in out) and len(out) == 3


def test_rows_are_not_dealt_out_by_few_groups(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    # no join by Spark's own size check
    off = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in off}
    plans = lambda d: d._jdf.queryExecution().executedPlan().toString()
    try:
        for k in off:
            spark.conf.set(k, "-1")
        some = sampling.downsample(df, "y", ["id"], 0.5, per=["g"])
        assert "BroadcastHashJoin" in plans(some) and "SortMergeJoin" not in plans(some)
        monkeypatch.setattr(sampling, "FEW", 2)
        many = sampling.downsample(df, "y", ["id"], 0.5, per=["g"])
        assert "SortMergeJoin" in plans(many)
        ids = lambda d: sorted(r["id"] for r in d.collect())
        assert ids(some) == ids(many) and len(ids(some)) == 900
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fits_of_few_rows_run_at_the_same_time(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(rng.random() < (0.7 if a > b else 0.2)), 2000 + i % 6) for i, (a, b) in enumerate(rng.integers(0, 9, (3000, 2)))]
    split = sampling.holdout(spark.createDataFrame(rows, "id int, a double, b double, y int, year int").repartition(6), "year", 2)
    made, now, most, plain, lock = [], [], [], models._fit, threading.Lock()

    def fit(*args):
        with lock:
            now.append(args)
            most.append(len(now))
        try:
            return plain(*args)
        finally:
            with lock:
                now.pop()

    monkeypatch.setattr(models, "_fit", fit)
    for bound in (models.TOGETHER, 1):
        monkeypatch.setattr(models, "TOGETHER", bound)
        most.clear()
        out = models.experiments({"x": (split, ["a", "b"])}, ["logistic", "naive_bayes", *models.BASELINES], "y", ["id"], year="year").collect()
        made.append({(r.scenario, r.model): r.asDict() for r in out})
        assert (max(most) > 1) == (bound > 1)  # many rows one after the other
    assert made[0].keys() == made[1].keys() and len(made[0]) == 4
    for key, one in made[0].items():
        assert all(v == pytest.approx(made[1][key][c], rel=1e-3) if isinstance(v, float) else v == made[1][key][c] for c, v in one.items()), key
    prior, stratified = made[0]["x", "prior"], made[0]["x", "stratified"]
    test = [r for r in rows if r[4] >= 2004]
    rate = np.mean([r[3] for r in rows if r[4] < 2004])
    assert (prior["n_train"], prior["n_test"], prior["n_test_positive"]) == (3000 - len(test), len(test), sum(r[3] for r in test))
    assert prior["brier"] == pytest.approx(np.mean([(rate - r[3]) ** 2 for r in test])) and stratified["tp"] + stratified["fn"] == prior["n_test_positive"]


def test_few_rows_are_one_task_of_a_fit(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(5)
    found, plain = [], models.VectorAssembler.transform
    monkeypatch.setattr(models.VectorAssembler, "transform", lambda self, rows, *more: (found.append(rows.rdd.getNumPartitions()), plain(self, rows, *more))[1])
    told = models.told_apart(df, ["a", "y"]).repartition(4)
    models.train("logistic", told, ["a"], "y")
    assert found == [1]
