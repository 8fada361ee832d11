"""Exact neighbours against brute force: donors with gaps, a whole minority, ties, copies, unknown values."""

from __future__ import annotations

import numpy as np
import pytest

from emberlake.operators import neighbours, sampling


def brute_fill(x, row, k, weights):
    """One row filled from donors ``x`` by the full distance table."""
    out = row.copy()
    both = ~np.isnan(row) & ~np.isnan(x)
    n = both.sum(1)
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += np.where(both[:, j], (row[j] - x[:, j]) ** 2, 0.0)
    d = np.where(n > 0, np.sqrt(total * x.shape[1] / np.maximum(n, 1)), np.inf)
    for j in np.flatnonzero(np.isnan(row)):
        dj = np.where(np.isnan(x[:, j]), np.inf, d)
        near = np.argsort(dj, kind="stable")[:k]
        near = near[np.isfinite(dj[near])]
        if not len(near):
            continue
        if weights == "distance":
            w = (dj[near] == 0).astype(float) if (dj[near] == 0).any() else 1 / dj[near]
            out[j] = (w * x[near, j]).sum() / w.sum()
        else:
            out[j] = x[near, j].mean()
    return out


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("grid", [4, 1000])
def test_donor_index(weights, grid):
    rng = np.random.default_rng(grid)
    donors = rng.integers(0, grid, (3000, 5)).astype(float)
    donors[rng.random(donors.shape) < 0.2] = np.nan
    rows = rng.integers(0, grid, (120, 5)).astype(float)
    rows[rng.random(rows.shape) < 0.4] = np.nan
    rows[0] = np.nan
    index = neighbours.DonorIndex(donors, 5)
    assert sum(len(leaf) for _, leaves, *_ in index.groups for leaf in leaves) == (~np.isnan(donors)).any(1).sum()
    for row in rows:
        assert np.allclose(index.fill(row, weights), brute_fill(donors, row, 5, weights), equal_nan=True, rtol=1e-12)
    assert np.isnan(neighbours.DonorIndex(donors[:0], 5).fill(rows[1], weights)).sum() == np.isnan(rows[1]).sum()


def test_weights_in_a_table(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 3.0, 50.0), (4, 2.0, None), (5, 1.0, None), (6, None, None)], "id int, a double, b double")
    got = {r.id: (r.a, r.b) for r in sampling.knn_impute(df, ["a", "b"], df.where("id < 4"), ["id"], 2, "distance").collect()}
    assert got[4] == (2.0, 35.0) and got[5] == (1.0, 20.0) and got[6] == (4 / 3, 80 / 3)
    with pytest.raises(ValueError):
        sampling.knn_impute(df, ["a"], df, ["id"], weights="other")


def plain(points, q, k):
    d = np.sqrt(((points - points[q]) ** 2).sum(1))
    d[q] = np.inf
    near = np.lexsort((*points.T[::-1], d))[:k]
    return [(d[i], tuple(points[i])) for i in near if np.isfinite(d[i])]


@pytest.mark.parametrize("n,pivots,grid", [(51_000, None, None), (3000, 7, 40), (5000, 2, None), (3, None, None)])
def test_nearest_rows_are_exact(spark, n, pivots, grid):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) * rng.choice([0.1, 1, 5], (n, 1))
    x = np.round(x * grid / 5) if grid else x
    df = spark.createDataFrame([(*map(float, r), i) for i, r in enumerate(x)] + [(1.0, None, 1.0, -1), (float("nan"), 1.0, 1.0, -2)], "a double, b double, c double, id int")
    got = {tuple(r["x"]): (r["n"], [(p["d"], tuple(p["x"])) for p in r["near"]]) for r in neighbours.nearest_rows(df, ["a", "b", "c"], 5, pivots).collect()}
    points, times = np.unique(x, axis=0, return_counts=True)
    assert {k: v[0] for k, v in got.items()} == {tuple(p): int(t) for p, t in zip(points, times)}
    for q in rng.choice(len(points), min(len(points), 400), replace=False):
        want, have = plain(points, q, 5), got[tuple(points[q])][1]
        assert [p for _, p in have] == [p for _, p in want], q
        assert np.allclose([d for d, _ in have], [d for d, _ in want], rtol=1e-12)


def test_smote_uses_the_whole_minority(spark):
    rows = [(i, float(i), 0.0, 1) for i in range(60)] + [(1000 + i, 7.0, 0.0, 1) for i in range(20)] + [(2000, None, 1.0, 1)] + [(3000 + i, float(i), 1.0, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, x double, _near double, y int")  # a feature with the name of a helper
    out = sampling.smote(df, "y", ["x", "_near"], ["id"], 0.2, k=2)
    assert out.columns == ["x", "_near", "y"] and out.where("y = 0").count() == 2000
    made = out.where("y = 1").subtract(df.where("y = 1").selectExpr("x", "_near", "y")).collect()
    assert len(made) > 100 and all(r["_near"] == 0 and 0 <= r["x"] <= 59 for r in made)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in sampling.smote(df.repartition(5), "y", ["x", "_near"], ["id"], 0.2, k=2).collect()}
    assert sampling.smote(df.where("y = 1"), "y", ["x"], ["id"]).count() == 81


def test_rows_are_filled_together():
    import time

    rng = np.random.default_rng(4)
    donors = np.column_stack([rng.integers(0, 50, 20_000), np.round(rng.random(20_000) * 1e5, 2), rng.integers(0, 11, 20_000) / 100]).astype(float)
    rows = np.column_stack([rng.integers(0, 50, 60_000), np.round(rng.random(60_000) * 1e5, 2), rng.integers(0, 11, 60_000) / 100]).astype(float)
    for x in (donors, rows):
        x[np.arange(len(x)), rng.integers(0, 3, len(x))] = np.nan
    for weights in ("uniform", "distance"):
        began = time.process_time()
        made = neighbours.DonorIndex(donors, 5).fill_all(rows, weights)
        assert time.process_time() - began < 12  # a row at a time took milliseconds for each
        for i in range(0, 60_000, 600):
            assert np.allclose(made[i], brute_fill(donors, rows[i], 5, weights), rtol=1e-12)
