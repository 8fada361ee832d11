"""Whitening against numpy's dense solvers, its exact parts against integers, and its defined cases."""

from __future__ import annotations

import numpy as np
import pytest

from emberlake.llm import whitening

RNG = np.random.default_rng(11)
KINDS = {
    "plain": RNG.normal(size=(300, 24)),
    "graded": RNG.normal(size=(300, 24)) * np.logspace(0, -8, 24),
    "few_rows": RNG.normal(size=(10, 24)),
    "copies": np.tile(RNG.normal(size=(1, 24)), (9, 1)),
    "orthonormal": np.linalg.qr(RNG.normal(size=(300, 24)))[0],
    "two_values": np.diag(np.r_[np.ones(9), np.full(15, 2.0)]) @ np.linalg.qr(RNG.normal(size=(24, 24)))[0],
    "dependent": np.hstack([RNG.normal(size=(300, 20)), np.zeros((300, 2)), np.ones((300, 2))]),
    "nothing": np.zeros((5, 24)),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_solver(kind):
    x = KINDS[kind]
    d = x.shape[1]
    r = np.zeros((d, d))
    top = np.linalg.qr(x, mode="r")
    r[: len(top)] = top
    values, vectors = whitening.singular(r)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    want = want[want > (1e-15 * d) ** 2 * max(want[0], 1e-300)][: len(values)]
    rank = np.linalg.matrix_rank(x) if np.any(x) else 0
    assert len(values) == rank
    assert np.allclose(values, want, rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(rank)).max(initial=0) < 1e-9
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max(initial=0) <= 1e-12 * values.max(initial=1)


def brute(rows, most=32):
    """Rows, eigenvalues and whitened values by numpy's symmetric solver."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r] for r in rows])
    n = len(x)
    offsets = n * x - x.sum(0)
    c = offsets / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, (offsets.astype(object) ** 2).sum(1), values, c @ vectors / np.sqrt(values), np.trace(c.T @ c / n)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [[float(v) for v in r] for r in RNG.normal(size=(200, 40))]
    rows += [rows[0]] * 60  # a large group of copies
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(None if i == 3 else i // 2, r, 0) for i, r in enumerate(rows)], schema)
    bad = spark.createDataFrame([(900, None, 0), (901, [1.0, None] * 20, 0), (902, [float("nan")] * 40, 0), (903, [float("-inf")] * 40, 0)], schema)
    df.unionByName(bad).repartition(23).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, str(tmp_path)).toPandas()
    n, deviation, values, whitened, trace = brute(rows)
    assert len(got) == n * 32 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-9)
    # signs are free, but one for all rows; equal rows are told apart by nothing
    ours = np.array([r for _, r in got.sort_values("component").groupby(["vec_id", "deviation", got.groupby(["vec_id", "component"], dropna=False).cumcount()], dropna=False)["whitened"].apply(list).items()])
    assert ours.shape == whitened.shape
    order = lambda m: m[np.lexsort(np.round(np.abs(m), 6).T)]
    assert np.allclose(np.abs(order(ours)), np.abs(order(whitened)), atol=1e-8)
    assert sorted(got.drop_duplicates(["vec_id", "deviation"])["deviation"].unique()) == sorted(set(deviation.tolist()))


def test_defined_cases(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, n int, deviation string"
    cases = {
        "empty": [],
        "only_bad": [(1, None, 0, ""), (2, [None], 0, "")],
        "one": [(1, [0.5, 2.0], 0, "")],
        "equal": [(i, [0.5, 2.0], 0, "") for i in range(5)],
        "without_entries": [(1, [], 0, ""), (2, [], 0, "")],
    }
    for name, rows in cases.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert whitening.op13_embedding_whitening(spark, f"{tmp_path}/{name}").count() == 0, name
    rows = [(1, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, ""), (2, [3.0], 0, ""), (None, [], 0, "")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/short/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, f"{tmp_path}/short").toPandas()
    assert len(got) == 4 * 2 and got["identity_error"].max() < 1e-12
    n, deviation, *_ = brute([[1.0, 2.0], [1.0, 2.0], [3.0, 0.0], [0.0, 0.0]])
    assert sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation.tolist())


def test_large_integers_stay_exact():
    x = np.array([[1 << 40, -(1 << 41)], [5, 7]], np.int64)
    offsets = whitening.exact_offsets(x, 1 << 30, [3, 4])
    assert offsets.tolist() == [[(1 << 70) - 3, -(1 << 71) - 4], [5 * (1 << 30) - 3, 7 * (1 << 30) - 4]]
    assert whitening.squared_length(offsets) == [a * a + b * b for a, b in offsets.tolist()]
