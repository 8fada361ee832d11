"""Whitening of embedding vectors by a bidiagonal qd solver.

Blocks of centred rows are reduced by QR, the triangles of blocks again by QR in a tree, so that no task
holds more than some thousand rows. The last triangle (dimension times dimension, whatever the number of
rows) is brought to bidiagonal form by Householder reflections; dqds finds its singular values to high
relative accuracy and twisted factorisations of its tridiagonal square give the directions.

Entries become integers ``floor(64 * c) + 1000000`` first. The sums of a dimension and the deviation of a
row are exact; a deviation that a long cannot hold is null.

Defined cases: a row goes whose vector is null or holds a null, NaN or infinite entry; an empty vector stays.
Shorter vectors are taken as if zeros followed. Components without variance (constant or dependent
dimensions, fewer rows than dimensions) have no scale and are left out, so a table of equal vectors, of one
vector or without rows gives an empty result. Rows with repeated or null ids come back as often as they came in.
The input's other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.workers import small_batches
from emberlake.storage import materialize

SCALE, SHIFT = 64, 1_000_000
MOST = 32  # components
FAN_IN = 16  # triangles that one task of the tree reduces
BLOCK_ROWS = 4096  # rows that are reduced at once


@dataclass(frozen=True)
class Whitener:
    """``n`` fitted rows with sums ``sums``; eigenvalues of the covariance by falling size, and their vectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` from integers: the numerator is exact, only the quotient is rounded."""
        return exact_offsets(x, self.n, self.sums).astype(np.float64) / self.n

    def project(self, x: np.ndarray, most: int = MOST) -> np.ndarray:
        k = min(most, len(self.values))
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def exact_offsets(x: np.ndarray, n: int, sums) -> np.ndarray:
    """``n * x - S``, in 64-bit integers where they hold it and else in Python's."""
    top = max((abs(int(s)) for s in sums), default=0) + n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array([int(s) for s in sums], object)


def squared_length(offsets: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    biggest = max(abs(int(offsets.max(initial=0))), abs(int(offsets.min(initial=0))))
    if biggest * biggest * max(1, offsets.shape[1]) < 1 << 62:
        return (offsets.astype(np.int64) ** 2).sum(1).tolist()
    wide = offsets.astype(object)
    return [int(v) for v in (wide * wide).sum(1)]


# --- the small dense part: bidiagonal form, dqds, twisted factorisations ------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder bidiagonalisation of a square matrix: diagonal, superdiagonal, and the right factor.

    ``r = U B V'`` with an upper bidiagonal ``B``; only ``V`` is kept, whose columns carry right singular vectors.
    """
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        size = np.linalg.norm(x)
        if size == 0.0 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _transform(q, e, shift):
    """One differential qd transform with a shift; None where the shift passes the least eigenvalue."""
    n = len(q)
    new_q, new_e, d, least = [0.0] * n, [0.0] * (n - 1), q[0] - shift, q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None
        t = d + e[i]
        new_q[i] = t
        ratio = q[i + 1] / t if t > 0.0 else 0.0
        new_e[i] = e[i] * ratio
        # without shift a vanished pivot leaves the next one as it is
        d = (d * ratio if t > 0.0 else q[i + 1]) - shift
        least = min(least, d)
    if d < 0.0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def _block_values(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of ``B'B`` of one unreduced block from ``q = diag^2`` and ``e = superdiag^2``."""
    eps = np.finfo(float).eps
    out, todo = [], [(list(q), list(e), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        if len(q) == 1:
            out.append(q[0] + moved)
            continue
        if q[0] < q[-1]:  # large values first; read from the end, the arrays are those of B B', which has the same values
            q, e = q[::-1], e[::-1]
        guess = 0.0
        while True:
            n = len(q)
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= (eps * eps) * (moved + min(q[i], q[i + 1])) or e[i] * e[i] <= (eps * (moved + q[i + 1])) ** 2 * 1e-4), None)
            if cut is not None:
                todo += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
                break
            step = _transform(q, e, guess)
            while step is None:
                guess = guess / 4 if guess > 1e-3 * q[-1] else 0.0
                step = _transform(q, e, guess)
            moved += guess
            q, e, least = step
            # the least eigenvalue of the last two rows of the new B B', kept on the safe side
            a, b, c = q[-2] + e[-1], q[-1], e[-1] * q[-1]
            half = (a - b) / 2
            low = b - c / (half + np.sqrt(half * half + c)) if half > 0 else min(least, b) / 2
            guess = max(0.0, min(low * (1 - 1e-8), least))
            if guess < eps * moved:
                guess = 0.0
    return out


def _twisted(q: np.ndarray, l: np.ndarray, value: float, rank: int = 0) -> np.ndarray:
    """Unit eigenvector of ``L D L'`` (``D = q``, unit lower bidiagonal ``l``) for an accurate eigenvalue.

    The stationary transform runs from the top, the progressive one from the bottom; they meet (twist) where
    the remaining pivot is least, and the vector follows from there by multiplications only. A higher ``rank``
    takes the next least pivot, which gives another vector of a value that several vectors share.
    """
    n = len(q)
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    upper, lower = np.zeros(n), np.zeros(n)
    down, up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s = -value
    for i in range(n - 1):
        upper[i] = s
        d = s + q[i]
        d = d if abs(d) > tiny else -tiny
        down[i] = q[i] * l[i] / d
        s = down[i] * l[i] * s - value
    upper[n - 1] = s
    p = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        lower[i + 1] = p
        d = q[i] * l[i] * l[i] + p
        d = d if abs(d) > tiny else -tiny
        up[i] = q[i] * l[i] / d
        p = p * q[i] / d - value
    lower[0] = p
    k = int(np.argsort(np.abs(upper + lower + value), kind="stable")[rank])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
        if abs(z[i]) > 1e100:  # only ratios count
            z /= abs(z[i])
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
        if abs(z[i + 1]) > 1e100:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix by falling size, and right singular vectors as columns.

    Values that rounding alone may have made (below ``eps * dimension`` of the largest singular value) are left out.
    """
    d = r.shape[1]
    if d == 0 or not np.any(r):
        return np.zeros(0), np.zeros((d, 0))
    scale = np.abs(r).max()
    a, b, v = bidiagonal(r / scale)
    eps = np.finfo(float).eps
    floor = eps * max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    apart = lambda i: abs(b[i]) <= max(floor, eps * d * min(abs(a[i]), abs(a[i + 1])))
    cuts = [0, *[i + 1 for i in range(d - 1) if apart(i)], d]
    pairs = []
    for lo, hi in zip(cuts, cuts[1:]):
        q, e = a[lo:hi] ** 2, b[lo : hi - 1] ** 2
        found = sorted(_block_values(q.tolist(), e.tolist()), reverse=True)
        diagonal = np.where(q > 0, q, floor * floor)  # a pivot of zero would hide the rows behind it
        l = b[lo : hi - 1] * np.sign(np.where(a[lo : hi - 1] == 0, 1, a[lo : hi - 1])) / np.sqrt(diagonal[:-1])
        group: list[tuple[float, np.ndarray]] = []
        for value in found:
            # vectors of values that agree in ten digits are made orthogonal among themselves
            group = [g for g in group if g[0] - value <= 1e-10 * g[0]]
            for rank in range(hi - lo):
                z = np.zeros(d)
                z[lo:hi] = _twisted(diagonal, l, value, rank)
                for _, other in [*group, *group]:
                    z -= (other @ z) * other
                if (size := np.linalg.norm(z)) > 0.1 or not group:
                    break
            z /= size
            group.append((value, z))
            pairs.append((value, z))
    pairs.sort(key=lambda x: -x[0])
    least = (eps * d) ** 2 * pairs[0][0]
    pairs = [p for p in pairs if p[0] > least]
    values = np.array([p[0] for p in pairs]) * scale * scale
    return values, v @ np.array([p[1] for p in pairs]).T


# --- the distributed part ------------------------------------------------------------------------------


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x array<bigint>`` of the rows that count."""
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + SHIFT)
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    """Rows of an Arrow list column as one integer matrix; short vectors end in (shifted) zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.full((len(sizes), d), SHIFT, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _triangle(blocks) -> np.ndarray:
    return np.linalg.qr(np.vstack(blocks), mode="r")


def fit(vectors: DataFrame) -> Whitener | None:
    """Fit on ``vec_id, x``; None without rows. The driver gets one row for each dimension and one triangle."""
    import pyarrow as pa

    spark = vectors.sparkSession
    small_batches(spark)
    n, d = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not d:
        return None

    def sums(batches):
        total = np.zeros(d, np.int64)
        for b in batches:
            x = _matrix(b.column(0), d)
            total += (x - SHIFT).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total)], ["dim", "s"])

    found = vectors.select("x").mapInArrow(sums, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_dim = {r["dim"]: int(r["s"]) for r in found}
    totals = tuple(by_dim.get(i, 0) + n * SHIFT for i in range(d))
    frame = Whitener(n, totals, np.zeros(0), np.zeros((d, 0)), 0.0)

    def reduce_block(batches):
        r, held, rows = np.zeros((0, d)), [], 0
        for b in batches:
            held.append(frame.centred(_matrix(b.column(0), d)))
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                r, held, rows = _triangle([r, *held]), [], 0
        if held:
            r = _triangle([r, *held])
        if len(r):
            yield as_rows(r)

    def as_rows(r):
        return pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], ["r"])

    def reduce_tree(table):
        return pa.table({"r": pa.array(_triangle([np.array(table.column("r").to_pylist())]).tolist(), pa.list_(pa.float64()))})

    part = F.spark_partition_id().alias("part")
    parts = materialize(vectors.select("x").mapInArrow(reduce_block, "r array<double>").select(part, "r"), "triangles")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        key = F.floor(F.col("part") / FAN_IN).cast("int")
        level = parts.withColumn("part", key).groupBy("part").applyInArrow(lambda k, t: reduce_tree(t).append_column("part", pa.array([k[0].as_py()] * min(d, t.num_rows), pa.int32())), "r array<double>, part int")
        parts, most = materialize(level.select("part", "r"), "triangles"), most // FAN_IN
    rows = np.array([r["r"] for r in parts.select("r").collect()])  # at most one row for each dimension
    r = np.zeros((d, d))
    r[: len(rows)] = rows if len(rows) <= d else _triangle([rows])
    values, directions = singular(r)
    return Whitener(n, totals, values / n, directions, float((r * r).sum() / n))


def identity_error(vectors: DataFrame, model: Whitener, most: int = MOST) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; blocks are centred and merged by their means."""
    import pyarrow as pa

    k, d = min(most, len(model.values)), len(model.sums)

    def moments(batches):
        n, mean, inner = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if not b.num_rows:
                continue
            w = model.project(_matrix(b.column(0), d), most)
            m, own = len(w), w.mean(0)
            c = w - own
            inner += c.T @ c + np.outer(own - mean, own - mean) * (n * m / (n + m))
            n, mean = n + m, mean + (own - mean) * (m / (n + m))
        if n:
            i, j = (a.ravel() for a in np.indices((k, k)))
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((inner / model.n).ravel()), pa.array(np.repeat(mean * n / model.n, k)), pa.array((np.outer(mean, mean) * (n / model.n)).ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "inner", "mean", "outer"])

    parts = vectors.select("x").mapInArrow(moments, "i int, j int, inner double, mean double, outer double")
    cells = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("inner", "mean", "outer")])  # components squared
    own = cells.where("i = j").select(F.col("i").alias("other"), F.col("mean").alias("mean_j"))
    error = F.abs(F.col("inner") + F.col("outer") - F.col("mean") * F.col("mean_j") - (F.col("i") == F.col("j")).cast("double"))
    return float(cells.join(own, F.col("j") == F.col("other")).agg(F.max(error)).first()[0])


def whiten(vectors: DataFrame, model: Whitener, most: int = MOST) -> DataFrame:
    """``vec_id, deviation, whitened array<double>`` for each row of ``vec_id, x``; no shuffle."""
    import pyarrow as pa

    d, id_type = len(model.sums), dict(vectors.dtypes)["vec_id"]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            lengths = [v if v < 1 << 63 else None for v in squared_length(exact_offsets(x, model.n, model.sums))]
            w = model.project(x, most)
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, deviation long, whitened array<double>")


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each vector that counts and each of its (up to 32) components."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    model = fit(vectors)
    if model is None or not len(model.values):
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], kinds)
    k = min(MOST, len(model.values))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
