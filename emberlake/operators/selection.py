"""Feature selection: screen, scores, ranking, and a greedy filter of redundant features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.scalars import sanitize
from emberlake.operators.stats import average_ranks, binned_mutual_information, feature_ranks, label_cells, spearman_by_feature
from emberlake.storage import materialize

#: Values of a feature whose ranks are broadcast.
FEW = 10_000


def gap_shares(df: DataFrame, features: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features], F.lit(1).alias("_"))
    return one.unpivot(["_"], features, "feature", "gap_share").drop("_")


def normalized(column: str):
    """Share of the greatest score; 0 where none is positive. For tables of features."""
    top = F.max(column).over(Window.partitionBy())
    return F.when(top > 0, F.coalesce(F.col(column), F.lit(0.0)) / top).otherwise(0.0)


def rank_features(df: DataFrame, features: list[str], label: str, weight: float = 0.5) -> DataFrame:
    """Features by the weighted mean of normalised |Spearman| and mutual information; both come from the same counts."""
    cells = label_cells(df, features, F.col(label).cast("double"))
    counted = cells, materialize(feature_ranks(cells), "ranks")
    s = spearman_by_feature(df, features, label, counted=counted).withColumn("strength", F.abs("spearman"))
    m = binned_mutual_information(df, features, label, counted=counted)
    both = s.join(m, "feature", "full").join(gap_shares(df, features), "feature", "left")
    scored = both.withColumn("score", weight * normalized("strength") + (1 - weight) * normalized("mutual_information"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "feature")))  # a row for each feature


def correlations(df: DataFrame, features: list[str], keys: list[str], most: int | None = None, read=lambda c: c) -> dict[tuple[str, str], float]:
    """|Spearman| of all pairs of features over all rows without a gap, NaN where one of them does not vary. ``read`` is applied
    to the values of those rows, and leaves none of them unknown. With ``most``, only as many rows by a hash of ``keys`` count.

    Equal rows are told apart once; values take their average rank from counts, and products of ranks are added up in blocks.
    """
    import numpy as np
    import pandas as pd

    from emberlake.operators.sampling import first_by_hash

    rows = df.na.drop("any", subset=features)
    if most is not None:
        rows = first_by_hash(rows, [], keys, df.sparkSession.range(1).select(F.lit(most).alias("_quota")))
    values, ranks = [f"v{i}" for i in range(len(features))], [f"r{i}" for i in range(len(features))]
    told = rows.select(*[read(F.col(f).cast("double")).alias(v) for f, v in zip(features, values)]).groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    told = materialize(told, "sample")
    placed = materialize(average_ranks(told.unpivot(["n"], values, "feature", "x"), ["feature"], "x", "n"), "ranks")
    sizes = {r["feature"]: r["count"] for r in placed.groupBy("feature").count().collect()}  # a row for each feature
    n = told.agg(F.sum("n")).first()[0] or 0
    ranked = told
    for v, r in zip(values, ranks):
        own = placed.where(F.col("feature") == v).select(F.col("x").alias(v), (2 * F.col("rank") - (n + 1)).alias(r))  # from the mean, twice: whole numbers
        ranked = ranked.join(F.broadcast(own) if sizes.get(v, 0) <= FEW else own, v)

    def products(batches):
        total = np.zeros((len(ranks), len(ranks)))
        for b in batches:
            x = b[ranks].to_numpy(float)
            total += (x * b["n"].to_numpy(float)[:, None]).T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    m = np.zeros((len(ranks), len(ranks)))
    for p in ranked.select("n", *ranks).mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # a row for each pair
        m[p["i"], p["j"]] = p["s"]
    bottom = np.sqrt(np.outer(np.diag(m), np.diag(m)))
    rho = np.abs(np.divide(m, bottom, out=np.full(m.shape, np.nan), where=bottom > 0))
    return {(a, b): float(rho[i, j]) for i, a in enumerate(features) for j, b in enumerate(features)}


def greedy(ranking: list[str], strength: dict[tuple[str, str], float], top_k: int, bound: float = 0.85) -> tuple[list[str], list[str]]:
    """Scan by rank: reject what correlates with an accepted feature, accept up to ``top_k``. Returns (accepted, redundant)."""
    accepted: list[str] = []
    redundant: list[str] = []
    for f in ranking:
        if any(strength.get((f, a), 0.0) >= bound for a in accepted):
            redundant.append(f)
        elif len(accepted) < top_k:
            accepted.append(f)
    return accepted, redundant


def select_features(train: DataFrame, features: list[str], label: str, keys: list[str], top_k: int, most_gaps: float = 0.5) -> DataFrame:
    """The ranking of training rows with ``redundant`` and ``selected``; scores and redundancy come from all rows."""
    numbers = train.withColumns({f: F.col(f).cast("double") for f in features})
    clean = numbers.withColumns({f: sanitize(F.col(f)) for f in features})
    gaps = {r["feature"]: r["gap_share"] for r in gap_shares(clean, features).collect()}  # a row for each feature
    kept = [f for f in features if (gaps[f] or 0) <= most_gaps]
    ranking = materialize(rank_features(clean, kept, label), "ranking")  # a row for each feature
    order = [r["feature"] for r in ranking.orderBy("rank").collect()]
    accepted, redundant = greedy(order, correlations(numbers, kept, keys, read=sanitize), top_k)
    return ranking.withColumn("redundant", F.col("feature").isin(redundant)).withColumn("selected", F.col("feature").isin(accepted))


def feature_columns(df: DataFrame, base: list[str], slow: dict[str, list[str]], mode: str) -> list[str]:
    """Base columns that exist, every ``tsf_`` column, and the slow series' columns of a mode (``all`` takes every mode)."""
    have = set(df.columns)
    chosen = [c for k, cols in slow.items() if mode in (k, "all") for c in cols]
    only_slow = mode == "slow_only"
    wanted = [c for cols in slow.values() for c in cols] if only_slow else [*base, *sorted(c for c in have if c.startswith("tsf_")), *chosen]
    return [c for c in dict.fromkeys(wanted) if c in have]
