"""Comparing runs: latest, best, composite scores, means by model, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, by: list[str], metric: str, tie: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def mean_by_model(df: DataFrame, scenario: str, model: str, metric: str) -> DataFrame:
    return df.groupBy(scenario, model).agg(F.avg(metric).alias(metric))


def metric_pivot(df: DataFrame, scenario: str, model: str, metric: str, scenarios: list) -> DataFrame:
    """Models by scenarios; the scenarios are given, so no extra pass looks for them."""
    return df.groupBy(model).pivot(scenario, scenarios).agg(F.avg(metric))


def top_k_means(df: DataFrame, stage: str, metric: str, tie: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(stage).orderBy(F.col(metric).desc_nulls_last(), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias(f"mean_{metric}"))


# fixed values: which variations count as the searched ones, and words that mark a baseline and a base with derived features
SEARCHED = {"GridSearch + SMOTE": "smote", "GridSearch + weights": "weights"}
BASELINE_WORD = "dummy"
DERIVED_WORD = "calculated"


def stages(df: DataFrame, scenario: str, model: str, variation: str, order: list[str], kinds: list[str]) -> DataFrame:
    """The latest run of each scenario, model and variation with its ``stage_group`` and ``stage``.

    Stage 1 holds the baselines, 2 the searched models (``kinds``) on bases without derived features, 3 those on bases
    with them; all other runs go. Null variations are a variation, null scenarios are bases without derived features.
    """
    w = Window.partitionBy(scenario, model, variation).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    latest = df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    has = lambda c, word: F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    base = F.when(has(scenario, DERIVED_WORD), "derived").otherwise("plain")
    how = F.lit(None)
    for label, name in SEARCHED.items():
        how = F.when(F.col(variation) == label, name).otherwise(how)
    searched = F.when(F.col(model).isin(kinds), F.concat_ws("_", F.lit("model"), base, F.when(how.isNotNull(), how)))
    group = F.when(has(model, BASELINE_WORD), F.concat_ws("_", F.lit("baseline"), base)).when(how.isNotNull(), searched)
    place = F.when(F.col("stage_group").startswith("baseline"), 1).when(F.col("stage_group").startswith("model_plain"), 2).otherwise(3)
    return latest.withColumn("stage_group", group).where("stage_group IS NOT NULL").withColumn("stage", place)
