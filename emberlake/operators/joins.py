"""Joins: labels, lookups with contracts, as-of and nearest-cell joins, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.scans import fill_forward, fresh


class NotUnique(ValueError):
    """A side that must have one row for each key has more."""


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, first in an explicit total order."""
    w, rank = Window.partitionBy(*keys).orderBy(*order), fresh(df, "_rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def strongest(events: DataFrame, keys: list[str], power: str, tie: str) -> DataFrame:
    """The event of highest power for each key; unread power is least, ties go to the smaller ``tie``."""
    return first_per_key(events, keys, [F.col(power).desc_nulls_last(), F.col(tie).asc()])


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice. One aggregate; a single row reaches the driver."""
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if worst and worst > 1:
        raise NotUnique(f"{keys} is not unique: {worst} rows share one key")
    return df


def join_m1(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join of many to one with that contract checked; ``matched`` tells which rows found a partner."""
    if check:
        require_unique(right, keys)
    hit = fresh(left.join(right, keys, "left"), "_hit")
    joined = left.join(right.withColumn(hit, F.lit(True)), keys, "left")
    return joined.withColumn("matched", F.coalesce(hit, F.lit(False))).drop(hit)


def label_observations(observations: DataFrame, events: DataFrame, keys: list[str], event_id: str, label: str = "has_event") -> DataFrame:
    """Label each observation by whether an event of its key exists; events have unique keys."""
    return observations.join(events, keys, "left").withColumn(label, F.col(event_id).isNotNull().cast("int"))


def members_only(df: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the dictionary has; Spark broadcasts the dictionary if its size allows."""
    return df.join(dictionary.select(*keys).distinct(), keys, "left_semi")


def lookup_with_fallback(df: DataFrame, dimension: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Take ``values`` (dimension column -> own column) from the dimension, else from the row; ``source`` tells which."""
    hit, found = fresh(df, "_hit"), fresh(df, "_found")
    took = {dim: f"{found}_{i}" for i, dim in enumerate(values)}
    side = dimension.select(*keys, *[F.col(dim).alias(n) for dim, n in took.items()], F.lit(True).alias(hit))
    rows = df.join(side, keys, "left")
    new = {own: F.coalesce(F.col(took[dim]), F.col(own)) for dim, own in values.items()} | {"source": F.when(F.col(hit), "dimension").otherwise("row")}
    return rows.withColumns(new).drop(hit, *took.values())


def propagate(df: DataFrame, canonical: DataFrame, keys: list[str], values: list[str], order: list[Column]) -> DataFrame:
    """Carry values over by exact key from a canonical table, of which the first row of a key counts."""
    return df.join(first_per_key(canonical, keys, order).select(*keys, *values), keys, "left")


def propagate_report(df: DataFrame, canonical: DataFrame, keys: list[str], values: list[str], order: list[Column]) -> DataFrame:
    """Of ``propagate``: rows, rows whose key the canonical table lacks, and nulls of each value after it."""
    hit = first_per_key(canonical, keys, order).select(*keys, *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(1).alias("_hit"))
    nulls = [F.coalesce(F.sum(F.col(f"_v_{v}").isNull().cast("long")), F.lit(0)).alias(f"{v}_nulls") for v in values]
    return df.select(*keys).join(hit, keys, "left").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("_hit").isNull().cast("long")), F.lit(0)).alias("n_missing"), *nulls)


def pair_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``scenario_pair``: rows of the join, and rows of one side whose key the other lacks. Null keys match nothing."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "_l").join(n(right, "_r"), keys, "full")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(s(F.col("_l") * F.col("_r")).alias("n_both"), s(F.when(F.col("_r").isNull(), F.col("_l"))).alias("n_left_only"), s(F.when(F.col("_l").isNull(), F.col("_r"))).alias("n_right_only"))


def scenario_pair(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join of two variants of a table, values side by side."""
    name = lambda df, s: df.select(*keys, *[F.col(v).alias(v + s) for v in values])
    return name(left, suffixes[0]).join(name(right, suffixes[1]), keys)


def attach_features(base: DataFrame, tables: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Left-join selected features of several tables; one row a key of each, so rows cannot grow."""
    out = base
    for t in tables:
        out = out.join(first_per_key(t, keys, order), keys, "left")
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key with the sides that have it: common, left, right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "common").when(F.col("l").isNotNull(), "left").otherwise("right")
    return a.join(b, key, "full").select(key, side.alias("side"))


def coverage_shares(sides: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("side") == s).cast("long"))
    c, left, right = n("common"), n("left"), n("right")
    return sides.agg(c.alias("n_common"), left.alias("n_left_only"), right.alias("n_right_only"), F.round(c / (c + left), 6).alias("left_share"), F.round(c / (c + right), 6).alias("right_share"))


def as_of(rows: DataFrame, series: DataFrame, keys: list[str], ts: str, values: list[str], series_order: list[str], fill: bool = True) -> DataFrame:
    """Each row with the latest values of its keys at or before its time: rows and series as one ordered table, whose last
    known value is carried on from range partition to range partition. No theta join, and no task holds a whole key.

    Of equal times in the series the last in ``series_order`` counts. With ``fill`` a null value is
    replaced by the last known one, else the whole last row counts. Null keys are one key.
    """
    last = first_per_key(series, [*keys, ts], [F.col(c).desc() for c in series_order]).select(*keys, ts, *values)
    side, found, whole = (fresh(rows, n) for n in ("_side", "_found", "_row"))
    own = {v: f"{found}_{i}" for i, v in enumerate(values)}
    a = rows.withColumns({n: F.lit(None).cast(dict(series.dtypes)[v]) for v, n in own.items()} | {side: F.lit(1)})
    b = last.select(*keys, ts, *[F.col(v).alias(n) for v, n in own.items()], F.lit(0).alias(side))
    both = a.unionByName(b, allowMissingColumns=True)
    if fill:
        out = fill_forward(both, keys, [ts, side], {n: n for n in own.values()})
    else:
        row = F.when(F.col(side) == 0, F.struct(*own.values()))
        out = fill_forward(both.withColumn(whole, row), keys, [ts, side], {whole: whole})
        out = out.withColumns({n: F.col(whole)[n] for n in own.values()})
    return out.where(F.col(side) == 1).select(*rows.columns, *[F.col(n).alias(v) for v, n in own.items()])


def nearest_cell(points: DataFrame, grid: DataFrame, *, day: str, lat: str, lon: str, value: str, step: float, tolerance: float) -> DataFrame:
    """Each point with the nearest grid cell of its day, if within the tolerance on both axes.

    Cells fall into buckets of ``step``; a point looks into all buckets that its tolerance reaches. Equal
    points are looked up once and come back as often as they came in.
    """
    ring = range(-max(1, math.ceil(tolerance / step)), max(1, math.ceil(tolerance / step)) + 1)
    bucket = lambda c: F.floor(c / step).cast("long")
    glat, glon, took, by, bx, b, times, far, copy = (fresh(points, n) for n in ("_glat", "_glon", "_took", "_by", "_bx", "_b", "_times", "_d", "_copy"))
    cells = grid.select(F.col(day), F.col(lat).alias(glat), F.col(lon).alias(glon), F.col(value).alias(took), bucket(F.col(lat)).alias(by), bucket(F.col(lon)).alias(bx))
    near = [F.struct((bucket(F.col(lat)) + dy).alias("y"), (bucket(F.col(lon)) + dx).alias("x")) for dy in ring for dx in ring]
    probe = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias(times)).withColumn(b, F.explode(F.array(*near))).withColumns({by: F.col(b)["y"], bx: F.col(b)["x"]}).drop(b)
    dy, dx = F.abs(F.col(lat) - F.col(glat)), F.abs(F.col(lon) - F.col(glon))
    hit = probe.join(cells, [day, by, bx], "left").withColumn(far, F.when((dy <= tolerance) & (dx <= tolerance), dy * dy + dx * dx))
    reached = F.col(far).isNotNull()
    best = hit.groupBy(*points.columns, times).agg(F.min_by(F.when(reached, F.col(took)), F.when(reached, F.struct(far, glat, glon))).alias(value))
    return best.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).drop(copy, times)
