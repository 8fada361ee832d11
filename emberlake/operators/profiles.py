"""Audits: missing data, duplicates, parity, coverage, schemas. Audit tables are the product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.scalars import MISSING_CODES, haversine, inside_box, is_missing


def null_profile(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """For each column the missing rows in all, among positives and among negatives; one pass, then an unpivot."""
    gap = lambda c: is_missing(F.col(c)).cast("long")
    one = df.agg(*[F.struct(F.sum(gap(c)).alias("missing"), F.sum(gap(c) * F.col(label)).alias("in_positives"), F.sum(gap(c) * (1 - F.col(label))).alias("in_negatives")).alias(c) for c in columns], F.count(F.lit(1)).alias("_rows"))
    rows = one.unpivot(["_rows"], columns, "column_name", "_s")
    return rows.select("column_name", "_s.missing", "_s.in_positives", "_s.in_negatives", F.round(F.col("_s.missing") / F.col("_rows"), 6).alias("share"))


def row_missing(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rows with any missing column, by class."""
    any_gap = F.exists(F.array(*[is_missing(F.col(c)) for c in columns]), lambda x: x).cast("long")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(any_gap).alias("n_missing"))


def scenario_profile(df: DataFrame, group: str, measures: list[str], label: str) -> DataFrame:
    """Class counts, nulls and codes by group, with the global row (null group) from the same pass."""
    cols = [F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_positive")]
    for m in measures:
        cols += [F.sum(F.col(m).isNull().cast("long")).alias(f"{m}_nulls"), F.sum(F.coalesce(F.col(m).cast("double").isin(*MISSING_CODES), F.lit(False)).cast("long")).alias(f"{m}_codes")]
    return df.rollup(group).agg(*cols)


def source_profile(df: DataFrame, columns: list[str], year: str, label: str) -> DataFrame:
    """One row about a source: size, classes, years, missing values of each column."""
    any_gap = F.exists(F.array(*[is_missing(F.col(c)) for c in columns]), lambda x: x).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(any_gap).alias("n_any_missing"), F.sum(F.col(label).cast("long")).alias("n_positive"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), *[F.sum(is_missing(F.col(c)).cast("long")).alias(f"{c}_missing") for c in columns],
    )


def duplicate_ratio(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Rows over distinct keys, with bands: below 1.01 OK, below 1.10 SOFT_DUP, else DUPLICATED.

    Counted in two steps so that no distinct set is gathered in one task.
    """
    per_key = df.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy(group).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    ratio = F.col("n_rows") / F.col("n_keys")
    return out.withColumns({"ratio": F.round(ratio, 6), "status": F.when(ratio < 1.01, "OK").when(ratio < 1.10, "SOFT_DUP").otherwise("DUPLICATED")})


def duplicate_states(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row for each table: size, distinct keys, their ratio and its band; NO_KEYS without a key column, EMPTY without rows."""
    out = None
    for name, df in tables.items():
        absent = [k for k in keys if k not in df.columns]
        if absent:
            one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("long").alias("n_keys"))
        else:
            one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
        ratio = F.col("n_rows") / F.nullif(F.col("n_keys"), F.lit(0))
        status = F.lit("NO_KEYS") if absent else F.when(ratio.isNull(), "EMPTY").when(ratio < 1.01, "OK").when(ratio < 1.10, "SOFT_DUP").otherwise("DUPLICATED")
        one = one.select(F.lit(name).alias("table_name"), "n_rows", "n_keys", F.round(ratio, 4).alias("ratio"), status.alias("status"), F.lit(";".join(absent)).alias("absent"))
        out = one if out is None else out.unionByName(one)
    return out


def station_years(df: DataFrame, by: list[str], lat: str, lon: str, city: str, order: list[str], jitter: float = 50.0) -> DataFrame:
    """One row for each key: median place, rows, distinct places beyond ``jitter`` metres of it, whether there are any,
    and the first city in ``order`` (null if that row has none). Rows without both coordinates do not count.

    Rows are counted by place first, so a group's medians are taken from its distinct places.
    """
    places = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*by, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(city).alias("city"))).alias("_first")
    )
    middle = places.groupBy(*by).agg(
        F.percentile("_lat", 0.5, F.col("_n")).alias("lat_median"), F.percentile("_lon", 0.5, F.col("_n")).alias("lon_median"), F.sum("_n").alias("n_obs"), F.min("_first")["city"].alias("first_city"),
    )
    away = haversine(F.col("lat_median"), F.col("lon_median"), F.col("_lat"), F.col("_lon")) > jitter
    far = places.join(middle, by).groupBy(*by).agg(F.sum(away.cast("long")).alias("n_far"))
    return middle.join(far, by).withColumn("ambiguous", F.col("n_far") > 0)


def row_parity(one: DataFrame, two: DataFrame, group: str) -> DataFrame:
    n = lambda df, name: df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    both = n(one, "rows_a").join(n(two, "rows_b"), group, "full").withColumn("delta", F.col("rows_b") - F.col("rows_a"))
    status = F.when(F.col("delta").isNull(), "N/A").when(F.col("delta") == 0, "MATCH").when(F.col("delta") < 0, "FEWER").otherwise("MORE")
    return both.withColumn("status", status)


def duplicates_by_class(df: DataFrame, keys: list[str], event_id: str, label: str) -> DataFrame:
    """Surplus rows: negatives by key, positives by key and event."""
    neg = df.where(F.col(label) == 0).groupBy(*keys).count()
    pos = df.where(F.col(label) == 1).groupBy(*keys, event_id).count()
    one = lambda d, c: d.agg(F.lit(c).alias("class"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"), F.count(F.lit(1)).alias("n_keys"))
    return one(neg, 0).unionByName(one(pos, 1))


def spellings(df: DataFrame, raw: str, normal) -> DataFrame:
    """Counts by raw and normalised spelling; nulls are a group."""
    return df.groupBy(F.col(raw).alias("raw"), normal.alias("normal")).agg(F.count(F.lit(1)).alias("n"))


def top_spellings(counts: DataFrame, most: int = 20) -> DataFrame:
    """The raw spellings with most rows, of ``spellings``; equal counts in order of spelling."""
    return counts.groupBy("raw").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), F.col("raw").asc_nulls_last()).limit(most)


def box_report(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], alert: float = 0.01) -> DataFrame:
    """Rows that ``inside_box`` removes, their share, and whether it is above ``alert``."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((~inside_box(F.col(lat), F.col(lon), box)).cast("long")), F.lit(0)).alias("n_removed"))
    share = F.coalesce(F.col("n_removed") / F.nullif(F.col("n_rows"), F.lit(0)), F.lit(0.0))
    return out.withColumns({"share": F.round(share, 6), "alert": share > alert})


def year_stats(df: DataFrame, by: list[str], label: str, columns: list[str]) -> DataFrame:
    share = lambda c: F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"{c}_null_share")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(label).cast("long")).alias("n_positive"), F.round(F.avg(F.col(label).cast("double")), 6).alias("rate"), *[share(c) for c in columns])


def year_alignment(base: DataFrame, others: dict[str, DataFrame], year: str) -> DataFrame:
    """Rows of each year in each table beside the base table: EQUAL, FEWER, MORE, ONLY_IN_BASE or ONLY_IN_TABLE."""
    n = lambda df, name: df.groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias(name))
    out = None
    for name, df in others.items():
        one = n(base, "n_base").join(n(df, "n_rows"), "year", "full").withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    status = (
        F.when(F.col("n_rows").isNull(), "ONLY_IN_BASE").when(F.col("n_base").isNull(), "ONLY_IN_TABLE").when(F.col("n_rows") == F.col("n_base"), "EQUAL")
        .when(F.col("n_rows") < F.col("n_base"), "FEWER").otherwise("MORE")
    )
    return out.select("table_name", "year", "n_base", "n_rows", status.alias("status"))


def selected_against_rest(df: DataFrame, selected: list[int], year: str, label: str, columns: list[str]) -> DataFrame:
    """Statistics of the selected years beside those of all others."""
    return year_stats(df.withColumn("part", F.when(F.col(year).isin(selected), "selected").otherwise("rest")), ["part"], label, columns)


def compare_schemas(spark, reference: T.StructType, others: dict[str, T.StructType], core: tuple[str, ...] = ()) -> DataFrame:
    """Columns missing, extra or of another type against a reference; float widths count as light drift."""
    ref, rows = {f.name: f.dataType.simpleString() for f in reference}, []
    for name, schema in others.items():
        have = {f.name: f.dataType.simpleString() for f in schema}
        rows += [(name, c, "missing", "heavy" if c in core else "light") for c in ref if c not in have]
        rows += [(name, c, "extra", "light") for c in have if c not in ref]
        rows += [(name, c, f"{ref[c]} -> {have[c]}", "light" if {ref[c], have[c]} == {"float", "double"} else "heavy") for c in ref if c in have and ref[c] != have[c]]
    return spark.createDataFrame(rows, "table_name string, column_name string, difference string, weight string")


def known_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, n_rows, n_known`` of all columns, by one scan and one row of counts a table."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"known_{i}") for i, c in enumerate(df.columns)])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"known_{i}").alias("n_known")) for i, c in enumerate(df.columns)]))
        one = counts.select(F.lit(name).alias("table_name"), "n_rows", each.alias("c")).select("table_name", "c.column_name", "n_rows", "c.n_known")
        out = one if out is None else out.unionByName(one)
    return out


def schema_audit(spark, reference: DataFrame, others: dict[str, DataFrame], core: tuple[str, ...] = ()) -> DataFrame:
    """Differences of schema, each with the rows of its table and how many have a value there (null where the column is missing)."""
    found = compare_schemas(spark, reference.schema, {n: df.schema for n, df in others.items()}, core)
    return found.join(known_values(others), ["table_name", "column_name"], "left")


def split_summary(df: DataFrame, split: str, keys: list[str], year: str, label: str) -> DataFrame:
    per_key = df.groupBy(split, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"), F.min(year).alias("a"), F.max(year).alias("b"))
    return per_key.groupBy(split).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("dup_ratio"),
        F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.sum("pos").alias("n_positive"), F.round(F.sum("pos") / F.sum("n"), 6).alias("rate"),
    )
