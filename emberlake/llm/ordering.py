"""Positions, neighbours and running totals in a global order, without a single-task sort.

The narrow key table is range-partitioned once and written; each partition is then numbered by
itself, and the bases of partitions come from a prefix sum over one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.storage import materialize, shuffle_width


def with_order(
    narrow: DataFrame, order: list[str], sums: dict[str, str] | None = None, lead: list[str] | None = None
) -> DataFrame:
    """Add ``_pos`` (rank from 0), ``_before_<name>`` (exclusive running sums) and ``_next_<col>``.

    ``order`` must be a total order up to identical rows (nulls sort first). ``sums`` maps a name to a
    non-null long column; ``lead`` lists columns whose value in the next row is wanted (null after the
    last). Only the number of partitions, not of rows, passes through one task.
    """
    spark = narrow.sparkSession
    sums, lead = sums or {}, lead or []
    parts = materialize(
        narrow.repartitionByRange(shuffle_width(spark), *order).withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    keys = [F.col(c).asc_nulls_first() for c in order]
    first = F.min_by(F.struct(*lead), F.struct(*order)) if lead else F.lit(None)
    totals = parts.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()], first.alias("_first")
    )
    over_parts = Window.orderBy("_part")
    earlier = over_parts.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums],
        F.lead("_first").over(over_parts).alias("_first_of_next"),
    )
    within = Window.partitionBy("_part").orderBy(*keys)
    prior = within.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition: bounded by the number of shuffle partitions
    joined = parts.join(F.broadcast(bases), "_part")
    out = joined.withColumn("_pos", (F.row_number().over(within) - 1 + F.col("_base")).cast("long"))
    for n, c in sums.items():
        out = out.withColumn(f"_before_{n}", (F.coalesce(F.sum(c).over(prior), F.lit(0)) + F.col(f"_base_{n}")).cast("long"))
    if lead:
        out = out.withColumn("_lead", F.coalesce(F.lead(F.struct(*lead)).over(within), F.col("_first_of_next")))
        for c in lead:
            out = out.withColumn(f"_next_{c}", F.col(f"_lead.{c}"))
    keep = [*narrow.columns, "_pos", *[f"_before_{n}" for n in sums], *[f"_next_{c}" for c in lead]]
    return out.select(*keep)
