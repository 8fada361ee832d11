"""The driver's tables in the roles of the library: observations, events to label, panels, metrics.

Each role exists twice, as a DataFrame and as a SQL common table expression, for queries and checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def station(df: DataFrame) -> DataFrame:
    return df.withColumns({"city": F.pmod("user_id", F.lit(10)), "hour": F.date_trunc("hour", "ts")})


def observations(spark, d: str) -> DataFrame:
    """Station-hours with mean value and number of readings."""
    e = station(table(spark, d, "events").where(F.col("event_type").isin("view", "click")))
    return e.groupBy("city", "hour").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


OBS = "obs AS (SELECT user_id % 10 AS city, date_trunc('hour', ts) AS hour, avg(value) AS value, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)"


def detections(spark, d: str) -> DataFrame:
    """Events to label with, power and id."""
    return station(table(spark, d, "events").where("event_type = 'error'")).select("city", "hour", F.col("value").alias("power"), "event_id")


DET = "det AS (SELECT user_id % 10 AS city, date_trunc('hour', ts) AS hour, value AS power, event_id FROM events WHERE event_type = 'error')"


def readings(spark, d: str, events: DataFrame | None = None) -> DataFrame:
    """Single readings in time order with gaps: every seventh value unknown. ``events`` may be a stream of that table."""
    e = station(table(spark, d, "events") if events is None else events)
    return e.select("event_id", "city", "ts", "hour", "event_type", F.when(F.col("event_id") % 7 == 3, None).otherwise(F.col("value")).alias("x"))


READ = "readings AS (SELECT event_id, user_id % 10 AS city, ts, date_trunc('hour', ts) AS hour, event_type, CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS x FROM events)"


def panel(spark, d: str) -> DataFrame:
    """Yearly panel with injected gaps and codes."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        "l_orderkey", n.alias("line"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.when(n % 7 == 0, None).when(n % 5 == 0, -9999.0).otherwise(F.col("l_quantity")).alias("a"),
        F.when(n % 3 == 0, None).otherwise(F.col("l_extendedprice")).alias("b"), F.when((F.col("l_partkey") % 11) == 0, -999.0).otherwise(F.col("l_discount")).alias("c"),
        F.col("l_tax").alias("e"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


PANEL = """panel AS (SELECT l_orderkey, l_linenumber AS line, l_suppkey AS entity, l_partkey AS part, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month,
  CASE WHEN l_linenumber % 7 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN -9999.0::DOUBLE ELSE l_quantity END AS a,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END AS b,
  CASE WHEN l_partkey % 11 = 0 THEN -999.0::DOUBLE ELSE l_discount END AS c, l_tax AS e, (l_returnflag = 'R')::INT AS label FROM lineitem)"""

CLEAN = """clean AS (SELECT * REPLACE (CASE WHEN a IN (-999, -9999) THEN NULL ELSE a END AS a, CASE WHEN b IN (-999, -9999) THEN NULL ELSE b END AS b,
  CASE WHEN c IN (-999, -9999) THEN NULL ELSE c END AS c, CASE WHEN e IN (-999, -9999) THEN NULL ELSE e END AS e) FROM panel)"""


def runs(spark, d: str) -> DataFrame:
    """Metrics of runs: suppliers as models, brands as scenarios, years as stages."""
    o = table(spark, d, "lineitem")
    return o.groupBy((F.col("l_suppkey") % 5).alias("model"), (F.col("l_partkey") % 4).alias("scenario"), F.year("l_shipdate").alias("run")).agg(
        F.avg("l_discount").alias("pr_auc"), F.avg("l_tax").alias("roc_auc"), F.count(F.lit(1)).alias("rows_used")
    )


RUNS = "runs AS (SELECT l_suppkey % 5 AS model, l_partkey % 4 AS scenario, year(l_shipdate)::INT AS run, avg(l_discount) AS pr_auc, avg(l_tax) AS roc_auc, count(*) AS rows_used FROM lineitem GROUP BY ALL)"
