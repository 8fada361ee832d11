"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlake.functions import scalars, text
from emberlake.operators import embedding, forecast, joins, leaderboard, models, profiles, sampling, selection, series, stats
from emberlake.plans.bindings import CLEAN, DET, OBS, PANEL, READ, RUNS, detections, observations, panel, readings, runs, station, table
from emberlake.sources import tables
from emberlake.storage import materialize, shared_folder
from emberlake.streaming import carried

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- labels ---------------------------------------------------------------------------------------


@query(f"""WITH {OBS}, {DET},
best AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY city, hour ORDER BY power DESC NULLS LAST, event_id) = 1)
SELECT city, count(*) AS n_hours, sum((event_id IS NOT NULL)::INT)::BIGINT AS n_positive, round(avg((event_id IS NOT NULL)::INT::DOUBLE), 6) AS rate,
       round(coalesce(sum(power), 0), 4) AS total_power FROM obs LEFT JOIN best USING (city, hour) GROUP BY city""")
def hourly_label(spark, d):
    """Which station-hours had an event, and how often."""
    best = joins.strongest(detections(spark, d), ["city", "hour"], "power", "event_id")
    rows = joins.label_observations(observations(spark, d), best, ["city", "hour"], "event_id")
    return rows.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_hours"), F.sum(F.col("has_event").cast("long")).alias("n_positive"), F.round(F.avg(F.col("has_event").cast("double")), 6).alias("rate"),
        F.round(F.coalesce(F.sum("power"), F.lit(0.0)), 4).alias("total_power"),
    )


@query(f"WITH {DET} SELECT city, hour, power, event_id FROM det QUALIFY row_number() OVER (PARTITION BY city, hour ORDER BY power DESC NULLS LAST, event_id) = 1")
def strongest_event(spark, d):
    return joins.strongest(detections(spark, d), ["city", "hour"], "power", "event_id")


@query("""SELECT event_type, sum(CASE WHEN value >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_one, count(*) AS n_rows FROM events GROUP BY event_type""")
def label_norm(spark, d):
    e = table(spark, d, "events").withColumn("y", scalars.label_01(F.col("value"), "double"))
    return e.groupBy("event_type").agg(F.sum(F.col("y").cast("long")).alias("n_one"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT toxic AS label, count(*) AS n FROM labels WHERE toxic IN (0, 1) GROUP BY toxic")
def strict_labels(spark, d):
    raw = table(spark, d, "labels").select(F.col("toxic").cast("string").alias("label"))
    return scalars.strict_label(raw, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- text and scalars -------------------------------------------------------------------------------


@query("""SELECT key, count(*) AS n FROM (
SELECT trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM documents) GROUP BY key""")
def norm_key(spark, d):
    return table(spark, d, "documents").select(text.normalize_key(F.col("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, upper(trim(regexp_replace(replace(strip_accents(text), 'ß', 'SS'), '\\s+', ' ', 'g'))) AS shown FROM documents")
def display_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.display_form(F.col("text")).alias("shown"))


_HOURS = "CASE event_id % 5 WHEN 0 THEN lpad(hour(ts)::VARCHAR, 2, '0') || '00 UTC' WHEN 1 THEN hour(ts)::VARCHAR WHEN 2 THEN hour(ts)::VARCHAR || ':15' WHEN 3 THEN lpad(hour(ts)::VARCHAR, 2, '0') || '30' ELSE 'none' END"


@query("SELECT event_id, (CASE WHEN event_id % 5 = 4 THEN 0 ELSE hour(ts) END)::INT AS hour FROM events")
def hour_parse(spark, d):
    e = table(spark, d, "events")
    h = F.hour("ts").cast("string")
    two, k = F.lpad(h, 2, "0"), F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(two, F.lit("00 UTC"))).when(k == 1, h).when(k == 2, F.concat(h, F.lit(":15"))).when(k == 3, F.concat(two, F.lit("30"))).otherwise("none")
    return e.select("event_id", scalars.parse_hour(raw).alias("hour"))


@query("SELECT event_id, date_trunc('hour', ts) AS at, date_trunc('hour', ts) AS floored FROM events")
def hour_stamp(spark, d):
    e = table(spark, d, "events")
    built = scalars.hour_timestamp(F.date_format("ts", "yyyy/MM/dd"), F.hour("ts"))
    return e.select("event_id", built.alias("at"), scalars.floor_hour(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).alias("floored"))


@query(f"""WITH {PANEL} SELECT 'all' AS policy, count(*) AS n FROM panel WHERE NOT (coalesce(a IN (-999, -9999), true) AND coalesce(b IN (-999, -9999), true) AND coalesce(c IN (-999, -9999), true))
UNION ALL SELECT 'any', count(*) FROM panel WHERE NOT (coalesce(a IN (-999, -9999), false) OR coalesce(b IN (-999, -9999), false) OR coalesce(c IN (-999, -9999), false))""")
def sentinel_filter(spark, d):
    p = panel(spark, d)
    one = lambda policy: scalars.drop_sentinel_rows(p, ["a", "b", "c"], policy).agg(F.lit(policy).alias("policy"), F.count(F.lit(1)).alias("n"))
    return one("all").unionByName(one("any"))


@query(f"WITH {PANEL}, {CLEAN} SELECT year, count(a) AS n_a, count(b) AS n_b, count(c) AS n_c, round(sum(a), 4) AS sum_a FROM clean GROUP BY year")
def missing_clean(spark, d):
    p = scalars.clean_missing(panel(spark, d).withColumn("a", F.replace(F.col("a").cast("string"), F.lit("."), F.lit(","))), ["a", "b", "c"])
    return p.groupBy("year").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("c").alias("n_c"), F.round(F.sum("a"), 4).alias("sum_a"))


@query(f"WITH {PANEL} SELECT year, count(coalesce(a, b)) AS n, sum(coalesce((a <> b)::INT, 0))::BIGINT AS conflicts FROM panel GROUP BY year")
def spellings_merged(spark, d):
    p = scalars.coalesce_spellings(panel(spark, d), "a", "b")
    return p.groupBy("year").agg(F.count("a").alias("n"), F.sum(F.col("a_conflict").cast("long")).alias("conflicts"))


_PLACE = "(s_suppkey * 37 % 160) / 10.0 - 20 AS lat, (s_suppkey * 53 % 200) / 10.0 - 60 AS lon"


def _places(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", (k * 37 % 160 / 10.0 - 20).cast("double").alias("lat"), (k * 53 % 200 / 10.0 - 60).cast("double").alias("lon"))


_PLACES = "places AS (SELECT s_suppkey, s_name, s_nationkey, ((s_suppkey * 37 % 160) / 10.0 - 20)::DOUBLE AS lat, ((s_suppkey * 53 % 200) / 10.0 - 60)::DOUBLE AS lon FROM supplier)"


@query(f"""WITH {_PLACES} SELECT s_suppkey, round(2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(-15.0 - lat) / 2), 2)
+ cos(radians(lat)) * cos(radians(-15.0)) * pow(sin(radians(-47.0 - lon) / 2), 2), 1.0))), 2) AS metres FROM places""")
def haversine(spark, d):
    m = scalars.haversine(F.col("lat"), F.col("lon"), F.lit(-15.0), F.lit(-47.0))
    return _places(spark, d).select("s_suppkey", F.round(m, 2).alias("metres"))


@query(f"WITH {_PLACES} SELECT count(*) AS n_kept FROM places WHERE lat BETWEEN -16 AND -8 AND lon BETWEEN -55 AND -45")
def box_filter(spark, d):
    return _places(spark, d).where(scalars.inside_box(F.col("lat"), F.col("lon"), (-16, -8, -55, -45))).agg(F.count(F.lit(1)).alias("n_kept"))


@query("""SELECT l_orderkey % 50 AS g, sum(coalesce((l_quantity > 30)::INT, 0))::BIGINT AS hot, sum((l_quantity < 15)::INT)::BIGINT AS critical,
sum((l_quantity >= 15 AND l_quantity < 30)::INT)::BIGINT AS low, round(avg(l_tax * l_quantity / (l_quantity + 1)), 6) AS spread FROM lineitem GROUP BY 1""")
def risk_flags(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    rows = li.withColumns(scalars.risk_flags(q, q, F.col("l_tax")))
    s = lambda c: F.sum(F.col(c).cast("long"))
    return rows.groupBy((F.col("l_orderkey") % 50).alias("g")).agg(s("hot").alias("hot"), s("critical_humidity").alias("critical"), s("low_humidity").alias("low"), F.round(F.avg("spread"), 6).alias("spread"))


@query(f"""WITH {_PLACES} SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN printf('%.5f_%.5f', lat, lon) ELSE 'event_' || s_suppkey::VARCHAR END AS site FROM places""")
def site_keys(spark, d):
    key = F.when(F.col("s_suppkey") % 3 == 0, "nan").otherwise(F.col("s_suppkey").cast("string"))
    return _places(spark, d).select("s_suppkey", scalars.site_key(key, F.col("lat"), F.col("lon")).alias("site"))


@query("""SELECT event_id, round(1 / (1 + exp(-greatest(-50, least(50, value - 30)))), 8) AS p, CASE WHEN event_id % 9 = 0 THEN NULL ELSE least(value, 100.0) END AS clipped FROM events""")
def sanitized(spark, d):
    e = table(spark, d, "events")
    x = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", F.round(scalars.sigmoid(F.col("value") - 30), 8).alias("p"), scalars.sanitize(x, 100.0).alias("clipped"))


@query("SELECT event_type, count(*) FILTER (value BETWEEN 0 AND 50) AS n_inside, count(*) AS n FROM events GROUP BY event_type")
def domain_rules(spark, d):
    e = scalars.domain_rules(table(spark, d, "events"), {"value": (0.0, 50.0)})
    return e.groupBy("event_type").agg(F.count("value").alias("n_inside"), F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand, CASE p_size % 2 WHEN 0 THEN 'E radiation knn calculated' ELSE 'C no-radiation dropped' END AS label, 'ewma' AS method, 'humid' AS variable, count(*) AS n
FROM part GROUP BY p_brand, p_size % 2""")
def name_labels(spark, d):
    p = table(spark, d, "part").withColumn("folder", F.when(F.col("p_size") % 2 == 0, "base_E_with_rad_knn_calculated").otherwise("base_C_no_rad_drop_rows"))
    f = F.lit("tsf_ewma_humid_a05")
    return p.groupBy("p_brand", text.scenario_label(F.col("folder")).alias("label"), text.method_of(f).alias("method"), text.variable_of(f).alias("variable")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.iso_dates(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("day"))


@query("SELECT user_id % 10 AS city, count(*) AS n FROM events WHERE user_id % 10 IN (1, 4) AND year(ts) = 2024 GROUP BY 1")
def subset_filter(spark, d):
    e = station(table(spark, d, "events")).where(F.col("city").isin(1, 4) & (F.year("ts") == 2024))
    return e.groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# --- joins ---------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA')""")
def biome_semi(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    return joins.members_only(table(spark, d, "supplier"), places, ["s_nationkey"]).select("s_suppkey", "s_name")


@query("""SELECT (c_custkey IS NOT NULL) AS matched, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey GROUP BY 1""")
def manual_match(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return joins.join_m1(table(spark, d, "orders"), c, ["o_custkey"]).groupBy("matched").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT l_suppkey, year(l_shipdate)::INT AS year, CASE WHEN s_suppkey IS NULL THEN 'row' ELSE 'dimension' END AS source, count(*) AS n,
round(avg(coalesce(s_acctbal, l_tax)), 4) AS v FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON l_suppkey = s_suppkey GROUP BY ALL""")
def station_dim(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_tax").alias("v"))
    dim = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    rows = joins.lookup_with_fallback(li, dim, ["l_suppkey"], {"s_acctbal": "v"})
    return rows.groupBy("l_suppkey", "year", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("v"))


@query(f"""WITH {OBS}, s AS (SELECT user_id % 10 AS city, ts, arg_max(value, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT obs.city, hour, round(value, 6) AS value, v AS composite FROM obs ASOF LEFT JOIN s ON obs.city = s.city AND obs.hour >= s.ts""")
def asof_composite(spark, d):
    s = station(table(spark, d, "events").where("event_type = 'signup'")).select("city", F.col("ts").alias("hour"), F.col("value").alias("composite"), "event_id")
    rows = joins.as_of(observations(spark, d).select("city", "hour", "value"), s, ["city"], "hour", ["composite"], ["event_id"])
    return rows.select("city", "hour", F.round("value", 6).alias("value"), "composite")


@query("""WITH c AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT c_custkey, o_totalprice AS v FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def propagate(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return joins.propagate(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], ["v"], [F.col("o_orderkey")])


@query(f"""WITH {OBS}, e AS (SELECT user_id % 10 AS city, date_trunc('hour', ts) AS hour, avg(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT obs.city, obs.hour, round(obs.value, 6) AS value_a, round(e.value, 6) AS value_b FROM obs JOIN e USING (city, hour)""")
def scenario_pair(spark, d):
    b = station(table(spark, d, "events").where("event_type = 'purchase'")).groupBy("city", "hour").agg(F.avg("value").alias("value"))
    rows = joins.scenario_pair(observations(spark, d), b, ["city", "hour"], ["value"])
    return rows.select("city", "hour", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"))


@query("""WITH f AS (SELECT l_orderkey, l_quantity AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice) = 1)
SELECT o_orderkey, o_totalprice, q FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def champion(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("q"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    order = [F.col("l_linenumber").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return joins.attach_features(base, [f], ["o_orderkey"], order).select("o_orderkey", "o_totalprice", "q")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS n_orders, b.n AS n_lines FROM (SELECT o_orderdate AS k, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT l_shipdate AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k""")
def score_tables(spark, d):
    """Days of orders and of shipments; the first and last days are in one table only."""
    a = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("k")).agg(F.count(F.lit(1)).alias("n_lines"))
    return a.join(b, "k", "full")


_SIDES = """a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND user_id % 7 <> 0), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view' AND user_id % 5 <> 0),
sides AS (SELECT k, CASE WHEN k IN (SELECT k FROM b) THEN 'common' ELSE 'left' END AS side FROM a UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a))"""


def _sides(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "k")
    return joins.coverage(e.where("event_type = 'error' AND k % 7 <> 0"), e.where("event_type = 'view' AND k % 5 <> 0"), "k")


@query(f"WITH {_SIDES} SELECT k, side FROM sides")
def coverage(spark, d):
    return _sides(spark, d)


@query(f"""WITH {_SIDES}, c AS (SELECT count(*) FILTER (side = 'common') AS x, count(*) FILTER (side = 'left') AS y, count(*) FILTER (side = 'right') AS z FROM sides)
SELECT x AS n_common, y AS n_left_only, z AS n_right_only, round(x / (x + y), 6) AS left_share, round(x / (x + z), 6) AS right_share FROM c""")
def coverage_share(spark, d):
    return joins.coverage_shares(_sides(spark, d))


_GRID = """grid AS (SELECT p_partkey % 3 AS day, (p_partkey // 3 % 45 - 22)::DOUBLE AS lat, (p_partkey // 135 - 60)::DOUBLE AS lon, min(p_retailprice) AS v FROM part GROUP BY ALL)"""


@query(f"""WITH {_PLACES}, pts AS (SELECT s_suppkey, s_suppkey % 3 AS day, lat, lon FROM places), {_GRID}
SELECT s_suppkey, (SELECT v FROM grid g WHERE g.day = p.day AND abs(g.lat - p.lat) <= 0.6 AND abs(g.lon - p.lon) <= 0.6
 ORDER BY (g.lat - p.lat) * (g.lat - p.lat) + (g.lon - p.lon) * (g.lon - p.lon), g.lat, g.lon LIMIT 1) AS v FROM pts p""")
def nearest_cell(spark, d):
    pts = _places(spark, d).select("s_suppkey", (F.col("s_suppkey") % 3).alias("day"), "lat", "lon")
    k = F.col("p_partkey")
    grid = table(spark, d, "part").groupBy((k % 3).alias("day"), (F.floor(k / 3) % 45 - 22).cast("double").alias("lat"), (F.floor(k / 135) - 60).cast("double").alias("lon")).agg(F.min("p_retailprice").alias("v"))
    return joins.nearest_cell(pts, grid, day="day", lat="lat", lon="lon", value="v", step=1.0, tolerance=0.6).select("s_suppkey", "v")


@query("""SELECT year, city FROM (SELECT year(o_orderdate)::BIGINT AS year, o_custkey % 20 AS city FROM orders) GROUP BY ALL HAVING year >= 1996 AND city <> 3""")
def key_sets(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), (F.col("o_custkey") % 20).alias("city"))
    return o.where("year >= 1996").select("year", "city").intersect(o.select("year", "city")).subtract(o.where("city = 3").select("year", "city")).distinct()


# --- aggregates ---------------------------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT city, hour, round(value, 6) AS value FROM obs")
def series_agg(spark, d):
    e = station(table(spark, d, "events").where(F.col("event_type").isin("view", "click"))).drop("ts")
    return series.series_mean(e, ["city"], "hour", ["value"]).select("city", "hour", F.round("value", 6).alias("value"))


@query("""SELECT l_suppkey, l_returnflag, array_to_string(list_sort(list(DISTINCT year(l_shipdate))), ';') AS years FROM lineitem GROUP BY ALL""")
def years_string(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return tables.biome_dictionary(li, ["l_suppkey"], "l_returnflag", "year")


@query("""SELECT l_suppkey, year(l_shipdate)::INT AS year, round(median(l_discount), 6) AS med, count(*) AS n, count(DISTINCT l_tax) AS n_distinct FROM lineitem GROUP BY ALL""")
def station_median(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.round(F.median("l_discount"), 6).alias("med"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_tax").alias("n_distinct"))


_GUESSES = ((5, "mean_5"), (20, "mean_20"))


@query(f"""WITH {READ}, p AS ({" UNION ALL ".join(f"SELECT '{m}' AS method, city, ts, x, avg(x) OVER (PARTITION BY city ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS guess FROM readings" for k, m in _GUESSES)}),
q AS (SELECT method, city, date_trunc('day', ts) AS day, avg(abs(guess - x)) AS mae, avg((guess - x) * (guess - x)) AS mse, CASE WHEN var_pop(x) > 0 THEN 1 - avg((guess - x) * (guess - x)) / var_pop(x) END AS r2
  FROM p WHERE x IS NOT NULL AND guess IS NOT NULL GROUP BY ALL),
r AS (SELECT method, day, avg(mae) AS mae, avg(mse) AS mse, avg(r2) AS r2 FROM q GROUP BY ALL),
m AS (SELECT method, count(*) AS n_groups, avg(mae) AS mae, avg(mse) AS mse, avg(r2) AS r2 FROM r GROUP BY method)
SELECT method, n_groups, round(mae, 4) AS mae, round(mse, 2) AS mse, round(r2, 4) AS r2, rank() OVER (ORDER BY mae NULLS LAST) AS place FROM m""")
def method_ranking(spark, d):
    quality = None
    for k, name in _GUESSES:
        w = Window.partitionBy("city").orderBy("ts", "event_id").rowsBetween(-k, -1)
        rows = readings(spark, d).withColumns({"guess": F.avg("x").over(w), "method": F.lit(name), "day": F.date_trunc("day", "ts")})
        one = stats.forecast_quality(rows, ["method", "city", "day"], "x", "guess")
        quality = one if quality is None else quality.unionByName(one)
    ranked = stats.method_ranking(stats.quality_rollup(quality, ["method", "day"], "city"), "method")
    return ranked.select("method", "n_groups", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("r2", 4).alias("r2"), "place")


@query(f"""WITH {READ}, p AS (SELECT city, x, avg(x) OVER (PARTITION BY city ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS guess FROM readings)
SELECT city, count(*) AS n, round(avg(abs(guess - x)), 4) AS mae, round(avg((guess - x) * (guess - x)), 3) AS mse, round(1 - avg((guess - x) * (guess - x)) / var_pop(x), 5) AS r2
FROM p WHERE x IS NOT NULL AND guess IS NOT NULL GROUP BY city""")
def forecast_quality(spark, d):
    w = Window.partitionBy("city").orderBy("ts", "event_id").rowsBetween(-5, -1)
    q = stats.forecast_quality(readings(spark, d).withColumn("guess", F.avg("x").over(w)), ["city"], "x", "guess")
    return q.select("city", "n", F.round("mae", 4).alias("mae"), F.round("mse", 3).alias("mse"), F.round("r2", 5).alias("r2"))


@query(f"""WITH {READ}, p AS (SELECT city, date_trunc('day', ts) AS period, sum((event_type = 'error')::INT)::DOUBLE AS y, avg(x) AS x FROM readings GROUP BY 1, 2),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p WHERE x IS NOT NULL)
SELECT 'x' AS variable, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k""")
def period_corr(spark, d):
    r = readings(spark, d).withColumn("y", (F.col("event_type") == "error").cast("int"))
    c = stats.period_correlation(r, ["city"], "ts", "day", "y", ["x"])
    return c.select("variable", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


_PSI = """CASE WHEN {0} < 6 THEN [-0.5772156649015329, 0.42278433509846713, 0.9227843350984671, 1.2561176684318005, 1.5061176684318005][{0}::INT]
ELSE ln({0}) - 0.5 / {0} - (1.0 / ({0} * {0})) * (1.0::DOUBLE / 12 - (1.0 / ({0} * {0})) * (1.0::DOUBLE / 120 - (1.0 / ({0} * {0})) / 252)) END"""


@query(f"""WITH {PANEL}, {CLEAN}, long AS (SELECT label::DOUBLE AS y, ('0x' || substr(md5(l_orderkey || '|' || line || '|' || part || '|' || entity), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u, f, v
  FROM clean UNPIVOT INCLUDE NULLS (v FOR f IN (a, b, c, e)) WHERE label IS NOT NULL),
med AS (SELECT f, coalesce(median(v), 0) AS m FROM long GROUP BY f), filled AS (SELECT y, u, f, coalesce(v, m) AS v FROM long JOIN med USING (f)),
k AS (SELECT f, greatest(stddev_pop(v), avg(abs(v))) AS s, max(abs(v)) AS most FROM filled GROUP BY f),
p AS (SELECT f, y, most, v + u * pow(2.0::DOUBLE, floor(log2(s))) * 1e-10::DOUBLE AS x, count(*) OVER (PARTITION BY f, y)::DOUBLE AS mates, row_number() OVER () AS id FROM filled JOIN k USING (f)),
r AS (SELECT *, greatest(0, least({", ".join(f"greatest(coalesce(x - lag(x, {3 - i}) OVER w, 1e300), coalesce(lead(x, {i}) OVER w - x, 1e300))" for i in range(4))}) - 1e-14::DOUBLE * most) AS radius FROM p WINDOW w AS (PARTITION BY f, y ORDER BY x)),
ev AS (SELECT f, id, x - radius AS spot, 0 AS side FROM r UNION ALL SELECT f, id, x, 1 FROM r UNION ALL SELECT f, id, x + radius, 2 FROM r),
n AS (SELECT f, id, side, sum((side = 1)::INT) OVER (PARTITION BY f ORDER BY spot, side) AS n FROM ev),
m AS (SELECT f, id, greatest(1, sum(CASE side WHEN 2 THEN n WHEN 0 THEN -n END))::DOUBLE AS m FROM n GROUP BY f, id),
t AS (SELECT f, count(*)::DOUBLE AS n, avg({_PSI.format("mates")}) AS a, avg({_PSI.format("m")}) AS b FROM m JOIN r USING (f, id) GROUP BY f)
SELECT f AS feature, round(greatest(0, {_PSI.format("n")} + {_PSI.format("3.0::DOUBLE")} - a - b), 6) AS mutual_information FROM t""")
def nearest_mi(spark, d):
    """Scores of the clean panel's features by k nearest neighbours, over all rows."""
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c", "e"])
    scores = stats.nearest_mutual_information(p, ["a", "b", "c", "e"], "label", ["l_orderkey", "line", "part", "entity"])
    return scores.select("feature", F.round("mutual_information", 6).alias("mutual_information"))


_RANKED = """long AS (SELECT label::DOUBLE AS y, f, x FROM clean UNPIVOT (x FOR f IN (a, b, c, e)) WHERE label IS NOT NULL)"""


@query(f"""WITH {PANEL}, {CLEAN}, {_RANKED}, r AS (SELECT f, (rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0)::DOUBLE AS rx,
(rank() OVER (PARTITION BY f ORDER BY y) + (count(*) OVER (PARTITION BY f, y) - 1) / 2.0)::DOUBLE AS ry FROM long)
SELECT f AS feature, count(*) AS n_obs, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY f""")
def feature_spearman(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c", "e"])
    return stats.spearman_by_feature(p, ["a", "b", "c", "e"], "label").select("feature", "n_obs", F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {PANEL}, {CLEAN}, {_RANKED}, r AS (SELECT f, y, least(15, floor((rank() OVER (PARTITION BY f ORDER BY x) + (count(*) OVER (PARTITION BY f, x) - 1) / 2.0 - 0.5) * 16
/ count(*) OVER (PARTITION BY f))) AS bin FROM long), c AS (SELECT f, y, bin, count(*)::DOUBLE AS c FROM r GROUP BY ALL),
t AS (SELECT f, c / sum(c) OVER (PARTITION BY f) * ln(c * sum(c) OVER (PARTITION BY f) / (sum(c) OVER (PARTITION BY f, bin) * sum(c) OVER (PARTITION BY f, y))) AS t FROM c)
SELECT f AS feature, round(greatest(0, sum(t)), 6) AS mutual_information FROM t GROUP BY f""")
def binned_mi(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c", "e"])
    return stats.binned_mutual_information(p, ["a", "b", "c", "e"], "label").select("feature", F.round("mutual_information", 6).alias("mutual_information"))


_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NULL AND label = 1) AS in_positives, count(*) FILTER ({c} IS NULL AND label = 0) AS in_negatives, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM clean" for c in "abce")


@query(f"WITH {PANEL}, {CLEAN} {_NULLS}")
def null_profile(spark, d):
    return profiles.null_profile(panel(spark, d), ["a", "b", "c", "e"], "label")


@query(f"WITH {PANEL}, {CLEAN} SELECT label, count(*) AS n_rows, count(*) FILTER (a IS NULL OR b IS NULL OR c IS NULL) AS n_missing FROM clean GROUP BY label")
def row_missing(spark, d):
    return profiles.row_missing(panel(spark, d), ["a", "b", "c"], "label")


@query(f"""WITH {PANEL} SELECT year, count(*) AS n_rows, sum(label)::BIGINT AS n_positive, count(*) FILTER (a IS NULL) AS a_nulls, count(*) FILTER (a IN (-999, -9999)) AS a_codes,
count(*) FILTER (c IS NULL) AS c_nulls, count(*) FILTER (c IN (-999, -9999)) AS c_codes FROM panel GROUP BY ROLLUP (year)""")
def scenario_profile(spark, d):
    return profiles.scenario_profile(panel(spark, d), "year", ["a", "c"], "label")


@query(f"""WITH {PANEL}, {CLEAN} SELECT count(*) AS n_rows, count(*) FILTER (a IS NULL OR b IS NULL) AS n_any_missing, sum(label)::BIGINT AS n_positive, min(year) AS first_year, max(year) AS last_year,
count(*) FILTER (a IS NULL) AS a_missing, count(*) FILTER (b IS NULL) AS b_missing FROM clean""")
def source_profile(spark, d):
    return profiles.source_profile(panel(spark, d), ["a", "b"], "year", "label")


@query(f"""WITH {PANEL}, k AS (SELECT year, l_orderkey, line, count(*) AS n FROM panel GROUP BY ALL)
SELECT year, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, round(sum(n) / count(*), 6) AS ratio,
CASE WHEN sum(n) / count(*) < 1.01 THEN 'OK' WHEN sum(n) / count(*) < 1.10 THEN 'SOFT_DUP' ELSE 'DUPLICATED' END AS status FROM k GROUP BY year""")
def dup_ratio(spark, d):
    return profiles.duplicate_ratio(panel(spark, d), "year", ["l_orderkey", "line"])


_STATES = """SELECT '{0}' AS table_name, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, round(sum(n) / count(*), 4) AS ratio,
CASE WHEN sum(n) / count(*) < 1.01 THEN 'OK' WHEN sum(n) / count(*) < 1.10 THEN 'SOFT_DUP' ELSE 'DUPLICATED' END AS status, '' AS absent FROM (SELECT count(*) AS n FROM panel GROUP BY l_orderkey, {1})"""


@query(f"""WITH {PANEL} {_STATES.format("panel", "line")} UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), NULL, NULL, 'NO_KEYS', 'l_orderkey;line'
UNION ALL SELECT 'none', 0, 0, NULL, 'EMPTY', '' WHERE (SELECT count(*) FROM panel WHERE year < 0) = 0""")
def dup_states(spark, d):
    p = panel(spark, d)
    return profiles.duplicate_states({"panel": p, "orders": table(spark, d, "orders"), "none": p.where("year < 0")}, ["l_orderkey", "line"])


_FIXES = """fixes AS (SELECT l_suppkey AS station, year(l_shipdate)::INT AS year, l_orderkey, l_linenumber, l_returnflag AS city,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE -15 + round(l_discount * 100) / 10000 END AS lat, -47 + round(l_tax * 100) / 40000 AS lon FROM lineitem)"""


@query(f"""WITH {_FIXES}, m AS (SELECT station, year, median(lat) AS y, median(lon) AS x, count(*) AS n_obs, arg_min(city, (l_orderkey, l_linenumber, city)) AS first_city FROM fixes WHERE lat IS NOT NULL GROUP BY ALL),
f AS (SELECT station, year, sum((2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2), 1.0))) > 50.5)::INT)::BIGINT AS n_far
 FROM (SELECT DISTINCT station, year, lat, lon FROM fixes WHERE lat IS NOT NULL) JOIN m USING (station, year) GROUP BY ALL)
SELECT station, year, round(y, 6) AS lat_median, round(x, 6) AS lon_median, n_obs, first_city, n_far, n_far > 0 AS ambiguous FROM m JOIN f USING (station, year)""")
def station_years(spark, d):
    li = table(spark, d, "lineitem")
    lat = F.when(F.col("l_orderkey") % 17 == 0, None).otherwise(-15 + F.round(F.col("l_discount") * 100) / 10000)
    rows = li.select(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("city"), lat.alias("lat"), (-47 + F.round(F.col("l_tax") * 100) / 40000).alias("lon"))
    out = profiles.station_years(rows, ["station", "year"], "lat", "lon", "city", ["l_orderkey", "l_linenumber"], jitter=50.5)
    return out.withColumns({"lat_median": F.round("lat_median", 6), "lon_median": F.round("lon_median", 6)})


@query(f"""WITH {_PLACES}, c AS (SELECT count(*) AS n_rows, sum((NOT (lat BETWEEN -16 AND -8 AND lon BETWEEN -55 AND -45))::INT)::BIGINT AS n_removed FROM places)
SELECT n_rows, n_removed, round(n_removed / n_rows, 6) AS share, n_removed / n_rows > 0.01 AS alert FROM c""")
def box_report(spark, d):
    return profiles.box_report(_places(spark, d), "lat", "lon", (-16, -8, -55, -45))


@query("SELECT p_name AS raw, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, raw NULLS LAST LIMIT 20")
def top_spellings(spark, d):
    return profiles.top_spellings(profiles.spellings(table(spark, d, "part"), "p_name", text.normalize_key(F.col("p_name"))))


@query("""WITH c AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT count(*) AS n_rows, sum((o_custkey IS NULL)::INT)::BIGINT AS n_missing, sum((v IS NULL)::INT)::BIGINT AS v_nulls FROM customer LEFT JOIN c ON c_custkey = o_custkey""")
def propagate_report(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"), "o_orderkey")
    return joins.propagate_report(table(spark, d, "customer"), o, ["c_custkey"], ["v"], [F.col("o_orderkey")])


@query("""WITH a AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'view' AND user_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(sum(a.n * b.n), 0)::BIGINT AS n_both, coalesce(sum(a.n) FILTER (b.k IS NULL), 0)::BIGINT AS n_left_only, coalesce(sum(b.n) FILTER (a.k IS NULL), 0)::BIGINT AS n_right_only FROM a FULL JOIN b ON a.k = b.k""")
def pair_report(spark, d):
    e = table(spark, d, "events")
    return joins.pair_report(e.where("event_type = 'error'"), e.where("event_type = 'view' AND user_id % 5 <> 0"), ["user_id"])


@query("SELECT year::INT AS year FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders INTERSECT SELECT DISTINCT year(l_shipdate) FROM lineitem) WHERE year >= 1994 AND year IN (1993, 1995, 1996, 1997)")
def chosen_years(spark, d):
    years = lambda t, c: table(spark, d, t).select(F.year(c).alias("year"))
    return tables.chosen_years(years("orders", "o_orderdate"), years("lineitem", "l_shipdate"), 1994, [1993, 1995, 1996, 1997])


_VARIATIONS = ("GridSearch + SMOTE", "GridSearch + weights", "Base")


@query(f"""WITH r AS (SELECT CASE l_partkey % 4 WHEN 0 THEN 'base_E_calculated' WHEN 1 THEN 'base_F' WHEN 2 THEN 'base_D_calculated' ELSE NULL END AS scenario,
 CASE l_suppkey % 3 WHEN 0 THEN 'Dummy (stratified)' WHEN 1 THEN 'Random Forest' ELSE 'Other' END AS model, CASE l_linenumber % 3 WHEN 0 THEN '{_VARIATIONS[0]}' WHEN 1 THEN '{_VARIATIONS[1]}' ELSE '{_VARIATIONS[2]}' END AS variation,
 year(l_shipdate)::INT AS run, avg(l_discount) AS pr_auc FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN contains(coalesce(scenario, ''), 'calculated') THEN 'derived' ELSE 'plain' END AS base FROM r QUALIFY row_number() OVER (PARTITION BY scenario, model, variation ORDER BY run DESC) = 1),
g AS (SELECT *, CASE WHEN model LIKE 'Dummy%' THEN 'baseline_' || base WHEN model = 'Random Forest' AND variation LIKE '%SMOTE' THEN 'model_' || base || '_smote'
 WHEN model = 'Random Forest' AND variation LIKE '%weights' THEN 'model_' || base || '_weights' END AS stage_group FROM s)
SELECT scenario, model, variation, run, round(pr_auc, 6) AS pr_auc, stage_group, CASE WHEN stage_group LIKE 'baseline%' THEN 1 WHEN stage_group LIKE 'model_plain%' THEN 2 ELSE 3 END AS stage FROM g WHERE stage_group IS NOT NULL""")
def stage_labels(spark, d):
    k = F.col("l_partkey") % 4
    scenario = F.when(k == 0, "base_E_calculated").when(k == 1, "base_F").when(k == 2, "base_D_calculated")
    pick = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % 3 + 1).cast("int"))
    runs_ = table(spark, d, "lineitem").groupBy(
        scenario.alias("scenario"), pick("l_suppkey", ("Dummy (stratified)", "Random Forest", "Other")).alias("model"), pick("l_linenumber", _VARIATIONS).alias("variation"), F.year("l_shipdate").alias("run"),
    ).agg(F.avg("l_discount").alias("pr_auc"))
    out = leaderboard.stages(runs_, "scenario", "model", "variation", ["run"], ["Random Forest"])
    return out.withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"""WITH {PANEL}, x AS (SELECT year, count(*) AS rows_a FROM panel WHERE year < 2001 GROUP BY 1), y AS (SELECT year, count(*) AS rows_b FROM panel WHERE year > 1995 AND (year <> 1998 OR line <> 1) GROUP BY 1)
SELECT coalesce(x.year, y.year) AS year, rows_a, rows_b, rows_b - rows_a AS delta,
CASE WHEN rows_b - rows_a IS NULL THEN 'N/A' WHEN rows_b = rows_a THEN 'MATCH' WHEN rows_b < rows_a THEN 'FEWER' ELSE 'MORE' END AS status FROM x FULL JOIN y ON x.year = y.year""")
def row_parity(spark, d):
    p = panel(spark, d)
    return profiles.row_parity(p.where("year < 2001"), p.where("year > 1995 AND (year <> 1998 OR line <> 1)"), "year")


@query(f"""WITH {PANEL}, n AS (SELECT count(*) AS c FROM panel WHERE label = 0 GROUP BY l_orderkey, line), p AS (SELECT count(*) AS c FROM panel WHERE label = 1 GROUP BY l_orderkey, line, part)
SELECT 0 AS class, sum(c - 1)::BIGINT AS surplus, count(*) AS n_keys FROM n UNION ALL SELECT 1, sum(c - 1)::BIGINT, count(*) FROM p""")
def dup_by_class(spark, d):
    return profiles.duplicates_by_class(panel(spark, d), ["l_orderkey", "line"], "part", "label")


@query("SELECT p_type AS raw, lower(p_type) AS normal, count(*) AS n FROM part GROUP BY ALL")
def city_spellings(spark, d):
    return profiles.spellings(table(spark, d, "part"), "p_type", text.normalize_key(F.col("p_type")))


@query(f"WITH {PANEL} SELECT year, count(*) AS n_rows, sum(label)::BIGINT AS n_positive, round(avg(label::DOUBLE), 6) AS rate, round(avg((a IS NULL)::INT::DOUBLE), 6) AS a_null_share, round(avg((b IS NULL)::INT::DOUBLE), 6) AS b_null_share FROM panel GROUP BY year")
def year_stats(spark, d):
    return profiles.year_stats(panel(spark, d), ["year"], "label", ["a", "b"])


@query(f"""WITH {PANEL}, o AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT year, count(*) AS n FROM panel GROUP BY year),
t AS (SELECT 'orders' AS table_name, year, b.n AS n_base, o.n AS n_rows FROM b FULL JOIN o USING (year)
  UNION ALL SELECT 'complete', year, b.n, c.n FROM b FULL JOIN (SELECT year, count(*) AS n FROM panel WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY year) c USING (year))
SELECT *, CASE WHEN n_rows IS NULL THEN 'ONLY_IN_BASE' WHEN n_base IS NULL THEN 'ONLY_IN_TABLE' WHEN n_rows = n_base THEN 'EQUAL' WHEN n_rows < n_base THEN 'FEWER' ELSE 'MORE' END AS status FROM t""")
def year_alignment(spark, d):
    p = panel(spark, d)
    others = {"orders": table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), "complete": p.where("a IS NOT NULL AND b IS NOT NULL")}
    return profiles.year_alignment(p, others, "year")


@query(f"""WITH {PANEL} SELECT CASE WHEN year IN (1998, 1999) THEN 'selected' ELSE 'rest' END AS part, count(*) AS n_rows, sum(label)::BIGINT AS n_positive,
round(avg(label::DOUBLE), 6) AS rate, round(avg((a IS NULL)::INT::DOUBLE), 6) AS a_null_share FROM panel GROUP BY ALL""")
def selected_years(spark, d):
    return profiles.selected_against_rest(panel(spark, d), [1998, 1999], "year", "label", ["a"])


_LACKS = "line entity part year month a b c e label".split()
_EXTRA = "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(f"""WITH {PANEL}, lacks AS (SELECT 'lineitem' AS table_name, unnest({_LACKS}) AS column_name UNION ALL SELECT 'float_panel', 'e'),
k AS ({" UNION ALL ".join(f"SELECT 'lineitem' AS table_name, '{c}' AS column_name, 'extra' AS difference, count(*) AS n_rows, count({c}) AS n_known FROM lineitem" for c in _EXTRA)}
 UNION ALL SELECT 'float_panel', 'a', 'double -> float', count(*), count(a) FROM panel UNION ALL SELECT table_name, column_name, 'missing', NULL, NULL FROM lacks)
SELECT table_name, column_name, difference, CASE column_name WHEN 'year' THEN 'heavy' ELSE 'light' END AS weight, n_rows, n_known FROM k""")
def schema_audit(spark, d):
    p = panel(spark, d)
    return profiles.schema_audit(spark, p, {"lineitem": table(spark, d, "lineitem"), "float_panel": p.withColumn("a", F.col("a").cast("float")).drop("e")}, ("year",))


_CALLED = "s AS (SELECT (event_type = 'error')::INT AS y, value / 400.0 AS p, (value >= 30)::INT AS called FROM events)"


def _scored(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 400.0).alias("p"), (F.col("value") >= 30).cast("int").alias("called"))


@query(f"""WITH {_CALLED}, c AS (SELECT count(*) FILTER (y = 1 AND called = 1) AS tp, count(*) FILTER (y = 0 AND called = 1) AS fp, count(*) FILTER (y = 0 AND called = 0) AS tn, count(*) FILTER (y = 1 AND called = 0) AS fn FROM s)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity FROM c""")
def confusion(spark, d):
    c = stats.confusion(_scored(spark, d), "y", "called")
    return c.select("tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1", "specificity")])


_CURVE = """k AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY p), c AS (SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS P_, sum(neg) OVER () AS N_ FROM k WINDOW w AS (ORDER BY p DESC))"""


@query(f"""WITH {_CALLED}, {_CURVE} SELECT round(sum(neg * (tp - pos / 2.0)) / max(P_ * N_), 6) AS roc_auc, round(sum(pos / P_ * (tp / (tp + fp))), 6) AS average_precision,
round((SELECT avg((p - y) * (p - y)) FROM s), 6) AS brier FROM c""")
def ap_auc(spark, d):
    return stats.ranking_metrics(_scored(spark, d), "p", "y").select(*[F.round(x, 6).alias(x) for x in ("roc_auc", "average_precision", "brier")])


@query(f"WITH {_CALLED}, {_CURVE} SELECT round(p, 8) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / P_, 6) AS recall, round(fp / N_, 6) AS fpr, round(tp / (tp + fp), 6) AS \"precision\" FROM c")
def curve_points(spark, d):
    c = stats.curve_points(_scored(spark, d), "p", "y")
    return c.select(F.round("threshold", 8).alias("threshold"), "tp", "fp", *[F.round(x, 6).alias(x) for x in ("recall", "fpr", "precision")])


@query("SELECT count(*) AS n, round(corr(l_discount, l_tax), 6) AS pearson, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem")
def two_measures(spark, d):
    a = stats.agreement(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return a.select("n", F.round("pearson", 6).alias("pearson"), F.round("mae", 6).alias("mae"))


@query(f"WITH {RUNS} PIVOT (SELECT model, scenario, pr_auc FROM runs) ON scenario IN (0, 1, 2, 3) USING round(avg(pr_auc), 6) GROUP BY model")
def metric_pivot(spark, d):
    p = leaderboard.metric_pivot(runs(spark, d), "scenario", "model", "pr_auc", [0, 1, 2, 3])
    return p.select("model", *[F.round(str(i), 6).alias(str(i)) for i in range(4)])


@query(f"""WITH {PANEL}, t AS (SELECT *, CASE WHEN year > (SELECT max(year) FROM panel) - 2 THEN 'test' ELSE 'train' END AS split FROM panel), k AS (SELECT split, l_orderkey, line, count(*) AS n, sum(label) AS pos, min(year) AS a, max(year) AS b FROM t GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_unique, round(sum(n) / count(*), 6) AS dup_ratio, min(a) AS first_year, max(b) AS last_year, sum(pos)::BIGINT AS n_positive, round(sum(pos) / sum(n), 6) AS rate FROM k GROUP BY split""")
def holdout(spark, d):
    return profiles.split_summary(sampling.holdout(panel(spark, d), "year", 2), "split", ["l_orderkey", "line"], "year", "label")


# --- ordered operators --------------------------------------------------------------------------------------


_DRY = f"""WITH {OBS}, w AS (SELECT city, hour, (value >= 60.5)::INT AS wet FROM obs), i AS (SELECT *, sum(wet) OVER (PARTITION BY city ORDER BY hour) AS island FROM w)
SELECT city, hour, round(sum(1 - wet) OVER (PARTITION BY city, island ORDER BY hour) / 24.0, 6) AS dry_days FROM i"""


@query(_DRY)
def dry_spell(spark, d):
    rows = series.dry_spell(observations(spark, d), ["city"], "hour", "value", 60.5)
    return rows.select("city", "hour", F.round("dry_days", 6).alias("dry_days"))


def _in_batches(rows, at, n: int):
    """The rows in ``n`` batches in the order of ``at`` (a number)."""
    first, last = rows.agg(F.min(at), F.max(at)).first()
    batch = F.floor((at - F.lit(first or 0)) * n / F.lit((last or 0) - (first or 0) + 1))
    return [rows.where(batch == i) for i in range(n)]


@query(_DRY)
def dry_spell_carried(spark, d):
    """The same days from three batches in time order, each going on from the state that the one before left."""
    obs = materialize(observations(spark, d), "observations")
    states, out = carried.States(spark), None
    for i, rows in enumerate(_in_batches(obs, F.unix_timestamp("hour"), 3)):
        one = states.run("dry", i, rows, "city long, dry_hours double", lambda b, s: carried.dry_spell_step(b, s, "city", "hour", "value", 60.5))
        out = one if out is None else out.unionByName(one)
    return out.select("city", "hour", F.round("dry_days", 6).alias("dry_days"))


@query(f"WITH {OBS} SELECT city, hour, round(sum(value) OVER (PARTITION BY city ORDER BY hour), 6) AS total FROM obs")
def sums_carried(spark, d):
    """Running sums from four batches, of which the third runs twice."""
    obs = materialize(observations(spark, d), "observations")
    parts, states, out = _in_batches(obs, F.unix_timestamp("hour"), 4), carried.States(spark), None
    for i, again in ((0, False), (1, False), (2, False), (2, True), (3, False)):
        one = states.run("sum", i, parts[i], "city long, total double", lambda b, s: carried.sum_step(b, s, "city", "hour", "value", "total"))
        out = one if out is None else out if again else out.unionByName(one)
    return out.select("city", "hour", F.round("total", 6).alias("total"))


_FOLD = f"""WITH RECURSIVE {READ}, o AS (SELECT city, ts, event_id, x, row_number() OVER (PARTITION BY city ORDER BY ts) AS i FROM readings),
f AS (SELECT city, i, event_id, x AS y, 1.0::DOUBLE AS w FROM o WHERE i = 1
UNION ALL SELECT o.city, o.i, o.event_id,
 CASE WHEN f.y IS NULL THEN o.x WHEN o.x IS NULL THEN f.y ELSE (f.w * 0.7 * f.y + 0.3 * o.x) / (f.w * 0.7 + 0.3) END,
 CASE WHEN f.y IS NULL THEN 1.0 WHEN o.x IS NULL THEN f.w * 0.7 ELSE 1.0 END FROM f JOIN o ON o.city = f.city AND o.i = f.i + 1)"""


@query(f"{_FOLD} SELECT city, event_id, round(y, 6) AS ewma FROM f")
def ewma(spark, d):
    rows = series.ewma(readings(spark, d).select("city", "event_id", "ts", "x"), ["city"], "ts", "x", {"ewma": 0.3})
    return rows.select("city", "event_id", F.round("ewma", 6).alias("ewma"))


@query(f"""{_FOLD}, g AS (SELECT event_id, ts, lag(x, 24) OVER (PARTITION BY city ORDER BY ts) AS lagged FROM readings)
SELECT city, ts, round(y, 6) AS ewma, round(lagged, 6) AS lagged FROM f JOIN g USING (event_id)""")
def feature_stream(spark, d):
    """The exponential mean and a lag of 24 rows as a stream over the files of ``events``."""
    schema = table(spark, d, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, so that a file will do as a folder does
    marks, close = carried.closing(spark)
    rows = carried.feature_stream(readings(spark, d, arriving), "city", "ts", "x", tie="event_id", alpha=0.3, delay="3650 days", marks=marks)
    rows = carried.replay(rows, "features", close)
    return rows.select("city", "ts", F.round("ewma", 6).alias("ewma"), F.round("lagged", 6).alias("lagged"))


@query(f"""WITH {OBS} SELECT city, hour, round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 24) OVER w, 6) AS lag_24 FROM obs WINDOW w AS (PARTITION BY city ORDER BY hour)""")
def lags(spark, d):
    rows = series.lags(observations(spark, d), ["city"], "hour", "value", [1, 24])
    return rows.select("city", "hour", F.round("value_lag_1", 6).alias("lag_1"), F.round("value_lag_24", 6).alias("lag_24"))


@query(f"WITH {OBS} SELECT a.city, a.hour, round(b.value, 6) AS day_before FROM obs a LEFT JOIN obs b ON a.city = b.city AND b.hour = a.hour - INTERVAL 24 HOUR")
def time_lags(spark, d):
    rows = series.lags(observations(spark, d), ["city"], "hour", "value", [24], time_exact=True)
    return rows.select("city", "hour", F.round("value_lag_24", 6).alias("day_before"))


@query(f"WITH {READ} SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY city ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x FROM readings")
def forward_fill(spark, d):
    return series.forward_fill(readings(spark, d), ["city"], "ts", ["x"]).select("event_id", "x")


@query(f"WITH {READ} SELECT event_id, round(sum(coalesce(x, 0)) OVER (PARTITION BY city ORDER BY ts), 3) AS total FROM readings")
def cumsum(spark, d):
    return series.running_sum(readings(spark, d), ["city"], "ts", "x", "total").select("event_id", F.round("total", 3).alias("total"))


# A mean in whole thousandths, half up, from sums of whole hundredths: sums of fractions depend on the order of the rows.
_THOUSANDTHS = "((20 * sum(round({0} * 100)::BIGINT) + count({0})) // (2 * count({0})))::DOUBLE"
_DRIFT = f"""WITH RECURSIVE p AS (SELECT l_suppkey AS s, year(l_shipdate)::INT AS y, -15 + {_THOUSANDTHS.format("l_discount")} / 10000 AS lat, -47 + {_THOUSANDTHS.format("l_tax")} / 10000 AS lon FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY y) AS i FROM p),
f AS (SELECT s, y, i, lat AS alat, lon AS alon, 1 AS version, 0.0::DOUBLE AS dist FROM o WHERE i = 1
UNION ALL SELECT s, y, i, CASE WHEN dist > 50 THEN lat ELSE alat END, CASE WHEN dist > 50 THEN lon ELSE alon END, version + (dist > 50)::INT, dist FROM (
 SELECT o.s, o.y, o.i, o.lat, o.lon, f.alat, f.alon, f.version, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(o.lat - f.alat) / 2), 2) + cos(radians(f.alat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - f.alon) / 2), 2)))) AS dist
 FROM f JOIN o ON o.s = f.s AND o.i = f.i + 1))
SELECT s AS station, y AS year, version, round(dist, 1) AS distance_m FROM f"""


def _yearly_places(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"))
    thousandths = lambda c: F.floor((20 * F.sum(F.round(F.col(c) * 100).cast("long")) + F.count(c)) / (2 * F.count(c)))
    return li.agg((-15 + thousandths("l_discount") / 10000).alias("lat"), (-47 + thousandths("l_tax") / 10000).alias("lon"))


@query(_DRIFT)
def drift(spark, d):
    p = _yearly_places(spark, d)
    return series.anchored_drift(p, "station", "year", "lat", "lon").select("station", "year", "version", F.round("distance_m", 1).alias("distance_m"))


@query(_DRIFT)
def drift_carried(spark, d):
    """The same versions from three batches of years, each going on from the places that the one before accepted."""
    p = materialize(_yearly_places(spark, d), "places")
    states, out = carried.States(spark), None
    for i, rows in enumerate(_in_batches(p, F.col("year"), 3)):
        one = states.run("places", i, rows, "station long, lat double, lon double, version int", lambda b, s: carried.place_step(b, s, "station", "year", "lat", "lon"))
        out = one if out is None else out.unionByName(one)
    return out.select("station", "year", "version", F.round("distance_m", 1).alias("distance_m"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return joins.first_per_key(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem)")
def dedupe_exact(spark, d):
    return table(spark, d, "lineitem").dropDuplicates().agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS} SELECT model, scenario, run, round(pr_auc, 6) AS pr_auc FROM runs QUALIFY row_number() OVER (PARTITION BY model, scenario ORDER BY run DESC) = 1")
def latest_run(spark, d):
    return series.latest(runs(spark, d), ["model", "scenario"], ["run"]).select("model", "scenario", "run", F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {RUNS} SELECT scenario, model, run, round(pr_auc, 6) AS pr_auc FROM runs QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY pr_auc DESC, model, run) = 1")
def best_run(spark, d):
    return leaderboard.best(runs(spark, d), ["scenario"], "pr_auc", ["model", "run"]).select("scenario", "model", "run", F.round("pr_auc", 6).alias("pr_auc"))


@query(f"""WITH {RUNS}, s AS (SELECT *, CASE WHEN max(pr_auc) OVER w = min(pr_auc) OVER w THEN 1.0 ELSE (pr_auc - min(pr_auc) OVER w) / (max(pr_auc) OVER w - min(pr_auc) OVER w) END AS x,
CASE WHEN max(rows_used) OVER w = min(rows_used) OVER w THEN 1.0 ELSE 1 - (rows_used - min(rows_used) OVER w) / (max(rows_used) OVER w - min(rows_used) OVER w) END AS y FROM runs WINDOW w AS (PARTITION BY scenario))
SELECT model, scenario, run, round(0.7 * x + 0.3 * y, 6) AS composite FROM s""")
def composite_score(spark, d):
    rows = series.composite_score(runs(spark, d), ["scenario"], {"pr_auc": 0.7, "rows_used": 0.3}, ("rows_used",))
    return rows.select("model", "scenario", "run", F.round("composite", 6).alias("composite"))


@query(f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pr_auc DESC, model, scenario) AS k FROM runs) SELECT run, count(*) AS n, round(avg(pr_auc), 6) AS mean_pr_auc FROM r WHERE k <= 3 GROUP BY run")
def stage_top_k(spark, d):
    return leaderboard.top_k_means(runs(spark, d), "run", "pr_auc", ["model", "scenario"], 3).select("run", "n", F.round("mean_pr_auc", 6).alias("mean_pr_auc"))


@query(f"WITH {READ} SELECT city, date_trunc('day', ts) AS period, round(avg(x), 6) AS x FROM readings GROUP BY 1, 2")
def daily_mean(spark, d):
    return series.resample_mean(readings(spark, d), ["city"], "ts", ["x"]).select("city", "period", F.round("x", 6).alias("x"))


@query(f"""WITH {READ}, one AS (SELECT city, date_trunc('day', ts) AS day, CASE WHEN event_type IN ('error', 'signup') AND event_id % 3 = 0 THEN x END AS v FROM readings WHERE event_type IN ('error', 'signup') AND event_id % 3 = 0),
m AS (SELECT 'day' AS unit, city, day AS period, avg(v) AS x FROM one GROUP BY ALL UNION ALL SELECT 'week', city, date_trunc('week', day) + INTERVAL 6 DAY, avg(v) FROM one GROUP BY ALL
  UNION ALL SELECT 'all', NULL, day, avg(v) FROM one GROUP BY ALL),
s AS (SELECT unit, city, unnest(generate_series(min(period), max(period), CASE unit WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END)) AS period FROM m GROUP BY unit, city)
SELECT s.unit, s.city, s.period, round(m.x, 6) AS x FROM s LEFT JOIN m ON m.unit = s.unit AND m.city IS NOT DISTINCT FROM s.city AND m.period = s.period""")
def dense_means(spark, d):
    """Days and Sunday-closed weeks without gaps, for each city and for all of them."""
    r = readings(spark, d).where("event_type IN ('error', 'signup') AND event_id % 3 = 0")
    out = None
    for name, by, unit in (("day", ["city"], "day"), ("week", ["city"], "week"), ("all", [], "day")):
        one = series.resample_mean(r, by, "ts", ["x"], unit, dense=True).withColumn("unit", F.lit(name))
        one = one if by else one.withColumn("city", F.lit(None).cast("long"))
        one = one.select("unit", "city", "period", F.round("x", 6).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {READ} SELECT event_id, CASE WHEN count(x) OVER w = 6 THEN round(avg(x) OVER w, 5) END AS x_win_mean, CASE WHEN count(x) OVER w = 6 THEN round(max(x) OVER w - min(x) OVER w, 5) END AS x_win_range
FROM readings WINDOW w AS (PARTITION BY city ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def window_stats(spark, d):
    rows = series.window_stats(readings(spark, d), ["city"], "ts", "x", 6)
    return rows.select("event_id", F.round("x_win_mean", 5).alias("x_win_mean"), F.round("x_win_range", 5).alias("x_win_range"))


@query(f"""WITH {READ} SELECT event_id, last_value(x IGNORE NULLS) OVER w AS filled, round(sum(coalesce(x, 0)) OVER w, 2) AS total, lag(x, 30) OVER (ORDER BY ts) AS lagged,
CASE WHEN count(x) OVER p = 4 THEN round(avg(x) OVER p, 5) END AS mean_4 FROM readings WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING), p AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def one_series(spark, d):
    """All readings as a single series: no operator gives it one task."""
    rows = readings(spark, d).select("event_id", F.lit(0).alias("all"), "ts", "x")
    rows = series.running_sum(rows, ["all"], "ts", "x", "total")
    rows = series.lags(rows, ["all"], "ts", "x", [30])
    rows = series.window_stats(rows, ["all"], "ts", "x", 4)
    rows = series.forward_fill(rows, ["all"], "ts", ["x"])
    return rows.select("event_id", F.col("x").alias("filled"), F.round("total", 2).alias("total"), F.col("x_lag_30").alias("lagged"), F.round("x_win_mean", 5).alias("mean_4"))


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 20")
def top_events(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.col("value").desc(), "event_id").limit(20).select("event_id", "ts", "value")


# --- scenarios and samples ---------------------------------------------------------------------------------------


def _code(c: str) -> str:
    cols = "a, b, c" if c == "D" else "b, c"
    return f"SELECT '{c}' AS scenario, count(*) AS n_rows FROM clean WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in cols.split(", "))


@query(f"WITH {PANEL}, {CLEAN} SELECT 'A' AS scenario, count(*) AS n_rows FROM clean UNION ALL SELECT 'F', count(*) FROM clean UNION ALL {_code('C')} UNION ALL {_code('D')}")
def scenarios_af(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c"])
    out = None
    for code in "AFCD":
        one = sampling.scenario(p, code, ["a", "b", "c"], "a").agg(F.lit(code).alias("scenario"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PANEL}, {CLEAN} SELECT 'B' AS scenario, count(*) AS n_rows, sum((b IS NULL)::INT + (c IS NULL)::INT)::BIGINT AS n_gaps, 0::BIGINT AS n_left FROM clean
UNION ALL SELECT 'E', count(*), sum((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT)::BIGINT, 0::BIGINT FROM clean""")
def scenarios_imputed(spark, d):
    keys = ["l_orderkey", "line", "part", "entity"]
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c"]).select(*keys, "month", "a", "b", "c")
    gaps = lambda names: F.sum(sum((F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("long") for f in names))
    out = None
    for code, names in (("B", ["b", "c"]), ("E", ["a", "b", "c"])):
        donors = sampling.choose_donors(p, names, F.col("month"), keys)
        filled = sampling.scenario(p, code, ["a", "b", "c"], "a", donors, keys).agg(F.count(F.lit(1)).alias("n_rows"), gaps(names).alias("n_left"))
        one = p.agg(gaps(names).alias("n_gaps")).crossJoin(filled).select(F.lit(code).alias("scenario"), "n_rows", "n_gaps", "n_left")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


_HASH = "md5('42|' || {})"


@query(f"""WITH {PANEL}, p AS (SELECT *, l_orderkey || '|' || line || '|' || part || '|' || entity AS k FROM panel), neg AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {_HASH.format('k')}, l_orderkey, line, part, entity) AS r FROM p WHERE label = 0),
pos AS (SELECT year, sum(label)::BIGINT AS n FROM p GROUP BY year)
SELECT year, label, count(*) AS n, sum(part)::BIGINT AS parts FROM (SELECT year, label, part FROM p WHERE label = 1 UNION ALL SELECT neg.year, label, part FROM neg JOIN pos USING (year) WHERE r <= ceil(n * 0.5)) GROUP BY ALL""")
def downsample(spark, d):
    rows = sampling.downsample(panel(spark, d), "label", ["l_orderkey", "line", "part", "entity"], 0.5, per=["year"])
    return rows.groupBy("year", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("parts"))


@query(f"""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format('o_orderkey')}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS t FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE r <= ceil(least(1.0::DOUBLE, 500.0::DOUBLE / t) * n)""")
def proportional_sample(spark, d):
    return sampling.proportional_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 500)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % greatest(1, n // 300) = 0")
def stride_sample(spark, d):
    return sampling.stride_sample(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 300).select("event_id")


@query("""WITH y AS (SELECT year, row_number() OVER (ORDER BY year) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem))
SELECT year, (4 - (n - r) // (n // 5))::INT AS fold FROM y WHERE n - r < 4 * (n // 5)""")
def folds(spark, d):
    return sampling.year_folds(panel(spark, d), "year", "label", 4)


def _donors(spark, d, most: int = 80_000):
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c", "e"])
    return p, sampling.choose_donors(p, ["a", "b", "c", "e"], F.col("month"), ["l_orderkey", "line", "part", "entity"], most)


_NEAR = " UNION ALL ".join(f"""SELECT k, w, '{j}' AS f, CASE WHEN w = 'uniform' THEN list_sum(list_transform(near, lambda p: p.v)) / len(near)
 WHEN near[1].d = 0 THEN list_sum(list_transform(near, lambda p: CASE WHEN p.d = 0 THEN p.v ELSE 0 END)) / list_sum(list_transform(near, lambda p: CASE WHEN p.d = 0 THEN 1.0 ELSE 0.0 END))
 ELSE list_sum(list_transform(near, lambda p: p.v / p.d)) / list_sum(list_transform(near, lambda p: 1.0 / p.d)) END AS v
 FROM (SELECT k, arg_min({{'d': d, 'v': d{j}}}, (d, donor), 5) AS near FROM pairs WHERE {j} IS NULL AND d{j} IS NOT NULL AND d IS NOT NULL GROUP BY k), (VALUES ('uniform'), ('distance')) x(w)""" for j in "abce")
_SQUARES = " + ".join(f"coalesce((g.{j} - r.{j}) * (g.{j} - r.{j}), 0)" for j in "abce")
_SHARED = " + ".join(f"(g.{j} IS NOT NULL AND r.{j} IS NOT NULL)::INT" for j in "abce")


@query(f"""WITH {PANEL}, {CLEAN}, rows AS (SELECT (l_orderkey, line, part, entity) AS k, * FROM clean),
usable AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5('42|' || l_orderkey || '|' || line || '|' || part || '|' || entity), k) AS r, count(*) OVER (PARTITION BY month) AS n, count(*) OVER () AS t
  FROM rows WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (e IS NULL)::INT <= 1),
donors AS (SELECT *, row_number() OVER (ORDER BY k) AS donor FROM usable WHERE r <= ceil(300 * n / t)),
means AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(e) AS e FROM donors),
gaps AS (SELECT DISTINCT k, a, b, c, e FROM rows WHERE a IS NULL OR b IS NULL OR c IS NULL OR e IS NULL),
pairs AS (SELECT g.k, g.a, g.b, g.c, g.e, donor, r.a AS da, r.b AS db, r.c AS dc, r.e AS de, CASE WHEN {_SHARED} > 0 THEN sqrt(({_SQUARES}) * 4 / ({_SHARED})) END AS d FROM gaps g, donors r),
near AS ({_NEAR}), wide AS (PIVOT near ON f IN ('a', 'b', 'c', 'e') USING first(v) GROUP BY k, w)
SELECT w AS weights, l_orderkey, line, round(coalesce(rows.a, wide.a, means.a), 5) AS a, round(coalesce(rows.b, wide.b, means.b), 5) AS b, round(coalesce(rows.c, wide.c, means.c), 5) AS c, round(coalesce(rows.e, wide.e, means.e), 5) AS e
FROM rows CROSS JOIN (VALUES ('uniform'), ('distance')) x(w) CROSS JOIN means LEFT JOIN wide USING (k, w)""")
def knn_impute(spark, d):
    """The whole panel filled from a few donors (``most``), by plain means and by means weighted with inverse distances."""
    (p, donors), out = _donors(spark, d, 300), None
    donors = materialize(donors, "donors")  # chosen once for both
    keys = ["l_orderkey", "line", "part", "entity"]
    for weights in ("uniform", "distance"):
        one = sampling.knn_impute(p.select(*keys, "a", "b", "c", "e"), ["a", "b", "c", "e"], donors, keys, weights=weights)
        one = one.select(F.lit(weights).alias("weights"), "l_orderkey", "line", *[F.round(c, 5).alias(c) for c in "abce"])
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {PANEL}, {CLEAN}, usable AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {_HASH.format("l_orderkey || '|' || line || '|' || part || '|' || entity")}, l_orderkey, line, part, entity) AS r,
  count(*) OVER (PARTITION BY month) AS n, count(*) OVER () AS t FROM clean WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT + (e IS NULL)::INT <= 1)
SELECT l_orderkey, line, part, entity, month FROM usable WHERE r <= ceil(2000 * n / t)""")
def donor_rows(spark, d):
    """Donors of an imputation: rows with few gaps, in proportion to their month."""
    return _donors(spark, d, 2000)[1].select("l_orderkey", "line", "part", "entity", "month")


@query()
def smote(spark, d):
    p = panel(spark, d).withColumn("rare", (F.col("part") % 97 == 5).cast("int"))
    p = p.select("l_orderkey", "line", "part", F.col("e").alias("x"), F.col("label").cast("double").alias("y"), "rare")
    return sampling.smote(p, "rare", ["x", "y"], ["l_orderkey", "line", "part"])


# --- features and models -----------------------------------------------------------------------------------------------


@query()
def rolling_forecast(spark, d):
    rows = observations(spark, d).select("city", "hour", "value", F.col("n").cast("double").alias("n"))
    return forecast.rolling_forecast(rows, ["city"], "hour", "value", ["n"], horizon=24, history=120, least=40, lags=(1, 2))


@query(f"""WITH {OBS}, p AS (SELECT city, hour, value, lag(value) OVER w AS before, row_number() OVER w - 1 AS i FROM obs WINDOW w AS (PARTITION BY city ORDER BY hour)),
f AS (SELECT city, hour, value, before, i, regr_slope(value, before) OVER w AS b, regr_intercept(value, before) OVER w AS a FROM p WINDOW w AS (PARTITION BY city ORDER BY hour ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING))
SELECT city, hour, CASE WHEN i >= 60 THEN round(a + b * before, 3) END AS predicted, CASE WHEN i >= 60 THEN 'ok' ELSE 'skipped' END AS status FROM f""")
def forecast_orders(spark, d):
    """One step ahead by orders (1, 0, 0), fitted again for each hour on the 60 before it."""
    rows = observations(spark, d).select("city", "hour", "value")
    out = forecast.rolling_forecast(rows, ["city"], "hour", "value", [], horizon=1, history=60, least=60, model=forecast.terms((1, 0, 0), ridge=0.0))
    return out.select("city", "hour", F.round("predicted", 3).alias("predicted"), "status")


@query()
def forecast_seasonal(spark, d):
    """A day ahead by orders (2, 1, 1) and (1, 1, 1) with a season of 24 hours."""
    rows = observations(spark, d).select("city", "hour", "value", F.col("n").cast("double").alias("n"))
    model = forecast.terms((2, 1, 1), (1, 1, 1, 24))
    return forecast.rolling_forecast(rows, ["city"], "hour", "value", ["n"], horizon=24, history=240, least=120, model=model)


@query()
def window_embedding(spark, d):
    rows = observations(spark, d).select("city", "hour", "value", F.col("n").cast("double").alias("n"))
    early = F.col("hour") < F.lit(rows.agg(F.percentile_approx("hour", 0.8)).first()[0])  # parameters see no later rows
    return embedding.embed(rows, ["city"], "hour", ["value", "n"], length=16, fitted_on=early)


_FIVE = ("a", "b", "c", "e", "a2")
_ROW_HASH = _HASH.format("l_orderkey || '|' || line || '|' || part || '|' || entity")
_MISS = "CASE WHEN {0} IN (-999, -9999) THEN NULL ELSE {0} END AS {1}"
_MEAN_RANK = "(rank() OVER ({0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {2}{1}) - 1) / 2.0)::DOUBLE"
_TRAIN = f"""train AS (SELECT l_orderkey, line, part, entity, label, {", ".join(_MISS.format("a * 2" if f == "a2" else f, f) for f in _FIVE)} FROM panel WHERE year < 2000)"""
_ALL_PAIRS = f"""picked AS (SELECT {", ".join(_FIVE)} FROM train WHERE {" AND ".join(f"{f} IS NOT NULL" for f in _FIVE)}),
ranks AS (SELECT {", ".join(f"{_MEAN_RANK.format('', f, '')} AS {f}" for f in _FIVE)} FROM picked),
pairs AS ({" UNION ALL ".join(f"SELECT '{f}' AS f, '{g}' AS g, abs(corr({f}, {g})) AS rho FROM ranks" for f in _FIVE for g in _FIVE if f != g)})"""
_PAIRS = _ALL_PAIRS.replace("),\nranks", f" ORDER BY {_ROW_HASH}, l_orderkey, line, part, entity LIMIT 200000),\nranks")  # of a sample


def _train(spark, d):
    p = panel(spark, d).withColumn("a2", F.col("a") * 2)
    return scalars.clean_missing(p, list(_FIVE)).where("year < 2000")


@query(f"""WITH {PANEL}, {_TRAIN} SELECT f AS feature, round(avg((x IS NULL)::INT::DOUBLE), 6) AS gap_share FROM train UNPIVOT INCLUDE NULLS (x FOR f IN ({", ".join(_FIVE)})) GROUP BY f""")
def feature_gaps(spark, d):
    """Share of gaps of each feature in the training years."""
    return selection.gap_shares(_train(spark, d), list(_FIVE)).select("feature", F.round("gap_share", 6).alias("gap_share"))


@query(f"WITH {PANEL}, {_TRAIN}, {_PAIRS} SELECT f AS feature, g AS other, round(rho, 6) AS strength FROM pairs WHERE f < g")
def feature_pairs(spark, d):
    """How features go together, on the operator's sample of rows without a gap."""
    found = selection.correlations(_train(spark, d), list(_FIVE), ["l_orderkey", "line", "part", "entity"], most=200_000)
    rows = spark.createDataFrame([(a, b, x) for (a, b), x in found.items() if a < b], "feature string, other string, strength double")
    return rows.withColumn("strength", F.round("strength", 6))


@query(f"""WITH RECURSIVE {PANEL}, {_TRAIN}, {_ALL_PAIRS}, long AS (SELECT label::DOUBLE AS y, f, x FROM train UNPIVOT (x FOR f IN ({", ".join(_FIVE)})) WHERE label IS NOT NULL),
r AS (SELECT f, y, {_MEAN_RANK.format("PARTITION BY f", "x", "f, ")} AS rx, {_MEAN_RANK.format("PARTITION BY f", "y", "f, ")} AS ry, count(*) OVER (PARTITION BY f) AS n FROM long),
s AS (SELECT f, count(*) AS n_obs, corr(rx, ry) AS spearman FROM r GROUP BY f), c AS (SELECT f, y, least(15, floor((rx - 0.5) * 16 / n)) AS bin, count(*)::DOUBLE AS c FROM r GROUP BY ALL),
t AS (SELECT f, c / sum(c) OVER (PARTITION BY f) * ln(c * sum(c) OVER (PARTITION BY f) / (sum(c) OVER (PARTITION BY f, bin) * sum(c) OVER (PARTITION BY f, y))) AS t FROM c),
m AS (SELECT f, greatest(0, sum(t)) AS mi FROM t GROUP BY f), g AS (SELECT f, avg((x IS NULL)::INT::DOUBLE) AS gap_share FROM train UNPIVOT INCLUDE NULLS (x FOR f IN ({", ".join(_FIVE)})) GROUP BY f),
scored AS (SELECT *, 0.5::DOUBLE * abs(spearman) / max(abs(spearman)) OVER () + 0.5::DOUBLE * mi / max(mi) OVER () AS score FROM s JOIN m USING (f) JOIN g USING (f)),
ranked AS (SELECT scored.*, row_number() OVER (ORDER BY score DESC, f) AS rank, close FROM scored JOIN (SELECT f, coalesce(list(g) FILTER (rho >= 0.85), []) AS close FROM pairs GROUP BY f) USING (f)),
walk AS (SELECT 0::BIGINT AS rank, []::VARCHAR[] AS taken, false AS redundant, false AS selected
  UNION ALL SELECT r.rank, CASE WHEN NOT list_has_any(taken, close) AND len(taken) < 3 THEN list_append(taken, f) ELSE taken END, list_has_any(taken, close), NOT list_has_any(taken, close) AND len(taken) < 3
  FROM walk JOIN ranked r ON r.rank = walk.rank + 1)
SELECT f AS feature, n_obs, round(spearman, 6) AS spearman, round(mi, 6) AS mutual_information, round(gap_share, 6) AS gap_share, round(score, 6) AS score, rank::INT AS rank, redundant, selected FROM ranked JOIN walk USING (rank)""")
def feature_selection(spark, d):
    """The whole selection on training years: screen, both scores, ranking, greedy filter of redundant features."""
    rows = selection.select_features(_train(spark, d), list(_FIVE), "label", ["l_orderkey", "line", "part", "entity"], 3)
    rounded = [F.round(c, 6).alias(c) for c in ("spearman", "mutual_information", "gap_share", "score")]
    return rows.select("feature", "n_obs", *rounded, "rank", "redundant", "selected")


def _split(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["c"]).na.drop("any", subset=["c"])
    return sampling.holdout(p.select("l_orderkey", "line", "part", "year", "c", "e", (F.col("entity") % 10).cast("double").alias("g"), "label"), "year", 2)


@query()
def train_models(spark, d):
    keys = ["l_orderkey", "line", "part"]
    all_ways = models.experiment(_split(spark, d), "D", ["logistic", "naive_bayes"], ["c", "e", "g"], "label", year="year", keys=keys, variations=models.VARIATIONS)
    return all_ways.unionByName(models.experiment(_split(spark, d), "D", ["forest"], ["c", "e", "g"], "label"))


@query()
def experiment_kinds(spark, d):
    """Two scenarios, all kinds of models and both baselines, with their default settings."""
    keys = ["l_orderkey", "line", "part"]
    p = scalars.clean_missing(panel(spark, d), ["b", "c"]).withColumn("g", (F.col("entity") % 10).cast("double"))
    split = lambda features: sampling.holdout(p.select(*keys, "year", *features, "label").na.drop("any", subset=features), "year", 2)
    scenarios = {"C": (split(["c", "e", "g"]), ["c", "e", "g"]), "D": (split(["b", "c", "e", "g"]), ["b", "c", "e", "g"])}
    return models.experiments(scenarios, ["logistic", "naive_bayes", "forest", "boosted", "svm", *models.BASELINES], "label", keys, year="year")


@query()
def saved_model(spark, d):
    """Metrics of a model that was written, read again and scored on the test years; its predictions and curves are exported."""
    keys, split = ["l_orderkey", "line", "part"], materialize(_split(spark, d), "split")
    folder = shared_folder(spark, "model")
    models.save_model(models.train("logistic", split.where("split = 'train'"), ["c", "e", "g"], "label"), folder)
    return models.evaluate_saved(spark, folder, split, keys, "label", 0.25)


_AUDIT = f"""WITH {PANEL}, {CLEAN}, m AS (SELECT max(year) AS y FROM clean), t AS (SELECT *, CASE WHEN year > (SELECT y - 2 FROM m) THEN 'test' WHEN year > (SELECT y - 3 FROM m) THEN 'gap' ELSE 'train' END AS split,
 l_orderkey || '|' || line || '|' || part || '|' || entity AS k FROM clean),
r AS (SELECT *, CASE WHEN b IS NULL OR c IS NULL THEN 'missing' WHEN split = 'gap' THEN 'gap' ELSE 'kept' END AS rule FROM t),
n AS (SELECT split, rule, count(*) AS n, sum(label)::BIGINT AS p FROM r GROUP BY ALL),
q AS (SELECT n - p AS negatives, least(n - p, greatest(1000, ceil(p * 0.5)), greatest(0, 20000 - p))::BIGINT AS take, least(p, 20000) AS positives, p FROM n WHERE split = 'train' AND rule = 'kept')"""


@query(f"""{_AUDIT} SELECT split, rule, n FROM n WHERE rule <> 'kept' UNION ALL SELECT 'test', 'kept', n FROM n WHERE split = 'test' AND rule = 'kept'
UNION ALL SELECT 'train', 'kept', positives + take FROM q UNION ALL SELECT 'train', 'negatives', p - positives + negatives - take FROM q WHERE p - positives + negatives - take > 0""")
def split_audit(spark, d):
    """What becomes of the panel's rows when it is loaded and split: one row for each split and rule."""
    p = scalars.clean_missing(panel(spark, d), ["b", "c"])
    _, audit = sampling.load_split(p, ["b", "c"], "label", "year", ["l_orderkey", "line", "part", "entity"], test_years=2, gap=1, ratio=0.5, least=1000, budget=20_000)
    return audit


@query(f"""WITH {PANEL}, {CLEAN} SELECT count(*) AS n_rows, count(*) FILTER (a IS NULL OR b IS NULL) AS n_dropped, round(count(*) FILTER (a IS NULL OR b IS NULL) / count(*), 6) AS share FROM clean""")
def dropped_share(spark, d):
    _, report = sampling.complete_rows(scalars.clean_missing(panel(spark, d), ["a", "b"]), ["a", "b"])
    return report.withColumn("share", F.round("share", 6))


@query("""WITH k AS (SELECT event_id, event_id % 4 AS k, (value >= 0.5)::INT AS b, (event_id % 5 - 1)::INT AS i, ['yes', 'Nao', '0.7', 'none', '0'][event_id % 5 + 1] AS s FROM events WHERE true),
y AS (SELECT k, CASE k WHEN 0 THEN b WHEN 1 THEN greatest(0, least(1, i)) WHEN 2 THEN CASE s WHEN 'yes' THEN 1 WHEN '0.7' THEN 1 ELSE 0 END ELSE b END AS y,
 CASE k WHEN 0 THEN 0 WHEN 1 THEN (i NOT IN (0, 1))::INT WHEN 2 THEN (s <> '0')::INT ELSE 0 END AS changed FROM k)
SELECT ['boolean', 'int', 'string', 'float'][k + 1] AS kind, count(*) AS n_rows, sum(y)::BIGINT AS n_one, sum(changed)::BIGINT AS n_changed FROM y GROUP BY k""")
def label_kinds(spark, d):
    """Labels of four types as 0 and 1, with the number of rows that the rule changes."""
    e = table(spark, d, "events")
    text_ = F.element_at(F.array(*[F.lit(x) for x in ("yes", "Nao", "0.7", "none", "0")]), (F.col("event_id") % 5 + 1).cast("int"))
    of = {"boolean": F.col("value") >= 0.5, "int": (F.col("event_id") % 5 - 1).cast("int"), "string": text_, "float": (F.col("value") >= 0.5).cast("float")}
    out = None
    for i, (kind, raw) in enumerate(of.items()):
        one = e.where(F.col("event_id") % 4 == i).select(raw.alias("raw")).select("raw", scalars.label_01(F.col("raw"), kind).alias("y"))
        told = one.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("y").cast("long")).alias("n_one"), F.sum(scalars.label_changed(F.col("raw"), F.col("y")).cast("long")).alias("n_changed"))
        out = told if out is None else out.unionByName(told)
    return out


@query("""WITH f AS (SELECT p_partkey, ['tsf_ewma_humid_a05', 'tsf_lag_temp_24h', 'tsf_sarimax_exog_rain_pred', 'tsf_minirocket_f001', 'pressure'][p_partkey % 5 + 1] AS feature FROM part)
SELECT feature, ['ewma', 'lag', 'sarimax_exog', 'minirocket', 'base'][p_partkey % 5 + 1] AS method, ['humid', 'temp', 'rain', '', ''][p_partkey % 5 + 1] AS variable, count(*) AS n FROM f GROUP BY ALL""")
def feature_names(spark, d):
    names = ("tsf_ewma_humid_a05", "tsf_lag_temp_24h", "tsf_sarimax_exog_rain_pred", "tsf_minirocket_f001", "pressure")
    f = table(spark, d, "part").select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("feature"))
    return f.groupBy("feature", text.method_of(F.col("feature")).alias("method"), text.variable_of(F.col("feature")).alias("variable")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, round(sum(CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0, least(1, value / 50 - 0.5)) END), 3) AS total FROM events GROUP BY event_type""")
def clipped_scores(spark, d):
    x = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50 - 0.5)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(scalars.probability(x)), 3).alias("total"))


@query("""WITH d AS (SELECT s_suppkey AS k, y AS year, s_acctbal + y AS bal FROM supplier, (VALUES (1993), (1995), (1996)) v(y) WHERE s_suppkey % 4 <> 0)
SELECT l_suppkey, year(l_shipdate)::INT AS year, CASE WHEN k IS NULL THEN 'row' ELSE 'dimension' END AS source, count(*) AS n, round(avg(coalesce(bal, l_tax)), 4) AS v
FROM lineitem LEFT JOIN d ON l_suppkey = k AND year(l_shipdate) = d.year GROUP BY ALL""")
def station_year_dim(spark, d):
    """A dimension by station and year; other rows keep their own value."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_tax").alias("v"))
    years = F.explode(F.array(*[F.lit(y) for y in (1993, 1995, 1996)])).alias("year")
    dim = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), years, "s_acctbal").withColumn("bal", F.col("s_acctbal") + F.col("year"))
    rows = joins.lookup_with_fallback(li, dim, ["l_suppkey", "year"], {"bal": "v"})
    return rows.groupBy("l_suppkey", "year", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("v"))


@query(f"""WITH {PANEL}, {CLEAN}, t AS (SELECT * FROM clean WHERE c IS NOT NULL), m AS (SELECT avg(c) AS m, stddev_pop(c) AS s FROM t)
SELECT year, round(avg((c - m) / CASE WHEN s > 0 THEN s ELSE 1 END), 6) AS c FROM t, m GROUP BY year""")
def standard_scale(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["c"]).na.drop("any", subset=["c"]).select("year", "c")
    return models.standard_scale(p, ["c"]).groupBy("year").agg(F.round(F.avg("c"), 6).alias("c"))


@query(f"WITH {PANEL}, n AS (SELECT label, count(*) AS n FROM panel GROUP BY label) SELECT label, n, round((SELECT sum(n) FROM n) / (2.0 * n), 6) AS weight FROM n")
def class_weights(spark, d):
    w = models.class_weights(panel(spark, d).select("label"), "label")
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("SELECT r_name, '{' || string_agg('\"' || n_name || '\":[\"' || n_nationkey || '\"]', ',' ORDER BY n_name) || '}' AS nested FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def nested_dictionary(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("k", F.col("n_nationkey").cast("string"))
    return tables.nested_dictionary(n, "r_name", "n_name", "k")


@query("SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) NOT IN (SELECT year(l_shipdate) FROM lineitem WHERE l_linenumber = 1 AND l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08)")
def pending_years(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    done = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08").select(F.year("l_shipdate").alias("year"), F.lit("done").alias("status")).distinct()
    return tables.pending_years(o, done)


@query(f"""WITH {PANEL}, g AS (SELECT entity, (avg((a IS NULL)::INT::DOUBLE) + avg((b IS NULL)::INT::DOUBLE)) / 2 AS x FROM panel WHERE year = 1996 GROUP BY entity),
h AS (SELECT entity, (avg((a IS NULL)::INT::DOUBLE) + avg((b IS NULL)::INT::DOUBLE)) / 2 AS y FROM panel WHERE year = 1997 GROUP BY entity)
SELECT entity FROM g JOIN h USING (entity) ORDER BY round((x + y) / 2, 9), entity LIMIT 5""")
def sample_cities(spark, d):
    p = panel(spark, d)
    rows = sampling.least_missing(p.where("year = 1996"), p.where("year = 1997"), "entity", ["a", "b"], 1_000_000)
    return rows.orderBy(F.round("gap_share", 9), "entity").limit(5).select("entity")


@query()
def feature_p_values(spark, d):
    p = scalars.clean_missing(panel(spark, d), ["a", "b", "c", "e"])
    return stats.with_p_values(stats.spearman_by_feature(p, ["a", "b", "c", "e"], "label"), "spearman", "n_obs")
