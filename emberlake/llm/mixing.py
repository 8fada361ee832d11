"""Mixing sources to target weights by hash-threshold histograms.

Each document falls, by the leading hex digits of the MD5 of its id and text, into one of 4096 buckets. Words
are summed by source and bucket; a source's prefix sums show the bucket in which its budget is used
up. Only documents of that boundary bucket enter the next histogram, on the next three digits, and
so on for ``LEVELS`` levels. What remains is one threshold for each source, and a plain filter: no
document is sorted. Budgets over a source's size take the source once and a nested part of it again
by the same thresholds, so a larger budget always keeps what a smaller one takes.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its
own and sorts last; a null id hashes as the text "null", so rows without ids are told apart by their text.
Rows that repeat id and text share a hash: if a budget ends among them, they are told apart by their place
in the table, so that as many of them are taken as it allows. An empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.columns import unused
from emberlake.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 % of all sizes
MOST = 2  # a source's size times this at most
DIGITS, LEVELS = 3, 3  # 16 ** 3 buckets at each level
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: ``source, total, target``. Sources are few beside documents.

    The excess of capped sources goes to the others by weight until none is above its cap, which is
    the level at which ``min(cap, level * weight)`` adds up to the share. Sums are whole numbers and
    divided once, so the result does not depend on the order of rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in WEIGHTS]), ((F.row_number().over(by_rank) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = totals.withColumn("weight", w)
    by_cap = Window.orderBy((F.col("total") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    num, den = SHARE
    steps = weighed.select(
        "source",
        "total",
        "weight",
        (F.sum("total").over(Window.partitionBy()) * num - F.coalesce(F.sum("total").over(before), F.lit(0)) * MOST * den).alias("left"),
        (F.sum("weight").over(rest) * den).alias("of"),
    )
    # the first source, by cap, whose cap is not below the level left for it and the rest
    free = F.col("total") * MOST * F.col("of") > F.col("left") * F.col("weight")
    level = steps.withColumn("key", F.row_number().over(by_cap)).groupBy().agg(F.min_by(F.struct("left", "of"), F.when(free, F.col("key"))).alias("level"))
    return steps.crossJoin(F.broadcast(level)).select(  # one row
        "source",
        "total",
        F.when(
            F.col("level").isNotNull() & (F.col("total") * MOST * F.col("level.of") > F.col("level.left") * F.col("weight")),
            (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.of"),
        )
        .otherwise((F.col("total") * MOST).cast("double"))
        .alias("target"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _hash(doc: str, text: str) -> Column:
    spelled = F.concat(F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(spelled.cast("binary")), 1, DIGITS * LEVELS), 16, 10).cast("long")


def _salt() -> Column:
    """A hash of a row's place, for rows that are alike in all else."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - 4 * DIGITS * LEVELS)


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Follow each source's budget down the levels: ``state`` with the hash in which it ends (``cut``), the words below
    it (``used``), and the ``words`` and ``rows`` that share it; null where the budget does not end inside."""
    state = state.withColumns({"cut": F.lit(0).cast("long"), "words": F.lit(None).cast("long"), "rows": F.lit(None).cast("long")})
    for k in range(1, LEVELS + 1):
        s = state.select("source", "cut", "used", "budget")
        inside = rows.withColumn("bucket", F.shiftright("hash", 4 * DIGITS * (LEVELS - k)))
        inside = inside.join(s, _same(inside, s) & (F.shiftright("bucket", 4 * DIGITS) == F.col("cut"))).select(inside["source"], "bucket", "size", "used", "budget")
        hist = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"), F.max("used").alias("used"), F.max("budget").alias("budget"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows of a source
        filled = hist.withColumn("below", F.col("used") + F.sum("n").over(upto) - F.col("n"))
        crossed = filled.where((F.col("below") <= F.col("budget")) & (F.col("below") + F.col("n") > F.col("budget")))
        ends = crossed.select(F.col("source").alias("at"), F.col("bucket").alias("end"), "below", "n", "m")
        grown = state.join(ends, state["source"].eqNullSafe(ends["at"]), "left")
        state = materialize(grown.select("source", "whole", "total", "target", "budget", F.coalesce("below", "used").alias("used"), F.coalesce("end", F.lit(0)).cast("long").alias("cut"), F.col("n").alias("words"), F.col("m").alias("rows")), "thresholds")
    return state


def _nearer() -> Column:
    """Whether taking all that shares the last hash comes nearer to the budget than leaving it."""
    return F.coalesce(2 * F.col("used") + F.col("words") <= 2 * F.col("budget"), F.lit(False)).cast("long")


def thresholds(sizes: DataFrame) -> DataFrame:
    """``source, total, target, whole, threshold, salted`` from ``source, size, hash, salt``: one row for each source.

    A row is taken ``whole`` times, and once more if its hash is below the threshold, or equals it and its salt is below ``salted``.
    """
    some = sizes.where(F.col("size") > 0)
    targets = materialize(source_targets(sizes), "targets")
    whole = F.when(F.col("total") > 0, F.least(F.floor(F.col("target") / F.col("total")), F.lit(MOST))).otherwise(0).cast("long")
    state = targets.select("source", whole.alias("whole"), "total", "target", F.lit(0).cast("long").alias("used"))
    state = _narrowed(some, state.withColumn("budget", F.col("target") - F.col("whole") * F.col("total")))
    split = state.where(F.col("rows") > 1)
    if split.isEmpty():
        return state.select("source", "total", "target", "whole", (F.col("cut") + _nearer()).alias("threshold"), F.lit(0).cast("long").alias("salted"))
    own = split.select(F.col("source").alias("at"), F.col("cut").alias("tied"))
    tied = some.join(own, some["source"].eqNullSafe(own["at"]) & (F.col("hash") == F.col("tied"))).select("source", "size", F.col("salt").alias("hash"))
    inner = _narrowed(materialize(tied, "tied"), split.select("source", "whole", "total", "target", "used", "budget"))
    inner = inner.select(F.col("source").alias("at"), (F.col("cut") + _nearer()).alias("salt_cut"))
    both = state.join(inner, state["source"].eqNullSafe(inner["at"]), "left")
    threshold = F.col("cut") + F.when(F.col("salt_cut").isNull(), _nearer()).otherwise(0)
    return both.select("source", "total", "target", "whole", threshold.alias("threshold"), F.coalesce("salt_cut", F.lit(0).cast("long")).alias("salted"))


def _copies(size: str, hashed: str, salt: str, whole: str = "whole", threshold: str = "threshold", salted: str = "salted") -> Column:
    again = (F.col(hashed) < F.col(threshold)) | ((F.col(hashed) == F.col(threshold)) & (F.col(salt) < F.col(salted)))
    return F.when(F.col(size) > 0, F.col(whole) + again.cast("long")).otherwise(0).cast("long")


def _sizes(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    return materialize(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), _hash(doc, text).alias("hash"), _salt().alias("salt")), "sizes")


def mix(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, copies`` for each row; copies is 0, 1 or 2."""
    sizes = _sizes(docs, doc, text, source)
    t = thresholds(sizes).withColumnRenamed("source", "at")
    told = sizes.join(t, sizes["source"].eqNullSafe(t["at"]))
    return told.select("doc_id", "size", "source", F.col("total").alias("source_size"), "target", _copies("size", "hash", "salt").alias("copies"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Mix all documents; ``taken`` counts each document's words as often as the mix repeats it."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it, same columns.

    A row's copies follow from its own hash and its source's thresholds, so texts are not shuffled.
    """
    names = unused(docs, "_source", "_whole", "_threshold", "_salted", "_size", "_hash", "_salt", "_copies", "_again")
    at, whole, threshold, salted, size, hashed, salt, copies, again = names
    t = thresholds(_sizes(docs, "doc_id", "text", "source"))
    t = t.select(F.col("source").alias(at), F.col("whole").alias(whole), F.col("threshold").alias(threshold), F.col("salted").alias(salted))
    rows = docs.withColumns({size: n_words("text"), hashed: _hash("doc_id", "text"), salt: _salt()})
    told = rows.join(t, rows["source"].eqNullSafe(t[at]))
    told = told.withColumn(copies, _copies(size, hashed, salt, whole, threshold, salted)).where(F.col(copies) > 0)
    return told.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 9))::BIGINT AS hash
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS total,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sizes GROUP BY source),
steps AS (
  SELECT *, row_number() OVER w AS key,
         (sum(total) OVER () * 3 - coalesce(sum(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4)::BIGINT AS rest,
         (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 2)::BIGINT AS parts
  FROM totals WINDOW w AS (ORDER BY total / weight, source NULLS LAST)),
level AS (SELECT rest AS lr, parts AS lp FROM steps WHERE total * 2 * parts > rest * weight ORDER BY key LIMIT 1),
targets AS (
  SELECT source, total, CASE WHEN lr IS NOT NULL AND total * 2 * lp > lr * weight
                             THEN (weight * lr)::DOUBLE / lp::DOUBLE ELSE (total * 2)::DOUBLE END AS target
  FROM steps LEFT JOIN level ON true),
budgets AS (
  SELECT *, CASE WHEN total > 0 THEN least(floor(target / total), 2)::BIGINT ELSE 0 END AS whole FROM targets),
groups AS (
  SELECT source, hash, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) - sum(size) AS below
  FROM sizes WHERE size > 0 GROUP BY source, hash)
SELECT s.doc_id, s.size, b.total AS source_size, b.target,
       (s.size * (b.whole + CASE WHEN 2 * g.below + g.words <= 2 * (b.target - b.whole * b.total) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN groups g ON g.source IS NOT DISTINCT FROM s.source AND g.hash = s.hash
"""
