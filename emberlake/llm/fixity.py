"""WARC records and a Merkle fixity audit of their replicas.

A replica is a set of WARC files. The first replica is the manifest: its records, in page order, lie in files of
``FILE_RECORDS`` records at known offsets, and every ``BUCKET`` of them bound a range of page ids. A record of any
replica belongs to the bucket whose range holds its own page id, whatever else the replica has lost or gained, so a
record that is shorter, missing or added changes no other bucket. A bucket's leaf hashes how many records it has and
the sums of their SHA-256 words, with the range of offsets that the manifest gives it; a node hashes its children's
hashes in order with the range of offsets that they cover. Replicas are compared root by root, one for each file;
below roots that differ only the children of differing nodes are compared, level by level (fan-out ``FANOUT``).
Only the records of buckets that differ are then opened and matched, by content first, then in order of their page id.
Records of undamaged files are read once, to be hashed, and are joined with nothing.

Defined cases: null url or html count as empty; a null page id is kept and sorts first; repeated rows are records of
their own (ordered by content), and any number of records of one page id is one bucket whose leaf is a sum; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.ordering import with_order
from emberlake.operators.scans import fill_forward
from emberlake.storage import materialize

FANOUT = 16
FILE_RECORDS = 4096  # records of a WARC file
BUCKET = 16  # records of the manifest that bound a bucket's range of page ids


def record(page: Column, url: Column, html: Column) -> Column:
    """A WARC 1.1 resource record as text; its identity derives from the page's id."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


ORDER = ["page_id", "record_sha256", "size"]


def _records(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    text = record(F.col(page), F.col(url), F.col(html))
    return pages.select(F.col(page).alias("page_id"), text.alias("r")).select("page_id", F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("record_sha256"))


def _in_files(rows: DataFrame) -> DataFrame:
    """Files of ``FILE_RECORDS`` records in page order."""
    placed = with_order(rows, ORDER, sums={"bytes": "size"})
    placed = placed.withColumn("file", F.floor(F.col("_pos") / FILE_RECORDS))
    starts = placed.groupBy("file").agg(F.min("_before_bytes").alias("_start"))
    rows = placed.join(starts, "file")
    return rows.select("file", (F.col("_pos") % FILE_RECORDS).alias("leaf"), "page_id", (F.col("_before_bytes") - F.col("_start")).alias("offset"), "size", "record_sha256")


def _identified(rows: DataFrame) -> DataFrame:
    """Add ``_id``: the page id as a text that is never null."""
    return rows.withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("")))


def _nth(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_nth``: a row's place among those of its keys, which stand together in ``_pos``."""
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return placed.join(first, keys).withColumn("_nth", F.col("_pos") - F.col("_first")).drop("_first")


def leaves(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of a replica: ``file, leaf, page_id, offset, size, record_sha256``.

    Files take runs of ``FILE_RECORDS`` records in page order; offsets restart in each file.
    """
    return materialize(_in_files(_records(pages, page, url, html)), "leaves")


def records(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Hashed records of another replica: ``page_id, size, record_sha256``, written; their places follow from the manifest."""
    return materialize(_records(pages, page, url, html), "records")


def ranges(manifest: DataFrame) -> DataFrame:
    """One row for each bucket of the manifest: ``file, bucket, page_id`` (the first), ``offset, upto``."""
    bucket = F.floor(F.col("leaf") / BUCKET).alias("bucket")
    first = F.min_by("page_id", "leaf").alias("page_id")
    return materialize(manifest.groupBy("file", bucket).agg(first, F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("size")).alias("upto")), "ranges")


def in_buckets(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` with ``file`` and ``bucket``: those of the last range that begins at or before the page id.

    Ranges and records are one ordered table, in which a range's number is carried on to the records behind it; records
    before the first range belong to it.
    """
    starts = bounds.select("page_id", F.struct("file", "bucket").alias("at"), F.struct("file", "bucket").alias("nth"), F.lit(0).alias("side"))
    both = rows.withColumn("side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    placed = fill_forward(both, [], ["page_id", "side", "nth"], {"at": "at"}).where("side = 1")
    nowhere = F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("bucket"))
    at = F.coalesce("at", nowhere)
    return placed.select(*rows.columns, at["file"].alias("file"), at["bucket"].alias("bucket"))


def tree(placed: DataFrame, bounds: DataFrame) -> list[DataFrame]:
    """Levels of the files' trees from buckets to roots: ``file, node, first, upto, hash``."""
    word = lambda i: F.sum(F.conv(F.substring("one", 8 * i + 1, 8), 16, 10).cast("long")).cast("string")
    hashed = placed.select("file", "bucket", F.sha2(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "size", "record_sha256"), 256).alias("one"))
    # sums of words do not depend on the order of records, and large buckets are summed up before the shuffle
    sums = hashed.groupBy("file", "bucket").agg(F.count(F.lit(1)).cast("string").alias("n"), F.array(*[word(i) for i in range(8)]).alias("words"))
    spans = sums.join(bounds.select("file", "bucket", "offset", "upto"), ["file", "bucket"], "left")
    leaf = F.sha2(F.concat_ws(":", F.lit("leaf"), F.coalesce(F.col("offset").cast("string"), F.lit("none")), F.coalesce(F.col("upto").cast("string"), F.lit("none")), "n", F.array_join("words", ":")), 256)
    level = materialize(spans.select("file", F.col("bucket").alias("node"), F.col("offset").alias("first"), "upto", leaf.alias("hash")), "tree")
    levels, width = [level], -(-FILE_RECORDS // BUCKET)
    while width > 1:
        width = -(-width // FANOUT)
        # a node gathers FANOUT children at most
        kids = F.sort_array(F.collect_list(F.struct("node", "hash")))
        level = level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.min("first").alias("first"), F.max("upto").alias("upto"), F.array_join(F.transform(kids, lambda k: k["hash"]), ":").alias("kids"))
        level = materialize(level.select("file", F.col("up").alias("node"), "first", "upto", F.sha2(F.concat_ws(":", F.lit("node"), "first", "upto", "kids"), 256).alias("hash")), "tree")
        levels.append(level)
    return levels


def differing(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """``file, bucket`` of buckets that differ.

    Starts at the roots and joins, at each level, only the children of nodes that differ.
    """
    found = None
    for a, b in zip(reversed(one), reversed(two)):
        a, b = a.select("file", "node", F.col("hash").alias("_one")), b.select("file", "node", F.col("hash").alias("_two"))
        if found is not None:
            up = found.select("file", F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            a, b = a.join(up, ["file", "node"], "left_semi"), b.join(up, ["file", "node"], "left_semi")
        both = a.join(b, ["file", "node"], "full").where(~F.col("_one").eqNullSafe(F.col("_two")))
        found = materialize(both.select("file", "node"), "differing")
    return found.withColumnRenamed("node", "bucket")


def matched(manifest: DataFrame, got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of opened buckets: ``file, leaf, state`` of the manifest's damaged records (changed, missing), and extra records.

    Records match by page id and content, each once; of a page id what is left on both sides is paired in order.
    """
    exact = ["_id", "record_sha256", "size"]
    known = _nth(_identified(manifest).withColumn("_pos", F.col("file") * FILE_RECORDS + F.col("leaf")), exact)
    mine = materialize(_nth(_identified(with_order(got.select("page_id", "size", "record_sha256"), ORDER)), exact).drop("_pos"), "opened")
    same = [*exact, "_nth"]
    open_places = known.join(mine.select(*same), same, "left_anti").select("file", "leaf", *ORDER)
    others = mine.join(known.select(*same), same, "left_anti").select(*ORDER)
    left = _nth(_identified(with_order(open_places, ORDER)), ["_id"]).select("_id", "_nth", "file", "leaf")
    new = _nth(_identified(with_order(others, ORDER)), ["_id"]).select("_id", "_nth", *ORDER)
    pairs = materialize(left.join(new, ["_id", "_nth"], "full"), "pairs")
    state = F.when(F.col("record_sha256").isNull(), "missing").otherwise("changed")
    return pairs.where("leaf IS NOT NULL").select("file", "leaf", state.alias("state")), pairs.where("leaf IS NULL").select(*ORDER)


def audit(manifest: DataFrame, replica: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(damage, extra)`` of a replica's ``records`` against the first one's ``leaves``, as ``matched`` gives them."""
    bounds = ranges(manifest)
    one = materialize(in_buckets(manifest.withColumnsRenamed({"file": "own_file"}), bounds), "placed")
    two = materialize(in_buckets(replica, bounds), "placed")
    bad = differing(tree(one, bounds), tree(two, bounds))
    opened = lambda rows: rows.join(bad, ["file", "bucket"], "left_semi")
    mine = opened(one).select(F.col("own_file").alias("file"), "leaf", *ORDER)
    return matched(materialize(mine, "opened"), materialize(opened(two), "opened"))


def decayed(pages: DataFrame) -> DataFrame:
    """A replica in which the last character of every page whose id leaves 13 modulo 97 has become a '?'."""
    hit = F.pmod("page_id", F.lit(97)) == 13
    return pages.withColumn("html", F.when(hit & (F.length("html") > 0), F.expr("left(html, length(html) - 1) || '?'")).otherwise(F.col("html")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica by page ids modulo 97: 13 has lost its last character, 29 is gone, 53 has a second record."""
    rest = F.pmod("page_id", F.lit(97))
    kept = pages.where(F.coalesce(rest != 29, F.lit(True)))
    kept = kept.withColumn("html", F.when((rest == 13) & (F.length("html") > 0), F.expr("left(html, length(html) - 1)")).otherwise(F.col("html")))
    return kept.unionByName(pages.where(rest == 53).withColumn("url", F.concat(F.coalesce("url", F.lit("")), F.lit("#added"))))


def report(one: DataFrame, two: DataFrame) -> DataFrame:
    """Each record of the first replica (``leaves``) with its state, and the extra ones of the second (``records``) without a place."""
    damage, extra = audit(one, two)
    columns = ["page_id", "file", "leaf", "offset", "size", "record_sha256"]
    rows = one.join(damage, ["file", "leaf"], "left").select(*columns, F.coalesce("state", F.lit("intact")).alias("state"))
    none = F.lit(None).cast("long")
    return rows.unionByName(extra.select("page_id", none.alias("file"), none.alias("leaf"), none.alias("offset"), "size", "record_sha256", F.lit("extra").alias("state")))


def op6_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Audit the WARC files of all pages against a replica derived from them with known decay."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = leaves(pages)
    return report(one, records(decayed(pages)))


def op6_replica_damage(spark, sf_dir: str) -> DataFrame:
    """The same audit against a replica with shortened, missing and added records between intact ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = leaves(pages)
    return report(one, records(damaged(pages)))


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none')
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages),
h AS (SELECT page_id, body, strlen(r)::BIGINT AS size, sha256(r) AS record_sha256 FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, record_sha256, size) - 1 AS pos FROM h),
f AS (SELECT *, (pos // {FILE_RECORDS})::BIGINT AS file, (pos % {FILE_RECORDS})::BIGINT AS leaf FROM o)
SELECT page_id, file, leaf, (sum(size) OVER (PARTITION BY file ORDER BY leaf) - size)::BIGINT AS "offset", size, record_sha256,
       CASE WHEN page_id % 97 = 13 AND body <> '' AND right(body, 1) <> '?' THEN 'changed' ELSE 'intact' END AS state
FROM f
"""

DAMAGE_SQL = f"""
WITH p AS (
  SELECT page_id, url, html, false AS added FROM pages
  UNION ALL SELECT page_id, coalesce(url, '') || '#added', html, true FROM pages WHERE page_id % 97 = 53),
h AS (
  SELECT page_id, added, coalesce(html, '') AS body,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none')
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM p),
o AS (
  SELECT page_id, added, body, strlen(r)::BIGINT AS size, sha256(r) AS record_sha256,
         row_number() OVER (PARTITION BY added ORDER BY page_id NULLS FIRST, sha256(r), strlen(r)) - 1 AS pos
  FROM h),
f AS (SELECT *, (pos // {FILE_RECORDS})::BIGINT AS file, (pos % {FILE_RECORDS})::BIGINT AS leaf FROM o WHERE NOT added)
SELECT page_id, file, leaf, (sum(size) OVER (PARTITION BY file ORDER BY leaf) - size)::BIGINT AS "offset", size, record_sha256,
       CASE WHEN page_id % 97 = 29 THEN 'missing' WHEN page_id % 97 = 13 AND body <> '' THEN 'changed' ELSE 'intact' END AS state
FROM f
UNION ALL
SELECT page_id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, size, record_sha256, 'extra' FROM o WHERE added
"""
