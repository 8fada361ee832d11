"""Secret scans over an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its text (its blob). The ledger
remembers which (blob, rule, rule version) triples were scanned and what was found, so a run scans
only unseen triples, each blob once however many paths or versions carry it, and joins the findings
back to all paths. All steps are built-in functions, hash aggregates and equi-joins.

Defined cases: a null text counts as empty; an empty text is a blob without findings; a null path id
is kept and treated as equal to other null ids; repeated rows come back as often as they came in; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.columns import unused
from emberlake.storage import materialize


@dataclass(frozen=True)
class Rule:
    """``group`` is the part whose length must reach ``least``; raise ``version`` on any change."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# Kinds in their listed order, patterns and least lengths. Matches are leftmost and do
# not overlap within a kind; those that are too short are dropped after matching.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)

# What redaction masks of a private key: all from BEGIN to the END line, or, where that is missing, as far
# as base64 lines (after headers of the key) go. Line ends may be written as \n, as in JSON.
_LINE_END = r"(?:\s|\\[nr])"
WHOLE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++){0,200}+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_LINE_END}++(?:Proc-Type|DEK-Info|Comment|Version): [^\r\n\\]*+){{0,9}}+(?:{_LINE_END}++[A-Za-z0-9+/]{{16,}}+=*+){{0,1000}}+(?:{_LINE_END}++[A-Za-z0-9+/]++=++)?+)"
)
MASKED = tuple(Rule("pem", WHOLE_KEY, 0, 1, 2) if r.kind == "pem" else r for r in RULES)


def blob_id(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def empty_ledger(spark) -> tuple[DataFrame, DataFrame]:
    """(seen, findings) of a ledger that has scanned nothing."""
    return (
        spark.createDataFrame([], "blob_id string, kind string, version int"),
        spark.createDataFrame([], "blob_id string, kind string, version int, start long, end long"),
    )


def _matches(text: Column, rule: Rule) -> Column:
    """For each match of the rule: characters before it since the last match, its own, its group's.

    ``split`` and ``regexp_extract_all`` walk the same matches, so gaps and matches alternate.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    sizes = F.zip_with(found, part, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("part")))
    # a gap follows the last match; it has no partner and goes
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(found))
    return F.zip_with(
        gaps,
        sizes,
        lambda g, s: F.struct(F.lit(rule.kind).alias("kind"), g.alias("gap"), s["size"].alias("size"), s["part"].alias("part")),
    )


def scan(
    versions: DataFrame,
    ledger: tuple[DataFrame, DataFrame] | None = None,
    *,
    path: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan what the ledger has not seen.

    Returns ``(paths, seen, findings)``: every row's ``(path, blob_id)``; the ledger's pairs with the
    new ones added; and the findings of current rule versions as ``(blob_id, kind, version, start,
    end)``, in code points with an exclusive end. ``seen`` and ``findings`` form the next ledger.
    """
    spark = versions.sparkSession
    seen, known = ledger or empty_ledger(spark)
    current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    paths = materialize(versions.select(F.col(path).alias("path"), blob_id(text).alias("blob_id")), "paths")

    # one carrier for each distinct blob; hot blobs are combined before the shuffle
    carrier = paths.groupBy("blob_id").agg(F.min("path").alias("path"))
    done = (
        seen.join(F.broadcast(current), ["kind", "version"], "left_semi")  # as many rows as rules
        .groupBy("blob_id")
        .agg(F.collect_set("kind").alias("done"))
    )
    todo = (
        carrier.join(done, "blob_id", "left")
        .select(
            "blob_id",
            "path",
            F.array_except(F.array(*[F.lit(r.kind) for r in rules]), F.coalesce("done", F.array().cast("array<string>"))).alias("todo"),
        )
        .where(F.size("todo") > 0)
    )
    todo = materialize(todo, "todo")
    texts = versions.select(F.col(path).alias("p"), blob_id(text).alias("b"), F.coalesce(text, F.lit("")).alias("t"))
    # keyed by blob and path, so copies of one text spread over all partitions
    unseen = texts.join(
        todo.hint("shuffle_hash"), (F.col("b") == F.col("blob_id")) & F.col("p").eqNullSafe(F.col("path"))
    ).select("blob_id", "todo", "t")
    none = F.array().cast("array<struct<kind:string,gap:int,size:int,part:int>>")
    hits = unseen
    for i, r in enumerate(rules):
        hits = hits.withColumn(
            f"hit{i}",
            F.when(F.array_contains("todo", r.kind) & F.col("t").rlike(r.pattern), _matches(F.col("t"), r)).otherwise(none),
        )
    lists = F.filter(F.array(*[f"hit{i}" for i in range(len(rules))]), lambda x: F.size(x) > 0)
    each = hits.select("blob_id", F.explode(lists).alias("hits")).dropDuplicates(["blob_id", "hits"])
    # ends of matches: running sums over one text's matches of one kind, sorted, so any number of them is linear
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    upto = Window.partitionBy("blob_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    match = each.select("blob_id", F.posexplode("hits").alias("nth", "h")).select("blob_id", "nth", "h.kind", "h.part", "h.size", (F.col("h.gap") + F.col("h.size")).cast("long").alias("step"))
    end = F.sum("step").over(upto)
    found = (
        match.withColumn("end", end)
        .where(F.col("part") >= least[F.col("kind")])
        .select("blob_id", "kind", version[F.col("kind")].alias("version"), (F.col("end") - F.col("size")).alias("start"), "end")
    )
    found = materialize(found, "found")
    fresh = todo.select("blob_id", F.explode("todo").alias("kind")).join(F.broadcast(current), "kind").select("blob_id", "kind", "version")
    findings = known.join(F.broadcast(current), ["kind", "version"], "left_semi").select("blob_id", "kind", "version", "start", "end").unionByName(found)
    return paths, seen.unionByName(fresh), findings


def by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All paths with their blob's sorted spans: ``(path, blob_id, spans array<struct>)``.

    Spans are sorted by start, then by the kinds' listed order; a blob's spans are bounded by its text.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = findings.groupBy("blob_id").agg(
        F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return paths.join(spans, "blob_id", "left").select("path", "blob_id", F.coalesce("spans", none).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


BASE_KINDS = ("assign", "access", "hex")


def _report(rows: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    more = [c for c in rows.columns if c not in ("path", "blob_id", "spans")]
    return rows.select(
        F.col("path").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        *more,
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Scan all documents with an empty ledger and return each document's spans and digests."""
    paths, _, findings = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _report(by_path(paths, findings))


def _next_version(docs: DataFrame) -> DataFrame:
    """What the documents are at the next visit: every fifth is another file's text, every seventh has a line more, others stay."""
    d = F.col("doc_id")
    line = F.concat(F.lit("\napi_key = changed"), d.cast("string"), F.lit("000"))
    text = F.when(d % 7 == 0, F.concat(F.coalesce("text", F.lit("")), line)).otherwise(F.col("text"))
    return docs.select(F.when(d % 5 == 0, d + 1_000_000_000).otherwise(d).alias("doc_id"), text.alias("text"))


def op1_second_visit(spark, sf_dir: str) -> DataFrame:
    """Scan all documents, then their next version with the ledger of the first scan.

    ``rescanned`` tells rows whose text the ledger did not know: only those were scanned again, moved ones were not.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, seen, known = scan(docs)
    seen = materialize(seen, "ledger")
    paths, _, findings = scan(_next_version(docs), (seen, known))
    rows = by_path(paths, findings)
    had = seen.groupBy("blob_id").agg(F.count(F.lit(1)).alias("had"))
    told = rows.join(had, "blob_id", "left").withColumn("rescanned", F.coalesce("had", F.lit(0)) < len(RULES)).drop("had")
    return _report(told)


def redact(docs: DataFrame, *, mask: str = "[SECRET]") -> DataFrame:
    """Replace every finding in ``text`` by ``mask`` and bring ``n_chars`` up to date; no row is lost.

    Overlapping spans merge into one mask; a private key goes with its body. Rows without findings pass
    unchanged, null texts stay null.
    """
    _, _, findings = scan(docs, rules=MASKED)
    # what stays of a text: the stretches between findings, after all that earlier findings cover
    earlier = Window.partitionBy("blob_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = findings.withColumn("at", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    # a stretch before each finding that begins where nothing is covered yet, and the one after the last
    stretch = F.when(F.col("start") >= F.col("at"), F.struct(F.col("at"), (F.col("start") - F.col("at")).alias("size")))
    blob, stretches, end, new_text = unused(docs, "_blob", "_stretches", "_end", "_text")
    kept = covered.groupBy("blob_id").agg(F.sort_array(F.collect_list(stretch)).alias(stretches), F.max("end").alias(end))
    kept = kept.withColumnRenamed("blob_id", blob)
    text = F.col("text")
    part = lambda x: F.substring(text, x["at"].cast("int") + 1, x["size"].cast("int"))
    pieces = F.concat(F.transform(stretches, part), F.array(F.expr(f"substring(text, int({end}) + 1)")))
    joined = docs.withColumn(blob, blob_id("text")).join(kept, blob, "left")
    joined = joined.withColumn(new_text, F.when(F.col(end).isNull(), text).otherwise(F.array_join(pieces, mask)))
    new = {"text": F.col(new_text), "n_chars": F.when(F.col(end).isNull(), F.col("n_chars")).otherwise(F.length(new_text).cast("long"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def _sql(source: str = "documents", more: str = "") -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        SELECT t, '{r.kind}' AS kind, {i} AS rank, unnest(range(1, len(m) + 1)) AS i, m, v, g, {r.least} AS least FROM (
          SELECT t, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS m,
                 list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x)) AS v,
                 list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g
          FROM texts)""")
    return f"""
    WITH texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM {source}),
    matches AS ({" UNION ALL ".join(parts)}),
    spans AS (
      SELECT t, kind, rank, list_sum(g[1:i]) + coalesce(list_sum(m[1:i-1]), 0) AS s, m[i] AS size
      FROM matches WHERE v[i] >= least),
    joined AS (
      SELECT t, string_agg(kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT, ',' ORDER BY s, rank) AS spans,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex
      FROM spans GROUP BY t)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
           coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans{more}
    FROM {source} LEFT JOIN joined ON t = coalesce(text, '')
    """


SQL = _sql()

_NEXT = r"""(SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id,
CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || chr(10) || 'api_key = changed' || doc_id || '000' ELSE text END AS text FROM documents) AS later"""
SECOND_SQL = _sql(_NEXT, ", coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents) AS rescanned")
