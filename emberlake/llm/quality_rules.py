"""Quality rules by line-first cleaning.

Rules judge single lines (symbols, navigation, boilerplate, shouting, repetition); failing lines are
removed, and a document is rejected if too much of its text went with them. Document rules on
repetition and length come first. Everything is a projection of one scan: no shuffle, no Python.

Defined cases: a null text has no words and is rejected; an empty text likewise; lines without words
are never judged; repeated rows are judged alike; an empty table gives an empty result; columns of
the input other than id and text are not read by ``judge`` and pass unchanged through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOL = r"[#*$%&|<>]"
MARKS = r"[!?]{2,}|\.{4,}|[-_=~]{4,}"
BOILERPLATE_SHARE = 20  # a line is boilerplate if such phrases make up a 20th of it
WINDOW = 5
LEAST_WORDS, MOST_REPEAT = 10, 20  # words; per cent of words
LEAST_KEPT = 60  # per cent of the lines' characters that must survive line cleaning

# What marks a line as navigation or boilerplate, in lower case.
NAVIGATION = r"^\s*(home|menu|next|previous|prev|back|login|log in|sign in|sign up|register|subscribe|share|search|contact|about|skip to content|read more|click here)(\s*[|>»/·•-]+\s*[^\s|>»/·•-]+)*[\s|>»/·•-]*$"
BOILERPLATE = r"(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|enable javascript|powered by|©|lorem ipsum)"


BLANK = r"[\x20\x09-\x0D]"


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def words(text: Column) -> Column:
    """The words as an array."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+", -1))


def _windows(w: Column) -> Column:
    """Hashes of all windows of ``WINDOW`` words."""
    at = F.sequence(F.lit(0), F.size(w) - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))
    return F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(windows)


def _marked(windows: Column) -> Column:
    """Sorted (hash, place) of a text's windows; null where no two windows are equal, as in most texts."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def _repeat_words(marked: Column) -> Column:
    """Size of the union of [p, p + 5) over windows with an equal neighbour; ``marked`` is a column, not an expression."""
    n = F.size(marked)
    same = lambda x, k: F.get(marked, k)["h"] == x["h"]
    places = F.array_sort(
        F.transform(F.filter(marked, lambda x, k: ((k > 0) & same(x, k - 1)) | ((k < n - 1) & same(x, k + 1))), lambda x: x["i"])
    )
    total = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + (p + WINDOW) - F.greatest(acc["end"], p)).alias("n")),
    )
    return F.coalesce(total["n"], F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """Symbols instead of text, no word of two letters, shouting, marks in place of sentences, a menu or boilerplate."""
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    marks = F.regexp_count(line, F.lit(MARKS))
    low = F.lower(line)
    phrases = F.length(F.array_join(F.regexp_extract_all(low, F.lit(BOILERPLATE), F.lit(0)), ""))
    return (
        ~line.rlike(r"\p{L}\p{L}")
        | (~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}\p{Lu}.{20}"))
        | (symbols * 30 > F.length(line))
        | (marks * 15 > F.length(line))
        | low.rlike(NAVIGATION)
        | (low.rlike(BOILERPLATE) & (phrases * BOILERPLATE_SHARE > F.length(line)))
    )


def judge(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and the shares behind the verdict."""
    t = docs.select(F.col(doc).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    a = t.select("doc_id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), _has_word).alias("lines"))
    a = a.withColumn("windows", _windows(F.col("w"))).withColumn("marked", _marked(F.col("windows")))
    a = a.withColumn("failing", F.filter("lines", line_fails))
    b = a.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("marked")).alias("n_repeat_words"),
        F.length(F.array_join("failing", "")).cast("long").alias("lost_chars"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    c = b.withColumn("base_failed", failed)
    return c.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("line_chars") - F.col("lost_chars")) >= LEAST_KEPT * F.col("line_chars")))


def clean(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are kept, without their failing lines; all columns of ``docs`` stay."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~_has_word(x) | ~line_fails(x))
    verdict = judge(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), doc="_row", text="_text").where("kept")
    kept = verdict.select(*[F.col("doc_id")[c].alias(c) for c in docs.columns])
    return kept.withColumn(text, F.array_join(lines, "\n"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "line_chars")


def _sql() -> str:
    fails = f"""(NOT regexp_matches(l, '\\p{{L}}\\p{{L}}')
      OR (NOT regexp_matches(l, '\\p{{Ll}}') AND regexp_matches(l, '\\p{{Lu}}\\p{{Lu}}.{{20}}'))
      OR 30 * len(regexp_extract_all(l, '{SYMBOL}')) > length(l)
      OR 15 * len(regexp_extract_all(l, '{MARKS}')) > length(l)
      OR regexp_matches(lower(l), '{NAVIGATION}')
      OR {BOILERPLATE_SHARE} * length(array_to_string(regexp_extract_all(lower(l), '{BOILERPLATE}'), '')) > length(l))"""
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    base AS (
      SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM texts),
    windows AS (
      SELECT doc_id, i, w[i:i+4] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
    covered AS (
      SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM windows JOIN twice USING (doc_id, win), (SELECT unnest(range(0, 5)) AS k) ks
      GROUP BY doc_id),
    lost AS (
      SELECT doc_id, sum(length(l))::BIGINT AS total, coalesce(sum(length(l)) FILTER ({fails}), 0)::BIGINT AS n
      FROM (SELECT doc_id, unnest(lines) AS l FROM base) GROUP BY doc_id),
    joined AS (
      SELECT b.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(o.n, 0)::BIGINT AS lost_chars, coalesce(o.total, 0)::BIGINT AS line_chars
      FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN lost o USING (doc_id)),
    failed AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words) AS base_failed FROM joined)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed AND 100 * (line_chars - lost_chars) >= {LEAST_KEPT} * line_chars) AS kept, lost_chars, line_chars
    FROM failed
    """


SQL = _sql()
