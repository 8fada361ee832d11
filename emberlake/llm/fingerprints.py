"""Document fingerprints: a canonical exact digest.

The canonical form is NFKC, case-folded, NFKC again, with each run of white space folded to one
space and none at the ends. Its fingerprint is two independently salted 64-bit xxHash values, as 32
hex digits. Documents are grouped by fingerprint first, on narrow rows; only buckets of two or more
are then compared byte by byte, by grouping on the canonical bytes themselves, so that a collision
splits a bucket instead of joining two texts. ICU, which Spark ships, does the Unicode work inside
the JVM through the SQL function ``reflect``.

Defined cases: a null text counts as empty, and empty texts are equal; a null id is kept and comes
before all others; rows that repeat both id and text are one document, whose next is the next other
one, and come back as often as they came in; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.ordering import with_order
from emberlake.storage import materialize

_NFKC = "com.ibm.icu.text.Normalizer"
_FOLD = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    once = F.reflect(F.lit(_NFKC), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.reflect(F.lit(_FOLD), F.lit("foldCase"), once, F.lit(True))
    # plain ASCII is already normal; the second pass is for what folding takes apart
    again = F.reflect(F.lit(_NFKC), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"[\p{IsWhite_Space}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as hex; the salt comes first, so the halves are independent."""
    half = lambda salt: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), canon))), 16, "0")
    return F.concat(half("emberlake-1"), half("emberlake-2"))


def fingerprint(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for each row; a narrow projection of one scan."""
    canon = docs.select(F.col(doc).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), canonical(F.col(text)).alias("canon"))
    return canon.select("doc_id", "n_chars", digest(F.col("canon")).alias("fingerprint"))


def shared_buckets(prints: DataFrame) -> DataFrame:
    """Fingerprints that two or more rows have."""
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")


def equal_classes(members: DataFrame) -> DataFrame:
    """Byte comparison inside buckets: ``(fingerprint, canon, group_id)``, one row for each distinct text.

    ``members`` has ``doc_id, fingerprint, canon`` of rows in shared buckets. Map-side combining keeps
    one copy of each text a task, so a huge group of copies costs no more than its tasks.
    """
    return members.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"))


def groups(prints: DataFrame, members: DataFrame) -> DataFrame:
    """``prints`` with ``group_id``: the smallest id among rows with the same canonical bytes."""
    classes = materialize(equal_classes(members), "classes")
    # written, so that the join reads both sides from exchanges and a hot fingerprint can be split
    by_print = materialize(classes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_texts"), F.min("group_id").alias("_group")), "buckets")
    plain = prints.join(by_print, "fingerprint", "left")
    one = plain.where("_texts IS NULL OR _texts = 1").select(*prints.columns, F.coalesce("_group", "doc_id").alias("group_id"))
    # collided buckets, if any, are told apart by their texts
    collided = members.join(by_print.where("_texts > 1").select("fingerprint"), "fingerprint", "left_semi")
    told = collided.join(classes, ["fingerprint", "canon"]).select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_print"), "group_id").distinct()
    many = prints.join(told, prints["doc_id"].eqNullSafe(told["_id"]) & (prints["fingerprint"] == told["_print"])).select(*prints.columns, "group_id")
    return one.unionByName(many)


def edited_prints(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text, whose last quarter is the next document's beginning.

    Rows ``doc_id, n_chars, times, fingerprint, next_print, edited_sha256, edited_fingerprint, near_edited``,
    one for each id and text with the number of rows that repeat them (``times``), and
    ``canon``, the canonical text of those whose fingerprint others share. Texts are shuffled once, by
    id; the beginnings that documents lend each other go to rows that are already in place.
    """
    texts = docs.select(
        F.coalesce(F.col(doc), F.lit(-(1 << 63))).alias("k"), F.col(doc).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    prints = texts.select("k", "doc_id", "h", F.length("text").cast("long").alias("n_chars"), digest(canonical(F.col("text"))).alias("fingerprint"))
    prints = materialize(prints.groupBy(*prints.columns).agg(F.count(F.lit(1)).alias("times")), "prints")
    if not prints.where("times > 1").isEmpty():
        texts = texts.groupBy("k", "doc_id", "h").agg(F.first("text").alias("text"))
    ordered = materialize(with_order(prints, ["k", "h"], lead=["k", "h", "fingerprint"]), "neighbours")
    # the first document follows the last one; a lone document follows itself
    first = F.broadcast(ordered.where("_pos = 0").select(F.struct("k", "h", "fingerprint").alias("first")))  # one row
    follow = F.when(F.col("_next_k").isNull(), F.col("first")).otherwise(
        F.struct(F.col("_next_k").alias("k"), F.col("_next_h").alias("h"), F.col("_next_fingerprint").alias("fingerprint"))
    )
    chain = ordered.crossJoin(first).withColumn("next", follow).withColumn("tail", F.floor(F.col("n_chars") / 4).cast("int"))
    asks = chain.select(F.col("next.k").alias("k"), F.col("next.h").alias("h"), F.struct("k", "h").alias("asker"), F.col("tail").alias("give"))
    shared = materialize(shared_buckets(prints), "shared").withColumn("shared", F.lit(True))
    narrow = materialize(
        chain.select("k", "h", "doc_id", "n_chars", "times", "fingerprint", F.col("next.fingerprint").alias("next_print"), "tail")
        .join(asks, ["k", "h"])
        .join(shared, "fingerprint", "left"),
        "chain",
    )
    # the same projection on both sides of the second join, so that Spark reuses one exchange of texts
    own = texts.select("k", "h", "text").join(narrow.withColumnRenamed("h", "_h").hint("shuffle_hash"), "k").where("h = _h")
    heads = own.select(F.col("asker.k").alias("k"), F.col("asker.h").alias("_asker"), F.substring("text", F.lit(1), F.col("give")).alias("head"))
    both = own.join(heads.hint("shuffle_hash"), "k").where("h = _asker")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("tail")).cast("int")), "head"))
    edited = edited.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    rows = edited.select(
        "doc_id", "n_chars", "times", "fingerprint", "next_print",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("edited_canon")).alias("edited_fingerprint"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        F.when(F.col("shared"), F.col("canon")).alias("canon"),
    )
    return materialize(rows, "edited")


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with equal-text groups.

    An exact digest has likeness 1 where canonical texts agree and 0 elsewhere.
    """
    rows = edited_prints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = groups(rows.drop("canon"), rows.where("canon IS NOT NULL").select("doc_id", "fingerprint", "canon"))
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        (F.col("fingerprint") == F.col("next_print")).cast("double").alias("near_next"), "group_id",
    )
