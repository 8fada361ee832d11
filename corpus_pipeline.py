"""A corpus pipeline of five operators; each stage works on all that its predecessor kept.

1. toxicity: documents that the network scores as toxic go;
2. near_duplicates: of documents linked by 80 % Jaccard over five-word shingles one stays, the smallest id;
3. secrets: every finding in a text is masked;
4. mixture: documents are repeated or left out so that sources approach their target weights;
5. packing: documents become sequences of at most 2048 tokens (one row for each piece).

Defined cases, for all stages: an empty table gives an empty table; all but the last stage return the
columns of their input, whatever the names of extra ones; rows are decided by their own text, so a null or
repeated ``doc_id`` neither loses nor keeps another row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlake.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from emberlake.storage import materialize

#: The network of the first stage is trained, not written down in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like others (they have no words) and stay unless the score says toxic; repeated rows go or stay together."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts link with nothing and stay; rows that repeat id and text are copies, of which one stays."""
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; null texts stay null and texts without findings stay as they are; ``n_chars`` follows the masked text."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are left out; a null source is one of its own; rows of one id and source are taken together."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text is its end id alone; repeated rows are packed as often as they occur; ids may be null."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
