"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A shard is three files in the shared folder: ``.bin`` (ids, little-endian uint16, or uint32 for large
vocabularies), ``.idx`` (int64 offsets of documents in ids, one more than documents) and ``.doc``
(int64 document ids). Documents are range-partitioned by id and a hash of the text, so shard after shard
they ascend and rows of one id, or of none, are several shards; a shard's place in the whole corpus is its base, a prefix sum over shards. A task that runs again writes files
of new names, and only files named in the written manifest count.

The unindexed form is a ``.bin`` alone: documents end where the end-of-document id stands. Its
counts come from a separator scan (``scan_separators``).

Defined cases: a null or empty text is its end id alone; a null document id is stored as the least
int64 and sorts first; repeated rows are written as often as they occur, rows of one id in the order of a
hash of their texts; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm import bpe
from emberlake.llm.workers import slices, small_batches, tidy
from emberlake.storage import materialize, shared_folder, shuffle_width

NO_ID = -(1 << 63)
BLOCK = 1 << 20  # ids that one step of a separator scan looks at
CHUNK = 1 << 20  # bytes of text encoded at once


def mounted(path: str) -> str:
    """The file-system path of a shared folder; memory mapping needs one that is mounted."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped; {path} is not a mounted folder")
    return unquote(u.path)


def _batches(batches, tokenizer: str, joins_space: bool, end: int, specials: bool = False):
    """(document ids, flat ids, counts) of each slice of Arrow batches."""
    enc = bpe.encoder(tokenizer, joins_space, end, specials)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at, n in slices(texts, CHUNK):
            some = [t or "" for t in texts.slice(at, n).to_pylist()]
            flat, counts = enc.encode(some)
            yield [NO_ID if x is None else x for x in ids[at : at + n]], flat, counts


def _stored(flat, dtype: str) -> bytes:
    """The ids as they stand in a file; an id that its type cannot hold is an error."""
    import numpy as np

    if len(flat) and int(flat.max()) > np.iinfo(dtype).max:
        raise ValueError(f"id {int(flat.max())} does not fit into {dtype}")
    return flat.astype(dtype).tobytes()


def write_files(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str, joins_space: bool = True, end: int = 0, specials: bool = False, dtype: str | None = None) -> DataFrame:
    """Write shards in ascending document order; returns the manifest ``shard, path, n_docs, n_ids, base, dtype``."""
    spark = docs.sparkSession
    small_batches(spark)
    dtype = dtype or bpe.id_type(tokenizer)
    folder = mounted(shared_folder(spark, "token-files"))

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with open(path + ".bin", "wb") as f, open(path + ".idx", "wb") as g, open(path + ".doc", "wb") as h:
            g.write(np.zeros(1, "<i8").tobytes())
            for ids, flat, counts in _batches(batches, tokenizer, joins_space, end, specials):
                f.write(_stored(flat, dtype))
                g.write((n_ids + np.cumsum(counts)).astype("<i8").tobytes())
                h.write(np.array(ids, "<i8").tobytes())
                n_docs += len(ids)
                n_ids += len(flat)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    order = [F.col("d").asc_nulls_first(), F.xxhash64("t").asc(), F.col("t").asc_nulls_first()]
    ranged = docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange(shuffle_width(spark), *order[:2])
    shards = materialize(ranged.sortWithinPartitions(*order).mapInArrow(tidy(write, True), "shard long, path string, n_docs long, n_ids long"), "manifest")
    shards = shards.withColumn("dtype", F.lit(dtype))
    # one row for each shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).cast("long"))


def read_files(manifest: DataFrame) -> DataFrame:
    """Map the shards and return ``doc_id, start, n_tokens, ids_crc32`` of each document."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_ids"]:
                    continue
                ids = np.memmap(row["path"] + ".bin", row["dtype"], "r")
                at = np.memmap(row["path"] + ".idx", "<i8", "r")
                docs = np.array(np.memmap(row["path"] + ".doc", "<i8", "r"))
                for k in range(0, len(docs), 5000):
                    cut = np.array(at[k : k + 5001])
                    some = docs[k : k + 5000]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NO_ID), pa.array(row["base"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(shuffle_width(manifest.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode all documents to token files and read them back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, tokenizer=tokenizer or bpe.tokenizer_path("byte_bpe_50k.json"), specials=True))


def write_flat(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", tokenizer: str, joins_space: bool = True, end: int, dtype: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write flat files without an index, each task its own rows in their order: no shuffle. A name begins with its task's number.

    Returns ``(files, docs)``: ``path, n_ids`` and, to name the documents afterwards, ``path, nth, doc_id``.
    """
    folder = mounted(shared_folder(docs.sparkSession, "flat-files"))
    small_batches(docs.sparkSession)
    dtype = dtype or bpe.id_type(tokenizer)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        n_docs = n_ids = 0
        with open(path, "wb") as f:
            for ids, flat, _ in _batches(batches, tokenizer, joins_space, end):
                f.write(_stored(flat, dtype))
                n = len(ids)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * n, "nth": list(range(n_docs, n_docs + n)), "doc_id": [None if x == NO_ID else x for x in ids], "n_ids": [None] * n},
                    schema=schema,
                )
                n_docs += n
                n_ids += len(flat)
        yield pa.RecordBatch.from_pydict({"path": [path], "nth": [-1], "doc_id": [None], "n_ids": [n_ids]}, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64())])
    rows = materialize(
        docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(tidy(write, True), "path string, nth long, doc_id long, n_ids long"), "flat"
    )
    return rows.where("nth < 0 AND n_ids > 0").select("path", "n_ids", F.lit(dtype).alias("dtype")), rows.where("nth >= 0").select("path", "nth", "doc_id")


def scan_separators(files: DataFrame, *, end: int, block: int = BLOCK) -> DataFrame:
    """``path, nth, start, n_tokens`` of every document in flat files, the end id counted.

    Each file is cut into blocks that tasks search on their own; documents that cross blocks are
    stitched by a prefix scan over a file's block summaries (separators so far, place of the last).
    """

    def search(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.memmap(row["path"], row["dtype"], "r", offset=row["at"] * np.dtype(row["dtype"]).itemsize, shape=(row["size"],))
                found = np.flatnonzero(ids == end) + row["at"]
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "at": [row["at"]], "ends": [found]}, schema=schema)

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("ends", pa.list_(pa.int64()))])
    blocks = files.select("path", "n_ids", "dtype", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(block).cast("long"))).alias("at"))
    blocks = blocks.select("path", "dtype", "at", F.least(F.lit(block).cast("long"), F.col("n_ids") - F.col("at")).alias("size"))
    found = materialize(blocks.repartition(shuffle_width(files.sparkSession)).mapInArrow(search, "path string, at long, ends array<long>"), "separators")
    # block summaries: a file has as many as it has blocks
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "at", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    carried = summary.select(
        "path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior")
    )
    each = found.join(carried, ["path", "at"]).where(F.size("ends") > 0)
    each = each.select("path", "seen", "ends", F.concat(F.array("prior"), "ends").alias("starts"))
    each = each.select("path", "seen", F.posexplode(F.arrays_zip("starts", "ends")).alias("k", "d")).where("d.ends IS NOT NULL")
    return each.select(
        "path", (F.col("seen") + F.col("k")).cast("long").alias("nth"), (F.col("d.starts") + 1).alias("start"), (F.col("d.ends") - F.col("d.starts")).alias("n_tokens")
    )


END_OF_TEXT = 50256  # of byte_bpe_50k; special strings are ordinary text here, so no text encodes to it


def op8_token_counts(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token counts of all documents (end id included) from flat unindexed files; ``file`` is the number of the task that wrote it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, names = write_flat(docs, tokenizer=tokenizer or bpe.tokenizer_path("byte_bpe_50k.json"), end=END_OF_TEXT)
    counts = scan_separators(files, end=END_OF_TEXT)
    return names.join(counts, ["path", "nth"]).select("doc_id", "n_tokens", F.regexp_extract("path", "([0-9]+)-[^/]*$", 1).cast("long").alias("file"), "start")
