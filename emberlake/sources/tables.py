"""Reading and writing the library's tables: drifting feeds, yearly partitions, manifests, metrics."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.operators.scans import Segments, fresh, value_hash
from emberlake.storage import materialize


def column_of(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """The first of ``names`` that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return have[n.lower()]
    if required:
        raise KeyError(f"none of {names} in {df.columns}")
    return None


def _text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, place, value`` of text files; ``place`` puts a file's lines in order, in whatever tasks they are read."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")


def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each file with ``nth`` from 1: only lines at the head of some block are put in order."""
    blocks = lines.groupBy("file", "place.block").agg(F.min("place.line").alias("_first"))  # one row for each block of a file
    heads = lines.withColumn("block", F.col("place.block")).join(blocks, ["file", "block"]).where(F.col("place.line") - F.col("_first") < n)
    ranked = heads.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("place")))
    return ranked.where(F.col("nth") <= n).select("file", "place", "value", "nth")


def read_stations(spark: SparkSession, path: str, drop: tuple[str, ...] = (), encoding: str = "ISO-8859-1") -> DataFrame:
    """Station files with eight lines about the station, then a header and ``;`` rows.

    City, latitude and longitude stand on lines 3, 5 and 6 as ``LABEL;VALUE``. Rows with fewer fields than
    the header go; surplus fields go. Columns come back as text, with ``city``, ``lat`` and ``lon``; files may
    have different headers, so rows are maps first and columns by the union of headers. Files are read by
    lines, so a large one is many tasks; a file that ends before its header adds nothing.
    """
    lines = _text_lines(spark, path).withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    nth = lambda i: F.max(F.when(F.col("nth") == i, F.col("value")))
    value = lambda i: F.trim(F.get(F.split(nth(i), ";"), F.lit(1)))
    names = F.filter(F.transform(F.split(nth(9), ";"), lambda c: F.trim(c)), lambda c: c != "")
    heads = _first_lines(lines, 9).groupBy("file").agg(value(3).alias("city"), value(5).alias("lat"), value(6).alias("lon"), names.alias("names"), F.max_by("place", "nth").alias("head"))
    files = materialize(heads.where(F.size("names") > 0), "stations")  # one row for each file
    each = lines.join(files, "file").where(F.col("place") > F.col("head")).withColumn("v", F.split("value", ";")).where(F.size("v") >= F.size("names"))
    named = each.select("city", "lat", "lon", F.map_from_arrays("names", F.slice("v", F.lit(1), F.size("names"))).alias("m"))
    headers = [r[0] for r in files.select(F.explode("names")).distinct().collect()]  # as many rows as columns
    return named.select("city", "lat", "lon", *[F.trim(F.col("m")[h]).alias(h) for h in sorted(headers) if h not in drop])


# Fields of a CSV line: quoted ones (a doubled quote stands for one), others, and what a line end inside quotes leaves open.
_INSIDE = r'(?:[^"]|"")*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+'
_OPENS = rf'(?:{_FIELD},)*+"{_INSIDE}\z'  # a line, or what is left of it, whose last field stays open


def whole_records(lines: DataFrame) -> DataFrame:
    """``file, place, value`` of CSV lines, with lines joined whose line end stands inside quotes (it becomes ``\\n``).

    Whether a line begins inside quotes depends on all lines before it: each line maps that state to the next one, and
    the maps are composed along range partitions, so a large file stays many tasks. A file without such lines passes
    unchanged. A quote that is never closed makes the rest of its file one record.
    """
    opened = F.col("value").rlike(rf"\A{_OPENS}").cast("int")  # beginning outside, does the line end inside?
    again = F.col("value").rlike(rf'\A{_INSIDE}(?:\z|"[^,]*+,{_OPENS})').cast("int")  # and beginning inside?
    told = lines.select("file", "place", "value", opened.alias("opened"), again.alias("again"))
    if told.where("opened = 1").isEmpty():
        return lines
    s = Segments(told.select("file", "place.block", "place.line", "place", "value", "opened", "again"), ["file"], ["block", "line"])
    # a line either turns the state round, or leaves it, or ends in the same state whatever it began in
    turned = (F.col("opened") > F.col("again")).cast("int")
    fixed = F.col("opened") == F.col("again")
    rows = s.rows.withColumn("turns", F.sum(turned).over(s.upto))
    rows = rows.withColumn("since", F.when(fixed, (F.col("opened") + F.col("turns")) % 2))
    each = rows.groupBy(s.part, s.key).agg(F.max("turns").alias("all"), F.max_by("since", F.when(F.col("since").isNotNull(), F.struct("block", "line"))).alias("end"))
    before = Window.partitionBy(s.key).orderBy(s.part).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("all").over(before), F.lit(0))
    each = each.withColumn("earlier", earlier).withColumn("kept", (F.col("end") + F.col("earlier")) % 2)
    begun = (F.coalesce(F.last("kept", ignorenulls=True).over(before), F.lit(0)) + F.col("earlier")) % 2
    rows = rows.join(each.select(s.part, s.key, begun.alias("begun")), [s.part, s.key])
    after = (F.coalesce(F.last("since", ignorenulls=True).over(s.upto), F.col("begun")) + F.col("turns")) % 2
    rows = rows.withColumn("after", after).withColumn("inside", F.coalesce(F.lag("after").over(s.own), F.col("begun")))
    rows = s.carry({"starts": F.sum(1 - F.col("inside"))}, lambda _, w: {"starts": F.coalesce(F.sum("starts").over(w), F.lit(0))}, rows)
    rows = rows.withColumn("record", F.sum(1 - F.col("inside")).over(s.upto) + F.col("starts"))
    alone = rows.where("inside = 0 AND after = 0").select("file", "place", "value")
    parts = rows.where("inside = 1 OR after = 1").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))
    joined = parts.select("file", F.col("parts")[0]["place"].alias("place"), F.array_join("parts.value", "\n").alias("value"))
    return alone.unionByName(joined)


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Event CSV as text columns, by the union of all files' headers; one scan by lines, so a large file is many tasks.

    A file with bytes that are not UTF-8 is read as Latin-1. Fields in quotes may hold commas, doubled quotes and line ends.
    Empty lines, lines that repeat their file's header and records whose number of fields is not the header's are skipped;
    a file without lines adds nothing.
    """
    lines = _text_lines(spark, path)
    files = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min_by("value", "place").alias("head"))
    plain = lambda c: F.when(F.col("utf8"), F.col(c)).otherwise(F.decode(F.col(c).cast("binary"), "ISO-8859-1"))
    files = files.select("file", "utf8", "head", F.regexp_replace(plain("head"), "^\ufeff", "").alias("header"))
    headers = sorted(r[0] for r in files.select("header").distinct().collect())  # as many rows as headers
    names = {h: [x.strip() for x in next(csv.reader([h]), [])] for h in headers}
    fields = F.size(F.split(F.regexp_replace("r", rf'(?:\A|(?<=,))"{_INSIDE}"', ""), ","))  # commas outside quotes
    wanted = F.coalesce(*[F.when(F.col("header") == h, len(n)) for h, n in names.items()], F.lit(0))
    rows = whole_records(lines).join(files, "file").where((F.col("value") != F.col("head")) & (F.col("value") != "")).select("header", plain("value").alias("r")).where(fields == wanted)
    most = max(map(len, names.values()), default=0)
    split = rows.select("header", F.from_csv("r", ", ".join(f"f{i} string" for i in range(most)) or "f0 string", {"escape": '"', "multiLine": "true"}).alias("s"))
    columns = dict.fromkeys(x for n in names.values() for x in n)
    found = lambda c: F.coalesce(*[F.when(F.col("header") == h, F.col(f"s.f{n.index(c)}")) for h, n in names.items() if c in n], F.lit(None))
    return split.select(*[found(c).alias(c) for c in columns])


def read_columns(spark: SparkSession, path: str, wanted: list[str], as_float: bool = False) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist (the scan reads no others), and those that do not."""
    df = spark.read.parquet(path)
    have = [c for c in wanted if c in df.columns]
    cast = lambda c: F.col(c).cast("float").alias(c) if as_float and dict(df.dtypes)[c] in ("double", "int", "bigint") else F.col(c)
    return df.select(*[cast(c) for c in have]), [c for c in wanted if c not in df.columns]


def write_yearly(df: DataFrame, path: str, partitions: tuple[str, ...] = ("year",), order: list[str] | None = None, rows: int = 2_000_000) -> None:
    """Partitioned Parquet; years that are present in ``df`` are replaced, others stay.

    A year with more than about ``rows`` rows is dealt, by a hash, to several tasks and files.
    """
    parts, share = fresh(df, "_parts"), fresh(df, "_share")
    sizes = df.groupBy(*partitions).agg(F.ceil(F.count(F.lit(1)) / rows).alias(parts))  # one row for each year
    key, own = fresh(df, "_key"), F.struct(*partitions)
    told = df.withColumn(key, own).join(sizes.select(own.alias(key), parts), key)
    dealt = told.withColumn(share, F.pmod(value_hash(df), F.col(parts)))
    n = max(1, sizes.agg(F.coalesce(F.sum(parts), F.lit(1))).first()[0])
    spread = dealt.repartition(min(n, 100_000), *partitions, share).sortWithinPartitions(*partitions, *(order or []))
    spread.select(*df.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def years_in_names(spark: SparkSession, path: str, pattern: str = r"(\d{4})") -> DataFrame:
    """Years that the names of the files below ``path`` carry (first group of ``pattern``); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(name, pattern, 1)
    return files.select(F.when(found != "", found).cast("int").alias("year")).where("year IS NOT NULL").distinct()


def chosen_years(one: DataFrame, two: DataFrame, least: int, wanted: list[int] | None = None) -> DataFrame:
    """Years that both sources have, from ``least`` on, and among the ``wanted`` ones if any are named."""
    keep = (F.col("year") >= least) & F.col("year").isin(wanted) if wanted else F.col("year") >= least
    # years are counted together before they are dealt out: few rows meet, however many the sources have
    seen = [d.select("year").where(keep).groupBy("year").agg(F.lit(True).alias(name)) for d, name in ((one, "_one"), (two, "_two"))]
    return seen[0].join(seen[1], "year").select("year")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def consolidate(df: DataFrame, path: str, mode: str = "split", year: str = "year", overwrite: bool = False) -> list[str]:
    """Write ``split`` (below ``path``/split, a folder for each year), ``combine`` (``path``/all) or ``both``.

    Years or tables that are present stay as they are unless ``overwrite``. Returns the paths. Null years are not written.
    """
    if mode not in ("split", "combine", "both"):
        raise ValueError(f"mode {mode!r} is not split, combine or both")
    spark, rows, paths = df.sparkSession, df.where(F.col(year).isNotNull()), []
    if mode in ("split", "both"):
        paths.append(f"{path}/split")
        have = None if overwrite else _existing(spark, paths[-1])
        fresh = rows if have is None else rows.join(have.select(year).distinct(), year, "left_anti")
        write_yearly(fresh, paths[-1], (year,))
    if mode in ("combine", "both"):
        paths.append(f"{path}/all")
        if overwrite or _existing(spark, paths[-1]) is None:
            rows.write.mode("overwrite").parquet(paths[-1])
    return paths


def pending_years(candidates: DataFrame, manifest: DataFrame, overwrite: bool = False) -> DataFrame:
    """Years to process: candidates without a finished entry in the manifest."""
    years = candidates.select("year").distinct()
    return years if overwrite else years.join(manifest.where("status = 'done'").select("year"), "year", "left_anti")


def append_issues(df: DataFrame, path: str) -> None:
    """Append issue rows with a fixed column order."""
    df.select("at", "stage", "item", "severity", "message").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a tree ``<model>/<variation>/<scenario>/metrics_*.json``, one flat row each; path parts fill gaps."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("_p", F.split(F.col("_metadata.file_path"), "/"))
    part = lambda i: F.element_at("_p", -i)
    have = set(raw.columns)
    pick = lambda c, i: F.coalesce(F.col(c), part(i)) if c in have else part(i)
    return raw.select(pick("model_type", 4).alias("model"), pick("variation", 3).alias("variation"), pick("scenario", 2).alias("scenario"), F.col("timestamp") if "timestamp" in have else F.lit(None).cast("string").alias("timestamp"), "metrics.*")


def biome_dictionary(df: DataFrame, place: list[str], biome: str, year: str) -> DataFrame:
    """One row for each place and biome with its years as text: ``2003;2004``."""
    years = F.array_join(F.transform(F.sort_array(F.collect_set(year)), lambda y: y.cast("string")), ";")
    return df.groupBy(*place, biome).agg(years.alias("years"))


def nested_dictionary(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """``outer`` with a map from ``inner`` to its sorted values, as JSON."""
    lists = df.groupBy(outer, inner).agg(F.sort_array(F.collect_set(value)).alias("_v"))
    return lists.groupBy(outer).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "_v"))))).alias("nested"))
