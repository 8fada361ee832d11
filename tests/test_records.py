"""Event files with line ends inside quotes, against Python's csv module, in any split; yearly files in several tasks."""

from __future__ import annotations

import csv
import io
import os
import random

from pyspark.sql import functions as F

from emberlake.sources import tables


def test_records_across_lines_equal_the_csv_module(spark, tmp_path):
    rng = random.Random(7)
    pieces = ["a", "b c", "1,5", "", 'say ""x""', "line\nend", "\n", '""', ",,", "é", "two\n\nlines"]
    kept, text = [], io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(["id", "name", "more"])
    for i in range(3000):
        row = [str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(4))), rng.choice(["x", "", "q\nr", '"'])]
        if rng.random() < 0.05:
            text.write('5,5" pipe,stays\n')  # a quote inside a field without quotes is a character
            kept.append(("5", '5" pipe', "stays"))
        if rng.random() < 0.05:
            text.write("\n")
        if rng.random() < 0.05:
            text.write("1,2,3,4\n")  # too many fields
        out.writerow(row)
        kept.append(tuple(row))
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text(text.getvalue(), encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text("more,id\nplain,77\n", encoding="utf-8")
    kept.append(("77", None, "plain"))
    want = sorted((i, n or "", m or "") for i, n, m in kept)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4k", old):  # records cross splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = tables.read_events(spark, str(tmp_path / "in"))
            got = sorted((r["id"], r["name"] or "", r["more"] or "") for r in df.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want


def test_quoted_line_end_of_a_small_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n2,plain\n3,"open\nto the end\n', encoding="utf-8")
    got = {r["id"]: r["name"] for r in tables.read_events(spark, str(tmp_path / "a.csv")).collect()}
    assert got["1"] == "two\nlines" and got["2"] == "plain"


def test_years_in_several_tasks(spark, tmp_path):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, 2001).when(F.col("id") % 10 < 9, 2002).alias("year"), F.lit(1).alias("_share"))
    tables.write_yearly(df, str(tmp_path / "y"), rows=500)
    files = [f for _, _, names in os.walk(tmp_path / "y" / "year=2001") for f in names if f.endswith(".parquet")]
    assert len(files) >= 4
    back = spark.read.parquet(str(tmp_path / "y"))
    assert back.count() == 5000 and back.where("year IS NULL").count() == 500
    tables.write_yearly(df.where("year = 2002").limit(10), str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).groupBy("year").count().where("year = 2002").first()["count"] == 10
    assert spark.read.parquet(str(tmp_path / "y")).where("year = 2001").count() == 3500
