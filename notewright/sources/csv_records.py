"""Reading CSV whose quoted cells span lines, in many tasks a file.

Spark's line reader splits a file into byte ranges. A line begins a record if an even number
of quotes stands before it in its file; that number comes from the sums of the ranges before and a
running sum inside the range, so no task reads more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.session import cut_lineage


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file``, ``record`` (ordered within its file) and its ``text``; blank records are left out.

    Quotes must be balanced and stand around cells or doubled inside them, as the CSV writer does.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
        (F.regexp_count("value", F.lit('"')) % 2).alias("odd"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quotes = cut_lineage(lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"))).select(
        "file", "block", F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("open")
    )
    # The lines of a range meet once; the running sum, its records and the last of them keep that partitioning.
    here = Window.partitionBy("file", "block")
    ordered = here.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("odd").over(ordered), F.lit(0))
    marked = lines.withColumn("running", running).join(quotes, ["file", "block"])
    begun = F.max(F.when((F.col("running") + F.col("open")) % 2 == 0, F.struct("block", "place")))
    marked = marked.withColumn("own", begun.over(here.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    parts = marked.groupBy("file", "block", "own").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    parts = cut_lineage(parts.select(
        "file", "block", "own", F.max("own").over(here).alias("last"), F.array_join(F.col("lines.line"), "\n").alias("text")
    ))
    # Only the first and the last record of a range may go on in another one.
    inner = parts.where("own < last").select("file", F.col("own").alias("record"), "text")
    carried = parts.groupBy("file", "block").agg(F.max("last").alias("last")).select(
        "file", "block", F.max("last").over(before).alias("carried")
    )
    edge = parts.where("own is null or own = last").join(carried, ["file", "block"]).groupBy(
        "file", F.coalesce("own", "carried").alias("record")
    ).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    whole = inner.unionByName(edge.select("file", "record", F.array_join(F.col("parts.text"), "\n").alias("text")))
    return whole.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_split_csv(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """A CSV table of text columns, as the multi-line reader gives it; the first record of each file is its header.

    All files have the same columns in the same order. A path without records gives a table without columns.
    """
    records = csv_records(spark, path)
    headers = cut_lineage(records.groupBy("file").agg(F.min_by("text", "record").alias("text"), F.min("record").alias("record")))
    first = headers.select("text").first()
    if first is None:
        return spark.createDataFrame([], "struct<>")
    names = spark.read.options(**options | {"header": "false"}).csv(spark.sparkContext.parallelize([first["text"].removeprefix("\ufeff")], 1)).first()
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    kept = {k: v for k, v in options.items() if k != "header"}
    rows = records.join(headers.select("file", "record"), ["file", "record"], "left_anti")
    return rows.select(F.from_csv("text", schema, kept).alias("row")).select("row.*")
