"""Reading note tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import clean_flag
from notewright.schema import EMBEDDING, ID, SCHEME, TEST_SET, TEXT, LabelScheme
from notewright.sources.csv_records import read_split_csv

# Quoted cells may span lines, and a quote inside them is doubled.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
# Written cells keep their outer spaces, and empty text stays apart from a missing cell.
CSV_WRITE_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "quoteAll": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def load_notes(
    spark: SparkSession, path: str, scheme: LabelScheme = SCHEME, embeddings: str = "embeddings", split: bool = False
) -> DataFrame:
    """A CSV note table with typed columns.

    All cells are read as text and cast by column name, so no type is guessed
    and columns may come in any order. Missing text becomes ``''``; NaN flags
    become NULL; an ``embeddings`` column of ``[f, f, ...]`` text becomes an
    array. A file is read in one task, or with ``split`` in one for each byte
    range; the rows are the same where quotes are balanced.
    """
    raw = read_split_csv(spark, path, CSV_OPTIONS) if split else spark.read.options(**CSV_OPTIONS).csv(path)
    missing = raw[TEXT].isNull() | raw[TEXT].isin(*fv.MISSING_STRINGS)
    casts = {
        ID: raw[ID].try_cast("bigint"),
        TEXT: F.when(missing, F.lit("")).otherwise(raw[TEXT]),
        scheme.flag_a: clean_flag(raw[scheme.flag_a].try_cast("double")),
        scheme.flag_b: clean_flag(raw[scheme.flag_b].try_cast("double")),
    }
    if TEST_SET in raw.columns:
        casts[TEST_SET] = raw[TEST_SET].try_cast("double").cast("int")
    df = raw.withColumns(casts)
    if embeddings in raw.columns:
        df = df.withColumn(EMBEDDING, parse_embedding_text(F.col(embeddings)))
        df = df if embeddings == EMBEDDING else df.drop(embeddings)
    return df


def parse_embedding_text(cell: Column) -> Column:
    """A vector written as ``[f, f, ...]``, as an array of floats."""
    return F.from_json(cell, "array<double>").cast("array<float>")


def embedding_text(vector: Column) -> Column:
    """A vector as ``[f, f, ...]`` text."""
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ", "), F.lit("]"))


def write_notes_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV files that ``load_notes`` reads back unchanged."""
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """A note table stored as Parquet."""
    return spark.read.parquet(path)


def write_notes(df: DataFrame, path: str) -> None:
    """Store a note table as Parquet, one folder per value of ``test_set``."""
    df.write.mode("overwrite").partitionBy(TEST_SET).parquet(path)
