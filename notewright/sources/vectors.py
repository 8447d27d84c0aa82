"""Stored embeddings and tables of cases to search."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, TEXT, LabelScheme


def write_embeddings(df: DataFrame, path: str, id_col: str = ID, vector: str = EMBEDDING) -> None:
    """Store (id, embedding); missing parent folders are created."""
    df.select(id_col, vector).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Stored embeddings; an error when the path holds none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no embeddings at {path}") from missing


def build_vector_table(
    df: DataFrame,
    name: str,
    path: str | None = None,
    drop_existing: bool = True,
    buckets: int = 16,
    scheme: LabelScheme = SCHEME,
) -> DataFrame:
    """Store labelled cases as a table bucketed and sorted by id, and return it.

    The table is replaced, or appended to with ``drop_existing=False``, which
    may repeat ids (``vector_store.py`` replaces by id). Ids keep their type, so
    that equal scores rank by number.
    """
    spark = df.sparkSession
    cases = df.select(
        ID,
        TEXT,
        F.col(scheme.flag_a).cast("double").alias(scheme.flag_a),
        F.col(scheme.flag_b).cast("double").alias(scheme.flag_b),
        LABEL,
        EMBEDDING,
    )
    writer = cases.write.format("parquet").bucketBy(buckets, ID).sortBy(ID)
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("overwrite" if drop_existing else "append").saveAsTable(name)
    return spark.table(name)


def load_vector_table(spark: SparkSession, name: str) -> DataFrame:
    """A stored table of cases; an error when there is none of that name."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table {name} does not exist; create it with build_vector_table")
    return spark.table(name)


def newest_per_id(df: DataFrame, order: str, id_col: str = ID) -> DataFrame:
    """One row per id, the one with the highest ``order``: undoes repeated appends."""
    others = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.max_by(F.struct(*others), order).alias("_row")).select(id_col, "_row.*")
