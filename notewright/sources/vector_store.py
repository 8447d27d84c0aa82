"""A stored table of cases with replacement by id, in versions.

Rows lie in buckets by a hash of their id. A merge reads only the buckets that its rows fall
into, writes them anew to a folder of their own, and last of all writes the list of the folder
that holds each bucket under a new version number. Readers take the newest list, so a merge that
fails or is still running shows nothing, and earlier versions stay readable. Merges into one
store must not run at the same time: the second to finish would be refused by its version's
folder, which exists.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, TEXT, LabelScheme
from notewright.session import cut_lineage

BUCKETS = 16
_BUCKET, _FOLDER, _VERSION = "_bucket", "_folder", "_version"


def _bucket(buckets: int, id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int")


def _one_per_id(cases: DataFrame, id_col: str) -> DataFrame:
    """One row per id, the largest of those that share it; rows without an id are left out."""
    others = [c for c in cases.columns if c != id_col]
    rows = cases.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct(*others)).alias("_row"))
    return rows.select(id_col, "_row.*")


def _write(rows: DataFrame, path: str, buckets: int, id_col: str) -> str:
    """Write rows by bucket to a new folder, sorted by id inside it."""
    name = uuid.uuid4().hex
    placed = rows.withColumn(_BUCKET, _bucket(buckets, id_col)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, id_col)
    placed.write.partitionBy(_BUCKET).parquet(f"{path}/rows/{name}")
    return name


def _publish(spark: SparkSession, path: str, version: int, folders: dict[int, str | None], buckets: int) -> None:
    """The list of a version: a row per bucket, with no folder where it is empty."""
    rows = [(bucket, folders.get(bucket)) for bucket in range(buckets)]
    listed = spark.createDataFrame(rows, f"{_BUCKET} int, {_FOLDER} string").coalesce(1)
    listed.write.mode("error").parquet(f"{path}/versions/{_VERSION}={version}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Every list of the store: bucket, folder and number of the version; an error if there is no store."""
    try:
        return spark.read.parquet(f"{path}/versions")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no case store at {path}") from missing


def _list(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict[int, str | None]]:
    lists = versions(spark, path)
    number = version if version is not None else lists.agg(F.max(_VERSION)).first()[0]
    rows = lists.filter(F.col(_VERSION) == number).collect()  # a row per bucket
    if not rows:
        raise ValueError(f"the case store at {path} has no version {number}")
    return number, {r[_BUCKET]: r[_FOLDER] for r in rows}


def _schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(f"{path}/schema").schema


def _read(spark: SparkSession, path: str, folders: dict[int, str | None]) -> DataFrame:
    schema = _schema(spark, path)
    paths = [f"{path}/rows/{folder}/{_BUCKET}={bucket}" for bucket, folder in folders.items() if folder is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def build_case_store(cases: DataFrame, path: str, buckets: int = BUCKETS, id_col: str = ID) -> DataFrame:
    """Start a store at ``path`` with one row per id, and return it; ids keep their type.

    A bucket is written by one task, so their number should grow with the store.
    """
    spark = cases.sparkSession
    rows = _one_per_id(cases, id_col)
    # The schema is a table of its own, so that a store without rows can be read.
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/schema")
    name = _write(rows, path, buckets, id_col)
    kind = T.StructType([*rows.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    held = spark.read.schema(kind).parquet(f"{path}/rows/{name}").select(_BUCKET).distinct().collect()  # at most the buckets
    _publish(spark, path, 0, {r[_BUCKET]: name for r in held}, buckets)
    return load_case_store(spark, path)


def merge_cases(cases: DataFrame, path: str, id_col: str = ID) -> list[int]:
    """Put ``cases`` in the store: rows replace the stored row of their id, others are added. Gives the buckets rewritten.

    ``cases`` must have the store's columns. Of rows that share an id the largest is taken.
    """
    spark = cases.sparkSession
    number, folders = _list(spark, path, None)
    columns = _schema(spark, path).names
    rows = cut_lineage(_one_per_id(cases.select(columns), id_col))
    touched = [r[0] for r in rows.select(_bucket(len(folders), id_col)).distinct().collect()]  # at most the buckets
    if not touched:
        return []
    old = _read(spark, path, {bucket: folders[bucket] for bucket in touched})
    merged = old.join(rows.select(id_col), id_col, "left_anti").select(columns).unionByName(rows)
    name = _write(merged, path, len(folders), id_col)
    _publish(spark, path, number + 1, folders | dict.fromkeys(touched, name), len(folders))
    return sorted(touched)


def load_case_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored cases of the newest version, or of an earlier one; an error if there is no store."""
    return _read(spark, path, _list(spark, path, version)[1])


def case_columns(df: DataFrame, scheme: LabelScheme = SCHEME, id_col: str = ID) -> DataFrame:
    """The columns of a labelled case with its vector, as a search expects them."""
    return df.select(
        id_col, TEXT, F.col(scheme.flag_a).cast("double").alias(scheme.flag_a), F.col(scheme.flag_b).cast("double").alias(scheme.flag_b),
        LABEL, EMBEDDING,
    )
