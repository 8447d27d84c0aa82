"""Row-local operators on notes that keep arriving.

Labels, rules, answers and routing are column expressions, so they work on a
stream as they are; this module only reads and writes the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.rules import cancer_keyword, diabetes_keyword
from notewright.schema import TEXT, notes_schema


def read_note_stream(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet note files under ``path`` (a folder or pattern), as they appear."""
    return spark.readStream.schema(schema or notes_schema()).parquet(path)


def with_keyword_flags(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Add the routing keyword flags to a table or a stream."""
    return df.withColumns({
        "has_cancer_kw": cancer_keyword(F.col(text)),
        "has_diabetes_kw": diabetes_keyword(F.col(text)),
    })


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what a stream holds now, append it to Parquet under ``path`` and return.

    Files already recorded in ``checkpoint`` are not read again.
    """
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
