"""Text embedding as a batch job, with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as fv
from notewright.schema import EMBEDDING, TEXT
from notewright.session import cut_lineage

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_embedder(df: DataFrame, dim: int = fv.EMBEDDING_DIM, text: str = TEXT) -> PipelineModel:
    """The built-in embedder: hashed, idf-weighted, unit-length term vectors."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit"),
    ]).fit(df)


def embed_hashed(df: DataFrame, model: PipelineModel, vector: str = EMBEDDING) -> DataFrame:
    """Add the built-in embedding as an array of floats."""
    array = vector_to_array("_unit", "float32")
    return model.transform(df).withColumn(vector, array).drop("_words", "_counts", "_weighted", "_unit")


def embed_text(
    df: DataFrame,
    make_embedder: Callable[[], Embedder],
    dim: int = fv.EMBEDDING_DIM,
    batch: int = fv.EMBEDDING_BATCH,
    text: str = TEXT,
    vector: str = EMBEDDING,
) -> DataFrame:
    """Add an embedding made by ``make_embedder()``, called ``batch`` texts at a time.

    The embedder is built once per partition. A result of the wrong shape, or
    holding a value that is no number, fails the task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
            parts = [np.empty((0, dim), dtype=np.float32)]
            for start in range(0, len(texts), batch):
                part = np.asarray(embedder([t or "" for t in texts[start:start + batch]]), dtype=np.float32)
                if part.shape != (len(texts[start:start + batch]), dim) or not np.isfinite(part).all():
                    raise ValueError(f"an embedder must return finite rows of length {dim}")
                parts.append(part)
            flat = np.concatenate(parts).ravel()
            offsets = np.arange(0, len(flat) + 1, dim, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*rows.columns, vectors], names=[*rows.schema.names, vector])

    return df.mapInArrow(run, schema)


def embed_once(
    df: DataFrame,
    make_embedder: Callable[[], Embedder],
    path: str,
    model: str,
    dim: int = fv.EMBEDDING_DIM,
    batch: int = fv.EMBEDDING_BATCH,
    waves: int = 1,
    text: str = TEXT,
    vector: str = EMBEDDING,
) -> DataFrame:
    """Add an embedding, kept at ``path`` by model and SHA-256 of the text, so that no text is embedded twice.

    Equal texts are embedded once, and texts that an earlier run has embedded for ``model`` not at
    all. New texts go in ``waves`` parts, each of which is kept when it is done, so that a run that
    was cut off goes on where it stopped. A missing text is the empty text.
    """
    spark = df.sparkSession
    kept = T.StructType([T.StructField("content", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    folder = f"{path}/model={quote(model, safe='')}"
    spark.createDataFrame([], kept).write.mode("append").parquet(folder)

    def known() -> DataFrame:
        return spark.read.schema(kept).parquet(folder)

    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    # Texts are told apart by narrow rows, so that only the ones to embed are moved.
    texts = cut_lineage(df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), content.alias("content"))
                        .withColumn("row", F.monotonically_increasing_id()))
    new = cut_lineage(texts.groupBy("content").agg(F.min("row").alias("row")).join(known().select("content"), "content", "left_anti"))
    for wave in range(waves):
        part = new.filter(F.pmod(F.xxhash64("content"), F.lit(waves)) == wave).select("row")
        fresh = texts.join(part, "row", "left_semi").select("content", "t")
        made = embed_text(fresh, make_embedder, dim, batch, "t", "vector").select("content", "vector")
        made.write.mode("append").parquet(folder)
    return df.withColumn("_content", content).join(known().select(F.col("content").alias("_content"), F.col("vector").alias(vector)), "_content").drop("_content")


def check_embeddings(df: DataFrame, dim: int, vector: str = EMBEDDING) -> DataFrame:
    """Rows, rows of the right length, and rows holding a value that is no number."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.size(vector) == dim).alias("n_right_length"),
        F.count_if(F.exists(vector, lambda x: F.isnan(x) | x.isNull())).alias("n_not_a_number"),
    )
