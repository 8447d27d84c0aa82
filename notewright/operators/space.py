"""Geometry of an embedding space: centroids, spread and a linear projection."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import preview
from notewright.functions.vectors import cosine, dot
from notewright.schema import EMBEDDING, ID, LABEL, TEXT


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).withColumn(
        "features", array_to_vector(F.col(vector).cast("array<double>"))
    )


def class_centroids(df: DataFrame, label_col: str = LABEL, vector: str = EMBEDDING) -> DataFrame:
    """Mean vector per class, as an array of doubles; sums are combined before the shuffle."""
    means = _vectors(df, vector).groupBy(label_col).agg(Summarizer.mean(F.col("features")).alias("mean"))
    return means.select(label_col, vector_to_array("mean").alias("centroid"))


def centroid_similarity(centroids: DataFrame, labels: tuple[str, ...], label_col: str = LABEL) -> DataFrame:
    """Cosine between the centroids of each pair of classes, earlier class first.

    The centroids, one per listed class, are put into one row and paired there.
    """
    listed = F.array(*[F.lit(label) for label in labels])
    item = F.struct(F.array_position(listed, F.col(label_col)).alias("place"), F.col(label_col).alias("label"), "centroid")
    row = centroids.filter(F.col(label_col).isin(*labels)).agg(F.sort_array(F.collect_list(item)).alias("all"))
    firsts = row.select("all", F.explode("all").alias("a"))
    pairs = firsts.select("a", F.explode(F.filter("all", lambda b: b["place"] > F.col("a.place"))).alias("b"))
    return pairs.select(
        F.col("a.label").alias("label_a"),
        F.col("b.label").alias("label_b"),
        cosine(F.col("a.centroid"), F.col("b.centroid")).alias("similarity"),
    )


def class_spread(df: DataFrame, label_col: str = LABEL, vector: str = EMBEDDING) -> DataFrame:
    """Mean cosine distance of a class's vectors to its centroid.

    The mean cosine to the centroid is the mean unit vector times the unit
    centroid, so one aggregation gives the answer without a second look at rows.
    """
    unit = Normalizer(p=2.0, inputCol="features", outputCol="unit").transform(_vectors(df, vector))
    sums = unit.groupBy(label_col).agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("centroid"),
        vector_to_array(Summarizer.mean(F.col("unit"))).alias("direction"),
    )
    length = F.sqrt(dot(F.col("centroid"), F.col("centroid")))
    return sums.select(
        label_col, (1.0 - dot(F.col("direction"), F.col("centroid")) / length).alias("mean_distance")
    )


def project_2d(
    df: DataFrame, vector: str = EMBEDDING, id_col: str = ID, label_col: str = LABEL
) -> tuple[DataFrame, list[float]]:
    """Centred projection on the two main axes, and the share of variance of each.

    Each axis points so that its largest entry is positive, which makes the
    result the same from run to run.
    """
    rows = _vectors(df, vector)
    centre = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(rows)
    centred = centre.transform(rows)
    model = PCA(k=2, inputCol="centred", outputCol="axes").fit(centred)
    axes: DenseMatrix = model.pc
    turn = [1.0 if column[np.abs(column).argmax()] >= 0 else -1.0 for column in axes.toArray().T]
    place = vector_to_array("axes")
    columns = [F.col(id_col), F.col(label_col)]
    if TEXT in df.columns:
        columns.append(preview(F.col(TEXT), 100).alias("text_preview"))
    projected = model.transform(centred).select(
        *columns, (place[0] * turn[0]).alias("pc1"), (place[1] * turn[1]).alias("pc2")
    )
    return projected, [float(v) for v in model.explainedVariance]


def variance_table(spark: SparkSession, shares: list[float]) -> DataFrame:
    """Share of the variance per main axis, numbered from 1: what ``project_2d`` explains, as a table."""
    return spark.createDataFrame(list(enumerate(shares, start=1)), "axis int, share double")
