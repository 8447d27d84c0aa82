"""Spreading known labels over a nearest-neighbour graph."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import label_at
from notewright.operators.neighbours import top_k_cosine
from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, LabelScheme
from notewright.session import cut_lineage, scratch_path

# Share of a node's label that comes from its neighbours.
NEIGHBOUR_SHARE = 0.2
# Rounds between two writes of the state.
_WRITE_EVERY = 5


def neighbour_edges(
    df: DataFrame, k: int = fv.SPREADING["neighbours"], id_col: str = ID, vector: str = EMBEDDING
) -> DataFrame:
    """(query_id, neighbour_id) of each row's k nearest other rows."""
    near = top_k_cosine(df, df, k + 1, id_col, id_col, vector)
    others = near.filter(F.col("query_id") != F.col("neighbour_id"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    return (
        others.withColumn("place", F.row_number().over(by_rank))
        .filter(F.col("place") <= k)
        .select("query_id", "neighbour_id")
    )


def _bucketed(df: DataFrame, key: str, buckets: int) -> str:
    """Write ``df`` in buckets of ``key`` to the shared folder and return the name of its table."""
    name = f"spread_{uuid.uuid4().hex}"
    # One task a bucket, so that a bucket is one sorted file and is read without a sort.
    placed = df.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(df.sparkSession, name)).saveAsTable(name)
    return name


def spread_round(edges: DataFrame, start: DataFrame, state: DataFrame, names: Sequence[str]) -> DataFrame:
    """One round: each row's neighbours' mean, mixed with its own label.

    Edges lie in buckets of the neighbour, states in buckets of the id, so their join moves
    nothing; sums and counts per row are added up before they travel, and meet the starting labels
    in their buckets.
    """
    pulled = (
        edges.join(state.withColumnRenamed("id", "neighbour_id").hint("merge"), "neighbour_id")
        .groupBy(F.col("query_id").alias("id"))
        .agg(*[F.avg(n).alias(f"m{n}") for n in names])
    )
    mixed = [
        (F.coalesce(F.col(f"m{n}"), F.lit(0.0)) * NEIGHBOUR_SHARE + F.col(n) * (1.0 - NEIGHBOUR_SHARE)).alias(n)
        for n in names
    ]
    return start.join(pulled.hint("merge"), "id", "left").select("id", *mixed)


def _largest_change(before: DataFrame, after: DataFrame, names: Sequence[str]) -> float:
    old = before.select("id", *[F.col(n).alias(f"o{n}") for n in names])
    moved = F.greatest(*[F.abs(F.col(n) - F.col(f"o{n}")) for n in names], F.lit(0.0))
    return after.join(old, "id").agg(F.coalesce(F.max(moved), F.lit(0.0))).first()[0]


def spread_labels(
    df: DataFrame,
    known: str = LABEL,
    k: int = fv.SPREADING["neighbours"],
    rounds: int = fv.SPREADING["rounds"],
    scheme: LabelScheme = SCHEME,
    id_col: str = ID,
    vector: str = EMBEDDING,
    tolerance: float | None = None,
) -> DataFrame:
    """(id, probabilities, spread_label) of every row with a vector.

    ``known`` is NULL where a label is to be found. Every round a row's scores
    become ``NEIGHBOUR_SHARE`` of its neighbours' mean plus the rest of its own
    known label (``spread_round``), until ``rounds`` are done or, with a ``tolerance``,
    no score changes by more. Rows reached by no label have NULL results.
    """
    names = [f"f{i}" for i in range(len(scheme.labels))]
    nodes = df.filter(F.col(vector).isNotNull())
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = _bucketed(neighbour_edges(nodes, k, id_col, vector), "neighbour_id", buckets)
    start = _bucketed(nodes.select(
        F.col(id_col).alias("id"),
        *[F.coalesce((F.col(known) == label).cast("double"), F.lit(0.0)).alias(n)
          for n, label in zip(names, scheme.labels)],
    ), "id", buckets)
    tables, state, written = [edges, start], spark.table(start), start
    for done in range(1, rounds + 1):
        state = spread_round(spark.table(edges), spark.table(start), state, names)
        # The state keeps its buckets from round to round; it is written to be compared, or to keep plans short.
        if tolerance is not None or (done % _WRITE_EVERY == 0 and done < rounds):
            before, written = written, _bucketed(state, "id", buckets)
            tables.append(written)
            state = spark.table(written)
            if tolerance is not None and _largest_change(spark.table(before), state, names) <= tolerance:
                break
    state_rows = cut_lineage(state)
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    total = sum((F.col(n) for n in names), F.lit(0.0))
    scores = F.when(F.col("_total") > 0, F.array(*[F.col(n) / F.col("_total") for n in names]))
    return (
        state_rows.withColumn("_total", total)
        .select(F.col("id").alias(id_col), scores.alias("probabilities"))
        .withColumn("spread_label", F.when(F.col("probabilities").isNotNull(), label_at(F.col("probabilities"), scheme)))
    )
