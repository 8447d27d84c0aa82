"""Exact nearest neighbours with a pivot index, for stores too large to send around.

Store rows belong to the nearest of some pivots and, within it, to a ring of angles around it; a
cluster (pivot and ring) keeps the least and the widest angle of its members. By the triangle
inequality of angles no member is nearer to a query than the query's angle to the pivot is from
that range. Each query first meets the clusters with the best bounds until they hold k rows,
which gives a score to beat; then only those clusters are met whose bound can still reach it.
All other clusters are never compared, and no hit is lost: bounds allow for rounding, so that
rows tied with the k-th score are met too.

Clusters are packed into blocks of a bounded number of rows, and a query travels once to each block
that holds clusters it has to meet, so it never travels more often than there are blocks. Blocks
meet their queries in tasks of a bounded number of rows on either side, so neither copies of one
vector nor a cluster that many queries want can overload a task. Where blocks are asked to be small,
as many of them travel together as leave enough tasks for the cores and fit one: what is shuffled is
the number of such bundles times the rows, not a row for each pair of small blocks. A task keeps the
k best rows of a query over all clusters that it meets there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.session import cut_lineage

# The number of pivots grows with the square root of the store. They are chosen one by one as the
# row farthest from all chosen ones, of a sample of SAMPLE rows a pivot with the least hashes of their ids.
MAX_PIVOTS = 512
SAMPLE = 16
RINGS = 8
# Bounds give way by this much for rounding; scores are compared at nine decimals.
MARGIN = 1e-7
# Queries compared with all pivots at once.
_ROWS = 1024
# Vectors of one side that a task may take, if larger blocks are not asked for.
TASK_BYTES = 64 << 20
# Either side is cut into so many bundles, or more where the cores need more tasks.
SPLITS = 8


@dataclass(frozen=True)
class Index:
    """Assigned store rows (``cluster``, ``neighbour_id``, ``v``, a written table) and, per cluster, angles and rows.

    Cluster ``RINGS * p + r`` is ring ``r`` of pivot ``p``. The last cluster holds the vectors of
    length zero, which are equally far from everything; of them only the k smallest ids can be hits.
    """

    rows: DataFrame
    pivots: np.ndarray
    least: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray
    # The block of each cluster, small blocks bundled, and how many parts each block is cut into.
    block: np.ndarray
    parts: np.ndarray


def unit_rows(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as the rows of a matrix, scaled to length one."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors)
    if len(vectors) and pc.any(pc.not_equal(lengths, dim)).as_py():
        raise ValueError(f"a vector does not have {dim} entries")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _spread_out(sample: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` rows of ``sample``, each the farthest from those before it."""
    if not len(sample):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < number and nearest.min() < 1 - MARGIN:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _packed(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring clusters put together up to ``block_rows`` rows; a larger one is a block of several parts."""
    block, parts, held = np.zeros(len(sizes), dtype=np.int32), [], block_rows
    for cluster, size in enumerate(sizes.tolist()):
        if held + size > block_rows:
            parts.append(max(1, -(-size // block_rows)))
            held = 0
        held += size
        block[cluster] = len(parts) - 1
    return block, np.array(parts, dtype=np.int64)


def _bundle_rows(spark: SparkSession, rows: int, dim: int, block_rows: int) -> int:
    """How many rows of one side travel together: a block's, or those of more blocks as long as they fit a task and leave enough tasks."""
    splits = max(SPLITS, math.isqrt(4 * spark.sparkContext.defaultParallelism))
    return max(block_rows, min(TASK_BYTES // (8 * dim), -(-rows // splits)), 1)


def build(known: DataFrame, rows: int, dim: int, k: int, block_rows: int, most: int = MAX_PIVOTS) -> Index:
    """The index of ``known`` (``neighbour_id``, ``v``), which has ``rows`` rows of ``dim`` entries."""
    number = max(1, min(most, math.isqrt(rows)))
    chosen = known.orderBy(F.xxhash64(F.col("neighbour_id").cast("string")), "neighbour_id").limit(SAMPLE * number).select("v").toArrow()
    sample = unit_rows(chosen.column("v"), dim)
    pivots = _spread_out(sample[np.abs(sample).sum(axis=1) > 0], number)
    last = RINGS * len(pivots)
    shared = known.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                units = unit_rows(part.column(1), dim)
                cosines = units @ shared.value.T
                angle = _angle(cosines.max(axis=1))
                ring = np.minimum((angle * (2 * RINGS / math.pi)).astype(np.int64), RINGS - 1)
                cluster = np.where(np.abs(units).sum(axis=1) > 0, RINGS * cosines.argmax(axis=1) + ring, last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cluster.astype(np.int32)), pa.array(angle), *part.columns], names=["cluster", "angle", "neighbour_id", "v"]
                )

    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType()), *known.schema.fields])
    placed = cut_lineage(known.mapInArrow(assign, schema))
    zeros = cut_lineage(placed.filter(F.col("cluster") == last).orderBy("neighbour_id").limit(k))
    placed = placed.filter(F.col("cluster") < last)
    least, widest, sizes = np.zeros(last + 1), np.zeros(last + 1), np.zeros(last + 1, dtype=np.int64)
    ends = placed.groupBy("cluster").agg(F.min("angle").alias("least"), F.max("angle").alias("widest"), F.count("*").alias("n"))
    for row in ends.collect():  # a row a cluster
        at = row["cluster"]
        least[at], widest[at], sizes[at] = row["least"], row["widest"], row["n"]
    sizes[-1] = zeros.count()
    bundle = _bundle_rows(known.sparkSession, rows, dim, block_rows)
    return Index(placed.unionByName(zeros).drop("angle"), pivots, least, widest, sizes, *_packed(sizes, bundle))


def bounds(units: np.ndarray, pivots: np.ndarray, least: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Per query and cluster a score that no member exceeds; 0 for vectors of length zero on either side."""
    angle = np.repeat(_angle(units @ pivots.T), RINGS, axis=1)
    apart = np.maximum(np.maximum(angle - widest[:-1], least[:-1] - angle), 0.0)
    best = np.hstack([np.cos(apart), np.zeros((len(units), 1))])
    best[np.abs(units).sum(axis=1) == 0] = 0.0
    return best


def _first_clusters(score: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which clusters each query meets first: the best by bound, then by size, until they hold ``k`` rows."""
    order = np.argsort(-score, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    met = np.zeros(score.shape, dtype=bool)
    np.put_along_axis(met, order, (before < k) & (sizes[order] > 0), axis=1)
    return met


def _probes(asked: DataFrame, index: Index, dim: int, k: int, beat: bool) -> DataFrame:
    """A row per query row and block to meet there: the first ones, or with ``beat`` those that can still reach ``least``.

    ``met`` holds the clusters of the block to meet as bits, from the block's first cluster on.
    """
    shared = asked.sparkSession.sparkContext.broadcast((index.pivots, index.least, index.widest, index.sizes, index.block))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, least_angle, widest, sizes, block = shared.value
        # Clusters of a block are neighbours.
        ends = np.searchsorted(block, np.arange(block[-1] + 2))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                score = bounds(unit_rows(part.column("v"), dim), pivots, least_angle, widest)
                met = _first_clusters(score, sizes, k)
                if beat:
                    least = part.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
                    met = (score >= least[:, None] - MARGIN) & (sizes > 0) & ~met
                for at, (left, right) in enumerate(zip(ends[:-1], ends[1:])):
                    who = np.flatnonzero(met[:, left:right].any(axis=1))
                    if not len(who):
                        continue
                    bits = np.packbits(met[who, left:right], axis=1)
                    found = part.select(["row", "query_id", "v"]).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), at, dtype=np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), *found.columns],
                        names=["block", "met", "row", "query_id", "v"],
                    )

    fields = {f.name: f for f in asked.schema.fields}
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("met", T.BinaryType()), *[fields[n] for n in ("row", "query_id", "v")]])
    return cut_lineage(asked.mapInArrow(choose, schema))


def _bits(met: pa.ChunkedArray) -> np.ndarray:
    """The bytes of ``met`` as a matrix with a row per query."""
    return np.frombuffer(b"".join(met.to_pylist()), dtype=np.uint8).reshape(len(met), -1)


def _with_clusters(probes: DataFrame, index: Index) -> DataFrame:
    """Probes as ``block``, ``row`` and the list of ``clusters`` met."""
    block = index.block

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, bits in zip(batch.column("block").to_pylist(), batch.column("met").to_pylist()):
                left, right = np.searchsorted(block, (at, at + 1))
                found.append((left + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=right - left))).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("row"), pa.array(found, pa.list_(pa.int32()))], names=["block", "row", "clusters"]
            )

    return probes.select("block", "row", "met").mapInArrow(listed, "block int, row long, clusters array<int>")


def _listed(values: Sequence[int], at: str) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(at))


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))


def _meet(probes: DataFrame, index: Index, dim: int, block_rows: int, hits, schema: T.StructType) -> DataFrame:
    """The best k of each block part that a probe meets; blocks and their probes meet in tasks of a bounded number of rows a side."""
    wanted = np.zeros(len(index.parts), dtype=np.int64)
    # One row a block.
    for row in probes.groupBy("block").agg(F.count("*").alias("n")).collect():
        wanted[row["block"]] = row["n"]
    spark = probes.sparkSession
    query_parts = -(-wanted // _bundle_rows(spark, int(wanted.max()), dim, block_rows))
    placed = index.rows.withColumn("block", _listed(index.block, "cluster").cast("int"))
    # The input partition is hashed too, so that rows repeating one id spread over parts.
    right = placed.filter(_listed(wanted, "block") > 0).withColumn(
        "sb", F.pmod(F.xxhash64("neighbour_id", F.spark_partition_id()), _listed(index.parts, "block"))
    ).withColumn("qb", _every(_listed(query_parts, "block")))
    left = probes.withColumn("qb", F.pmod(F.xxhash64("row"), _listed(query_parts, "block"))).withColumn("sb", _every(_listed(index.parts, "block")))
    tasks = int((index.parts * query_parts).sum())
    parts = max(1, min(tasks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    keys = ["block", "qb", "sb"]
    left, right = (side.repartition(parts, *keys) for side in (left, right))
    block = index.block

    def meet(queries: pa.Table, store: pa.Table) -> pa.Table:
        store = store.take(pc.sort_indices(store, sort_keys=[("neighbour_id", "ascending")]))
        if not len(queries) or not len(store):
            return hits(queries.slice(0, 0), store.slice(0, 0), [])
        held = store.column("cluster").to_numpy() - np.searchsorted(block, queries.column("block")[0].as_py())
        met = _bits(queries.column("met"))
        order = np.argsort(held, kind="stable")
        clusters, starts = np.unique(held[order], return_index=True)
        # Per cluster, the places of its queries and of its rows.
        pairs = ((np.flatnonzero(met[:, c >> 3] & (128 >> (c & 7))), rows) for c, rows in zip(clusters.tolist(), np.split(order, starts[1:])))
        return hits(queries, store, pairs)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def search(asked: DataFrame, index: Index, dim: int, k: int, block_rows: int, hits, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Candidate hits of every row of ``asked`` (``row``, ``query_id``, ``v``), and the probes made.

    ``hits`` compares a table of probes with a table of store rows, in pairs of places on either side,
    and gives rows of ``schema`` with the k best of each probe: ``row``, ``cosine`` and what else the
    caller needs.
    """
    first = _probes(asked, index, dim, k, beat=False)
    found = cut_lineage(_meet(first, index, dim, block_rows, hits, schema))
    by_score = Window.partitionBy("row").orderBy(F.desc("cosine"))
    kth = found.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k)
    kth = kth.select("row", F.col("cosine").alias("least"))
    second = _probes(asked.join(kth, "row", "left"), index, dim, k, beat=True)
    more = _meet(second, index, dim, block_rows, hits, schema)
    return found.unionByName(more), _with_clusters(first.unionByName(second), index)
