"""Exact top-k cosine neighbours, for all queries at once.

Vectors are compared block against block with a matrix product, and only the k
best per query leave a block. A store below a checked size is one block that is
broadcast, so queries are scored where they are and nothing is shuffled. Larger
stores get a pivot index (``pivots.py``), by which a query meets only the clusters
that may hold one of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as fv
from notewright.functions.labels import clean_flag
from notewright.functions.vectors import similarity_score
from notewright.operators import pivots
from notewright.operators.pivots import unit_rows
from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, TEXT, LabelScheme
from notewright.session import cut_lineage

# A store whose vectors take up to this many bytes is broadcast.
BROADCAST_BYTES = 64 << 20
# Beyond that, clusters and the queries that meet them are cut into blocks of at most
# about this size; two of them must fit a task. Smaller blocks travel and meet in bundles (``pivots.TASK_BYTES``).
BLOCK_BYTES = 512 << 20
# Cosines are compared at nine decimals, so ranks do not depend on the block layout.
_SCALE = 1_000_000_000
_PLACE_BITS = 30
# Queries and store rows multiplied at once, small enough for a core's cache.
_ROWS = 256
_COLUMNS = 1024
_LAST_PLACE = (1 << _PLACE_BITS) - 1
# Below every key: the place of a hit that there is none for.
_NONE = -(1 << 62)


def _best(queries: np.ndarray, store: np.ndarray, k: int) -> np.ndarray:
    """The k best store rows of each query as keys, best first; ``store`` must be in id order.

    A key holds the rounded cosine and, below it, the place counted from the
    end, so equal cosines fall to the smaller id. The store is taken in slices:
    after the first ones only cells above a query's k-th cosine are looked at,
    and a later copy of a kept row never is.
    """
    keep = min(k, len(store))
    best = np.empty((len(queries), keep), dtype=np.int64)
    for start in range(0, len(queries), _ROWS):
        part = queries[start:start + _ROWS] * _SCALE
        top = np.empty((len(part), 0), dtype=np.int64)
        for left in range(0, len(store), _COLUMNS):
            cells = part @ store[left:left + _COLUMNS].T
            if top.shape[1] < keep:
                places = _LAST_PLACE - left - np.arange(cells.shape[1])
                keys = (np.rint(cells).astype(np.int64) << _PLACE_BITS) | places
                top = -np.sort(-np.concatenate([top, keys], axis=1), axis=1)[:, :keep]
                continue
            floor = top[:, -1] >> _PLACE_BITS
            row, column = np.nonzero(cells >= floor[:, None] + 0.5)
            cosine = np.rint(cells[row, column]).astype(np.int64)
            above = cosine > floor[row]
            if above.any():
                keys = (cosine[above] << _PLACE_BITS) | (_LAST_PLACE - left - column[above])
                top = _merge(top, row[above], keys)
        best[start:start + _ROWS] = top
    return best


def _merge(top: np.ndarray, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Put more keys of some rows among the kept ones and keep as many as before."""
    size, keep = top.shape
    rows = np.concatenate([np.repeat(np.arange(size), keep), row])
    together = np.concatenate([top.ravel(), keys])
    order = np.lexsort((-together, rows))
    starts = np.searchsorted(rows[order], np.arange(size))
    return together[order][starts[:, None] + np.arange(keep)]


def _best_of_pairs(queries: np.ndarray, store: np.ndarray, k: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """As ``_best``, but a query meets only the store rows paired with it; ``_NONE`` where there are fewer than k.

    A pair names places of queries and, in rising order, of store rows; no two pairs share both.
    """
    best = np.full((len(queries), min(k, len(store))), _NONE, dtype=np.int64)
    for who, rows in pairs:
        if len(who):
            keys = _best(queries[who], store[rows], k)
            keys = (keys >> _PLACE_BITS << _PLACE_BITS) | (_LAST_PLACE - rows[_LAST_PLACE - (keys & _LAST_PLACE)])
            best[who] = -np.sort(-np.concatenate([best[who], keys], axis=1), axis=1)[:, :best.shape[1]]
    return best


def _hits(query_ids: list[pa.Array], best: np.ndarray, store_ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    """Keys of the best store rows of each query as rows: columns that name the query, then neighbour_id, cosine and rank."""
    row, rank = np.nonzero(best != _NONE)
    keys = best[row, rank]
    each = pa.array(row)
    return pa.record_batch(
        [
            *[ids.take(each) for ids in query_ids],
            store_ids.take(pa.array(_LAST_PLACE - (keys & _LAST_PLACE))),
            pa.array((keys >> _PLACE_BITS) / _SCALE),
            pa.array((rank + 1).astype(np.int32)),
        ],
        names=[*names, "neighbour_id", "cosine", "rank"],
    )


def top_k_cosine(
    queries: DataFrame,
    store: DataFrame,
    k: int = fv.TOP_K,
    query_id: str = ID,
    store_id: str = ID,
    vector: str = EMBEDDING,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, neighbour_id, cosine, rank) of each query's k nearest store rows.

    Ranks go by descending cosine, then id. Rows without a vector take no part.
    Each query row has its own neighbours, whatever ids repeat.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    known = store.filter(F.col(vector).isNotNull()).select(F.col(store_id).alias("neighbour_id"), F.col(vector).alias("v"))
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField("neighbour_id", known.schema["neighbour_id"].dataType),
        T.StructField("cosine", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    name_bytes = F.coalesce(F.sum(F.length(F.col("neighbour_id").cast("string"))), F.lit(0))
    size = known.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("low"), name_bytes.alias("names")
    ).first()
    if size.n == 0:
        return queries.sparkSession.createDataFrame([], schema)
    if size.dim != size.low:
        raise ValueError(f"vectors differ in length: {size.low} to {size.dim}")
    dim = size.dim
    if size.n * dim * 8 + size.names <= broadcast_bytes:
        table = known.orderBy("neighbour_id").toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(
            (table.column("neighbour_id").combine_chunks(), unit_rows(table.column("v"), dim))
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units = shared.value
            for batch in batches:
                yield _hits([batch.column(0)], _best(unit_rows(batch.column(1), dim), units, k), ids, ["query_id"])

        # Each query has met the whole store here, so its ranks are final.
        return asked.mapInArrow(scan, schema)

    found, _ = _indexed_search(asked, known, size.n, dim, k, max(1, block_bytes // (8 * dim)), schema)
    # Query rows are ranked one by one, as in the scan, also if they share an id.
    by_score = Window.partitionBy("row").orderBy(F.desc("cosine"), "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "neighbour_id", "cosine", "rank")


def _indexed_search(
    asked: DataFrame, known: DataFrame, rows: int, dim: int, k: int, block_rows: int, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Candidates by query ``row`` from a pivot index of ``known``, and the probes made.

    Query rows are numbered and written first, so that a row keeps its number if its task is run again.
    """
    asked = cut_lineage(asked.withColumn("row", F.monotonically_increasing_id()))
    keyed = T.StructType([T.StructField("row", T.LongType()), *schema.fields])

    def hits(probes: pa.Table, store: pa.Table, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        names = ["row", "query_id"]
        best = _best_of_pairs(unit_rows(probes.column("v"), dim), unit_rows(store.column("v"), dim), k, pairs)
        found = _hits([probes.column(n).combine_chunks() for n in names], best, store.column("neighbour_id").combine_chunks(), names)
        return pa.Table.from_batches([found])

    return pivots.search(asked, pivots.build(known, rows, dim, k, block_rows), dim, k, block_rows, hits, keyed)


def similarity_search(
    queries: DataFrame,
    store: DataFrame,
    k: int = fv.TOP_K,
    scheme: LabelScheme = SCHEME,
    query_id: str = ID,
    store_id: str = ID,
    vector: str = EMBEDDING,
) -> DataFrame:
    """The k most similar stored cases of every query, best first, with their text and labels.

    Missing metadata takes its default. Scores lie in [0, 1].
    """
    hits = top_k_cosine(queries, store, k, query_id, store_id, vector)
    cases = store.select(
        F.col(store_id).alias("neighbour_id"),
        F.col(TEXT),
        F.coalesce(clean_flag(F.col(scheme.flag_a)), F.lit(fv.DEFAULT_CASE["flag"])).alias(scheme.flag_a),
        F.coalesce(clean_flag(F.col(scheme.flag_b)), F.lit(fv.DEFAULT_CASE["flag"])).alias(scheme.flag_b),
        F.coalesce(F.col(LABEL), F.lit(fv.DEFAULT_CASE["label"])).alias(LABEL),
    )
    return hits.join(cases, "neighbour_id").select(
        "query_id",
        "rank",
        F.coalesce(F.col("neighbour_id").cast("string"), F.lit(fv.DEFAULT_CASE["id"])).alias("patient_id"),
        TEXT, scheme.flag_a, scheme.flag_b, LABEL,
        similarity_score(F.col("cosine")).alias("similarity_score"),
    )


def gather_cases(hits: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    """One row per query with its cases as an array, best first; k bounds the array."""
    case = F.struct("rank", "similarity_score", LABEL, scheme.flag_a, scheme.flag_b, TEXT, "patient_id")
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(case)).alias("cases"))


def retrieved_label_tally(hits: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    """How many of a query's retrieved cases carry each flag."""
    return hits.groupBy("query_id").agg(
        F.count_if(F.col(scheme.flag_a) == 1.0).alias("n_flag_a"),
        F.count_if(F.col(scheme.flag_b) == 1.0).alias("n_flag_b"),
        F.count("*").alias("n_cases"),
    )
