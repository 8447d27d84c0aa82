"""Whitening of embeddings on the leading eigenvectors of their covariance.

Entries become integers (``floor(64 c) + 1000000``), so counts, sums and deviations are exact.
Covariances are centred before multiplying and added up per task; one matrix of the dimension's
square meets the driver, where spectrum slicing finds the leading eigenpairs (``spectrum.py``).
The whitened rows are written once; their own covariance is read from them.

Rows without a vector, or with a null or non-finite entry, are left out, and so are rows of
another length than the most frequent one (of equally frequent ones the longest). Entries beyond
``2**40`` in size after scaling count as that. A deviation that no long can hold is null. An
eigenvalue that is zero to rounding can't be whitened and gives no component, so equal vectors,
empty vectors and empty tables give no rows. Ids may be null or repeat: each row is its own.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from notewright.llm.spectrum import leading
from notewright.session import cut_lineage

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
_MOST = 1 << 40
_SAFE = 1 << 62


@dataclass(frozen=True)
class Fit:
    """Row count, per-dimension sums, eigenvalues, whitening matrix (a column a component) and trace."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    matrix: np.ndarray
    trace: float


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and integer entries ``x`` of the usable rows, written to the shared folder."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~bad)
    scaled = F.transform("v", lambda c: F.greatest(F.least(F.floor(c * SCALE).cast("long"), F.lit(_MOST)), F.lit(-_MOST)) + OFFSET)
    table = cut_lineage(rows.select("vec_id", scaled.alias("x")))
    usual = table.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return table.where(F.size("x") == (usual["length"] if usual else 0))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _batch_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Entries are below 2**41, so the sums of a batch fit a long.
        total = _matrix(batch.column(0), np.int64, width).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(total)], names=["cell", "n"])


def _products(batches: Iterator[pa.RecordBatch], centre) -> Iterator[pa.RecordBatch]:
    """Sums of products of the centred rows of a task, a row per cell of the matrix."""
    total = None
    for batch in batches:
        rows = centre(batch.column(0))
        total = rows.T @ rows if total is None else total + rows.T @ rows
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])


def covariance(rows: DataFrame, centre, count: int, width: int) -> np.ndarray:
    """Covariance, divisor ``count``, of the one array column of ``rows``, each batch centred by ``centre``."""
    cells = rows.mapInArrow(lambda batches: _products(batches, centre), "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    out = np.zeros(width * width)
    for row in cells.collect():  # the dimension's square
        out[row["cell"]] = row["s"] / count
    return out.reshape(width, width)


def _centred(column: pa.Array, count: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - S / n`` with a single rounding: the whole part of the mean is taken off in integers."""
    whole = np.array([s // count for s in sums], dtype=np.int64)
    rest = np.array([s % count / count for s in sums])
    return (_matrix(column, np.int64, len(sums)) - whole).astype(np.float64) - rest


def _deviations(column: pa.Array, count: int, sums: tuple[int, ...]) -> list[int | None]:
    """The exact sum over dimensions of ``(n x - S) ** 2``."""
    whole, rest = [s // count for s in sums], [s % count for s in sums]
    near = _matrix(column, np.int64, len(sums)) - np.array(whole, dtype=np.int64)
    if len(near) and (float(np.abs(near).max()) + 1) ** 2 * float(count) ** 2 * len(sums) < _SAFE:
        parts = near * count - np.array(rest, dtype=np.int64)
        return (parts * parts).sum(axis=1).tolist()
    exact = (sum((int(a) * count - r) ** 2 for a, r in zip(row, rest)) for row in near)
    return [n if n < 1 << 63 else None for n in exact]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading components of ``rows`` (column ``x``, a written table); none if there is nothing to fit."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    if not size["n"] or not size["width"]:
        return None
    count, width = size["n"], size["width"]
    found = rows.select("x").mapInArrow(lambda batches: _batch_sums(batches, width), "cell long, n long")
    found = found.groupBy("cell").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    sums = tuple(int(r["n"]) for r in sorted(found, key=lambda r: r["cell"]))
    table = covariance(rows.select("x"), lambda column: _centred(column, count, sums), count, width)
    values, vectors = leading(table, components)
    usable = values > np.finfo(np.float64).eps * width * max(values.max(initial=0.0), 0.0)
    values, vectors = values[usable], vectors[:, usable]
    return Fit(count, sums, values, vectors / np.sqrt(values), float(np.trace(table)))


def whitened(rows: DataFrame, model: Fit) -> DataFrame:
    """``vec_id``, ``deviation`` and the array ``whitened`` of every row, written to the shared folder."""
    count, sums, matrix = model.rows, model.sums, model.matrix

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _centred(batch.column(1), count, sums) @ matrix
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * matrix.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
            deviation = pa.array(_deviations(batch.column(1), count, sums), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    schema = StructType([rows.schema["vec_id"], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    return cut_lineage(rows.select("vec_id", "x").mapInArrow(project, schema))


def identity_error(table: DataFrame, count: int, width: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    means = table.select(*[(F.sum(F.col("whitened")[i]) / count).alias(f"m{i}") for i in range(width)]).first()
    centre = np.array(list(means))
    table = covariance(table.select("whitened"), lambda column: _matrix(column, np.float64, width) - centre, count, width)
    return float(np.abs(table - np.eye(width)).max())


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component, with the figures of the fit."""
    rows = integers(vectors)
    model = fit(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    table = whitened(rows, model)
    error = identity_error(table, model.rows, len(model.values))
    shares = F.array(*[F.lit(float(v)) for v in model.values / model.trace])
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.rows).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
