"""Sharding by a k-d tree over metadata, with leaves of near equal bytes.

Each node is split at the weighted median of its widest dimension: size, id, source or
language, each scaled to 16 bits over the whole table. Ties are broken by a hash of id
and text, so equal texts spread over shards and no group is bound to one of them. A
median is found by counting bytes per digit of the key, thirteen bits at a time; only those
counts (at most 8192 per node) reach the driver.

Null texts have one byte; null ids, sources and languages take the lowest place of their
dimension. Rows equal in id and text stay together. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import text_of
from notewright.session import cut_lineage

_SCALE = 65535
_DIGIT = 13
_KEY_BITS = 52
ROWS_PER_BUCKET = 4000


def row_bytes(text: str = "text") -> Column:
    return (F.octet_length(text_of(text)) + 1).cast("long")


def _dimensions(size: Column) -> list[Column]:
    """The metadata of a row as numbers; names are placed by a hash."""
    return [
        F.log2(size.cast("double")),
        F.col("doc_id").cast("double"),
        F.pmod(F.xxhash64("source"), F.lit(_SCALE)).cast("double"),
        F.pmod(F.xxhash64("lang"), F.lit(_SCALE)).cast("double"),
    ]


def coordinates(docs: DataFrame) -> tuple[list[Column], DataFrame]:
    """The columns ``kd_*`` of a row as expressions over ``docs``, and their narrow written table."""
    size = row_bytes()
    raw = docs.select(
        "doc_id", size.alias("size"), F.crc32(text_of()).alias("text_crc32"), F.xxhash64("doc_id", text_of()).alias("kd_hash"),
        F.monotonically_increasing_id().alias("kd_row"), *[d.alias(f"d{i}") for i, d in enumerate(_dimensions(size))],
    )
    raw = cut_lineage(raw)
    count = len(_dimensions(size))
    ends = raw.agg(*[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(count) for f in (F.min, F.max)]).first()

    def place(value: Column, i: int) -> Column:
        low, high = ends[f"min{i}"], ends[f"max{i}"]
        if low is None or high == low:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((value - F.lit(low)) * F.lit(_SCALE) / F.lit(high - low)), F.lit(0)).cast("long")

    table = raw.select("doc_id", "size", "text_crc32", "kd_hash", "kd_row", *[place(F.col(f"d{i}"), i).alias(f"kd_{i}") for i in range(count)])
    exact = [F.xxhash64("doc_id", text_of()).alias("kd_hash")]
    exact += [place(d, i).alias(f"kd_{i}") for i, d in enumerate(_dimensions(size))]
    return exact, table


def _key(dimension: int) -> Column:
    """Place in the dimension, then 36 bits of hash."""
    return F.col(f"kd_{dimension}") * F.lit(1 << 36) + F.shiftrightunsigned("kd_hash", 28)


def _walk(splits: dict[int, Column], leaf: Callable[[int], Column], node: int = 0) -> Column:
    """The value that ``leaf`` gives for the leaf of a row; node n has children 2n + 1 and 2n + 2."""
    if node not in splits:
        return leaf(node)
    return F.when(splits[node], _walk(splits, leaf, 2 * node + 1)).otherwise(_walk(splits, leaf, 2 * node + 2))


def tree(rows: DataFrame, shards: int) -> Column:
    """The shard of a row as an expression on its ``kd_*`` columns; ``rows`` is read once per digit."""
    dims = [c for c in rows.columns if c.startswith("kd_") and c[3:].isdigit()]
    splits, spans = {}, {0: (0, shards)}
    while any(high - low > 1 for low, high in spans.values()):
        node = _walk(splits, F.lit)
        stats = rows.groupBy(node.alias("node")).agg(
            F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]
        ).collect()
        keys, goals = {}, {}
        for row in stats:
            low, high = spans[row["node"]]
            if high - low > 1:
                keys[row["node"]] = _key(max(range(len(dims)), key=lambda i: (row[dims[i]], -i)))
                goals[row["node"]] = row["bytes"] * ((high - low) // 2) / (high - low)
        if not keys:
            break
        nothing = F.lit(None).cast("long")
        key = _walk(splits, lambda n: keys.get(n, nothing))
        prefix, passed, last = dict.fromkeys(keys, 0), dict.fromkeys(keys, 0), {}
        for shift in range(_KEY_BITS - _DIGIT, -1, -_DIGIT):
            begun = _walk(splits, lambda n: F.lit(prefix[n]).cast("long") if n in prefix else nothing)
            counts = (
                rows.select(node.alias("node"), key.alias("key"), begun.alias("begun"), "size")
                .where(F.shiftright("key", shift + _DIGIT) == F.col("begun") if shift + _DIGIT < _KEY_BITS else F.col("key").isNotNull())
                .groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("bytes")).collect()
            )
            for n in keys:
                mine = sorted((r["digit"], r["bytes"]) for r in counts if r["node"] == n)
                for digit, size in mine:
                    if passed[n] + size >= goals[n] or digit == mine[-1][0]:
                        prefix[n], last[n] = digit, size
                        break
                    passed[n] += size
        grown = {}
        for n, (low, high) in spans.items():
            middle = low + (high - low) // 2
            if n in keys:
                # The rows at the median go to the side that comes out nearer to its share.
                nearer = goals[n] - passed[n] > passed[n] + last[n] - goals[n]
                splits[n] = keys[n] <= prefix[n] if nearer else keys[n] < prefix[n]
                grown[2 * n + 1], grown[2 * n + 2] = (low, middle), (middle, high)
            else:
                grown[n] = (low, low + 1)
        spans = grown
    return _walk(splits, lambda n: F.lit(spans[n][0])).cast("int")


def shard_count(rows: DataFrame, target_bytes: int) -> int:
    """Shards that bring the leaves of ``rows`` to ``target_bytes``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // target_bytes))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with ``shard``, ``kd_hash``, ``kd_row``) with gapless ``slot`` per shard.

    Rows are numbered inside hash buckets of some thousand rows, after the counts of the earlier buckets.
    """
    buckets = max(1, rows.count() // ROWS_PER_BUCKET // max(1, rows.select("shard").distinct().count()))
    rows = rows.withColumn("kd_bucket", F.pmod(F.xxhash64("kd_hash", "kd_row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "kd_bucket").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("kd_bucket")) - F.col("n")
    counts = counts.select("shard", "kd_bucket", start.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "kd_bucket").orderBy("kd_hash", "kd_row"))
    return rows.withColumn("place", place).join(counts, ["shard", "kd_bucket"]).withColumn(
        "slot", (F.col("start") + F.col("place") - 1).cast("long")
    ).drop("start", "place", "kd_bucket")


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with an int column ``shard``, found on the scan."""
    exact, table = coordinates(docs)
    rows = cut_lineage(table)
    work = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"], *exact)
    return work.withColumn("shard", tree(rows, shards)).drop("kd_hash", *[f"kd_{i}" for i in range(4)])
