"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as a benchmark item. Two bags of five-word
shingles of that size with a weighted similarity of s share at least 2s / (1 + s) of the
shingles of either, so only windows with that share of shingles known from items of their
size can match. The rightmost of the best windows for an item starts with a shingle of the
item, or else is the last window of the document: only those starts get a fingerprint. Their
fingerprints meet those of the items over five blocks of bits: with at most RADIUS differing
bits, some block differs in at most a fifth of them, and the items are stored under all block
values that near. Pairs within the radius are verified by the exact weighted Jaccard
similarity of their shingle bags.

Words are runs of letters and digits in lower case. Items and documents without a word never
match; a text of fewer than five words is one shingle, and a document shorter than an item is
one window. Null texts are empty. Rows with equal texts are searched once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import let, original, text_of, words
from notewright.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
_WIDTHS = (13, 13, 13, 13, 12)
# Two counters of 32 bits in one number.
_LANES = 1 << 32 | 1
WORD = r"[\p{L}\p{N}]+"
# Benchmark shingles up to this number are named in the filter of the scan, and sent to every
# executor (16 bytes each); more are joined by shuffle. The results are the same.
LISTED_SHINGLES = 100_000
BROADCAST_SHINGLES = 1_000_000


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text in order."""
    def hashes(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        one = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.lower(text), WORD), hashes)


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is set if it is in over half of them."""
    def bit(count: Column, b: int) -> Column:
        return F.when(2 * count > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    def two(b: int) -> Column:
        counts = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(_LANES)))
        return let(counts, lambda n: bit(n.bitwiseAND(F.lit((1 << 32) - 1)), b).bitwiseOR(bit(F.shiftright(n, 32), b + 32)))

    return reduce(lambda a, b: a.bitwiseOR(b), [two(b) for b in range(32)])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of hashes."""
    kinds = F.array_intersect(a, b)
    shared = F.aggregate(kinds, F.lit(0), lambda n, x: n + F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))
    ))
    return let(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def _blocks(fp: Column) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, sum(_WIDTHS[:i])).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
        for i, width in enumerate(_WIDTHS)
    ])


def _masks(width: int, radius: int) -> Column:
    """Errors of one block that a pair within ``radius`` must show in some block."""
    masks = [sum(1 << b for b in c) for k in range(radius // len(_WIDTHS) + 1) for c in combinations(range(width), k)]
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _enough(ratio: float) -> Column:
    return F.ceil(F.col("size") * ratio - 1e-9).cast("int")


def _full(enough: Column, within: Column | None = None) -> Column:
    """Those known places (sorted) from which a window holds ``enough`` of them."""
    return F.filter("places", lambda p, i: (F.get("places", i + enough - 1) < p + F.col("size")) & (F.lit(True) if within is None else p <= within))


def _items(benchmark: DataFrame) -> DataFrame:
    """Shingle bag, size and fingerprint of every item with a word, written to the shared folder."""
    bags = benchmark.select("item_id", _shingles(text_of()).alias("bag")).where(F.size("bag") > 0)
    return cut_lineage(bags.select("item_id", "bag", F.size("bag").alias("size"), simhash(F.col("bag")).alias("item_fp")))


def _possible(items: DataFrame, least: float) -> Column:
    """Whether the shingles ``bag`` of a text may hold a match: some stretch of the longest item's size has the known shingles of the shortest.

    The test needs nothing but the row, so texts that fail it go no further. Beyond LISTED_SHINGLES every text may.
    """
    sizes = items.agg(F.min(_enough(least)).alias("enough"), F.max("size").alias("longest")).first()
    if sizes["longest"] is None:
        return F.lit(False)
    known = items.select(F.explode("bag").alias("h")).distinct()
    if known.count() > LISTED_SHINGLES:
        return F.lit(True)
    listed = ",".join(f"{r['h']}L" for r in known.collect())
    places = F.expr(f"filter(transform(bag, (h, i) -> if(h in ({listed}), i, -1)), i -> i >= 0)")
    enough, longest = sizes["enough"], sizes["longest"]
    return let(places, lambda found: F.exists(
        F.transform(found, lambda p, i: F.coalesce(F.get(found, i + enough - 1) < p + longest, F.lit(False))), lambda near: near
    ))


def _texts(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``md5`` and shingle ``bag`` of every distinct text that may hold a match; copies are told apart by narrow rows."""
    rows = docs.select(F.md5(text_of()).alias("md5"), _shingles(text_of()).alias("bag")).where(_possible(items, least))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy("md5").agg(F.min("row").alias("row")).select("row")
    return cut_lineage(rows.join(first, "row", "left_semi").drop("row"))


def _known(texts: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Per text and item size the ``places`` of shingles known from items of that size, if some window holds enough."""
    known = cut_lineage(items.select(F.explode("bag").alias("h"), "size").groupBy("h").agg(F.collect_set("size").alias("sizes")))
    places = texts.select("md5", F.posexplode("bag").alias("at", "h"))
    side = F.broadcast(known) if known.count() <= BROADCAST_SHINGLES else known
    hits = places.join(side, "h").select("md5", "at", F.explode("sizes").alias("size"))
    grouped = hits.groupBy("md5", "size").agg(F.sort_array(F.collect_set("at")).alias("places"))
    return grouped.where(F.size(_full(_enough(least))) > 0)


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """``md5`` of a text, ``item_id``, ``similarity`` and ``start`` (shingle place) of its best window per item (rows of ``_items``)."""
    texts = _texts(docs, items, least)
    by_size = cut_lineage(_known(texts, items, least))
    last = F.greatest(F.lit(0), F.size("bag") - F.col("size"))
    enough = F.when(F.size("bag") < F.col("size"), _enough(least)).otherwise(_enough(2 * least / (1 + least)))
    at_end = F.when(F.size(F.filter("places", lambda p: p >= F.col("last"))) >= F.col("enough"), F.array("last")).otherwise(F.array().cast("array<int>"))
    work = texts.join(by_size, "md5").withColumn("last", last).withColumn("enough", enough)
    starts = F.array_union(_full(F.col("enough"), F.col("last")), at_end)
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("bag", s + 1, F.col("size")).alias("window")))
    windows = work.select("md5", "size", F.explode(cut).alias("w")).select("md5", "size", "w.start", "w.window")
    windows = cut_lineage(windows.withColumn("fp", simhash(F.col("window"))))
    stored = items.withColumn("b", F.explode(_blocks(F.col("item_fp"))))
    masks = F.when(F.col("b")["block"] < len(_WIDTHS) - 1, _masks(_WIDTHS[0], radius)).otherwise(_masks(_WIDTHS[-1], radius))
    stored = stored.withColumn("mask", F.explode(masks)).select(
        "item_id", "size", "item_fp", F.col("b")["block"].alias("block"), F.col("b")["value"].bitwiseXOR(F.col("mask")).alias("value")
    )
    probes = windows.select("md5", "size", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select(
        "md5", "size", "start", "fp", F.col("b")["block"].alias("block"), F.col("b")["value"].alias("value")
    )
    near = probes.join(stored, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("md5", "size", "start", "item_id").distinct()
    scored = (
        near.join(windows.select("md5", "size", "start", "window"), ["md5", "size", "start"])
        .join(items.select("item_id", "bag"), "item_id")
        .select("md5", "item_id", similarity(F.col("window"), F.col("bag")).alias("similarity"), "start")
    )
    best = scored.where(F.col("similarity") >= least).groupBy("md5", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    )
    return best.select("md5", "item_id", F.col("best")["similarity"].alias("similarity"), (-F.col("best")["back"]).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` and ``start`` for every row that holds a passage of an item."""
    found = cut_lineage(matches(docs, _items(benchmark), radius))
    return docs.select("doc_id", F.md5(text_of()).alias("md5")).join(found, "md5").drop("md5")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a passage of an item, with their own columns.

    Only rows that may hold a match meet the matches; all others stay where they are.
    """
    items = _items(benchmark)
    found = cut_lineage(matches(docs, items).select(F.col("md5").alias("found")).distinct())
    rows = docs.select(F.struct("*").alias("whole"), F.md5(text_of()).alias("md5"), _shingles(text_of()).alias("bag"))
    rows = rows.withColumn("possible", _possible(items, SIMILARITY)).drop("bag")
    met = rows.where("possible").join(found, F.col("md5") == F.col("found"), "left_anti")
    return original(rows.where("not possible").unionByName(met).select("whole.*"), docs.columns)
