"""Mixing sources to target weights, cut exactly at each source's budget.

Rows get hash-random keys. Within each source the rows are taken in key order: whole
epochs first, then the rows below a cut key. The cut key is found by prefix sums of
word counts over key ranges, eight bits of the key at a time, so that no source is
ever sorted in one task. The row at the cut gives its first words; rows that are
equal in id and text share the cut evenly.

Null texts have size 0 and are never taken; null is a source of its own, after the
others. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import n_words, text_of, words
from notewright.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
_BITS = 8
_ROUNDS = 4


def mix_key(seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Narrow rows: ``doc_id``, ``source``, word count ``size`` and random key ``mix_key``."""
    return docs.select("doc_id", "source", n_words(text_of()).alias("size"), mix_key(seed).alias("mix_key"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: its size and target, filled by weight under a ceiling of twice its size.

    A source is at its ceiling if raising every source to that level by weight stays within
    the total. Both windows run over the sources alone.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("w", F.get(cycle, F.pmod(order - 1, F.lit(len(weights)))))
    per = per.withColumn("most", F.col("source_size") * MOST).withColumn("level", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_w", F.sum("w").over(everything))
    full = F.sum("most").over(upto) + F.col("level") * (F.col("all_w") - F.sum("w").over(upto)) <= F.col("total")
    per = per.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    left_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everything)
    rise = (F.col("total") - F.col("spent")) * F.col("w") / F.col("left_w")
    per = per.withColumn("spent", spent).withColumn("left_w", left_w)
    return per.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(rise).alias("target"),
    )


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: size, target, whole epochs, cut key and the words taken from a row at it.

    ``rows`` is a written table of ``sized`` rows; it is read once per eight bits of the key.
    """
    goal = targets(rows, weights, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long"))
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    goal = cut_lineage(goal.withColumn("rest", rest))
    front = goal.where("rest > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(1, _ROUNDS + 2):
        last = level > _ROUNDS
        bucket = F.col("mix_key") if last else F.shiftright("mix_key", 64 - _BITS * level)
        inside = F.lit(True) if level == 1 else F.shiftright("mix_key", 64 - _BITS * (level - 1)) == F.col("prefix")
        sums = (
            rows.where("size > 0")
            .join(front, F.col("source").eqNullSafe(F.col("s")) & inside)
            .groupBy("s", bucket.alias("b"))
            .agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"))
        )
        before = F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")
        hit = sums.withColumn("before", before).where("before < rest and rest <= before + n")
        front = cut_lineage(hit.select("s", F.col("b").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "rows"))
    last_cut = front.select("s", F.col("prefix").alias("cut_key"), F.floor(F.col("rest") / F.col("rows")).cast("long").alias("cut_words"))
    return goal.join(last_cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut_key", "cut_words"
    )


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``source``, ``size``, ``mix_key``) joined to their source's plan.

    ``part`` is the words taken beside the whole epochs, ``taken`` all words taken.
    """
    part = (
        F.when(F.col("mix_key") < F.col("cut_key"), F.col("size"))
        .when(F.col("mix_key") == F.col("cut_key"), F.col("cut_words"))
        .otherwise(F.lit(0))
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("mix_source")), "inner").drop("mix_source")
    return joined.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """The mix as rows of the columns of ``docs``: a row per epoch, and the cut row with its first words."""
    plan = cuts(cut_lineage(sized(docs, seed)), weights, share)
    work = docs.select(
        F.struct("*").alias("row"), "source", text_of().alias("t"), n_words(text_of()).alias("size"), mix_key(seed).alias("mix_key")
    )
    start = F.array_join(F.slice(words(F.col("t")), 1, F.col("part").cast("int")), " ")
    cut = (
        F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), F.array("t"))
        .when(F.col("part") > 0, F.array(start))
        .otherwise(F.array().cast("array<string>"))
    )
    epochs = F.when(F.col("size") > 0, F.array_repeat("t", F.col("epochs").cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = taken(work, plan).where("taken > 0").select("row", F.explode(F.concat(epochs, cut)).alias("t"))
    columns = []
    for name in docs.columns:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.col("t")
        elif name == "n_chars":
            column = F.length("t").cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return rows.select(*columns)
