"""Exact order statistics that never gather or rank a group's values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.operators.digits import at_ranks, double_key, key_double
from notewright.session import cut_lineage


def exact_quantile(df: DataFrame, by: str, groups: Sequence, value: str, p: float = 0.5) -> DataFrame:
    """The linearly interpolated quantile of ``value`` per listed group, as column ``quantile``.

    Values become longs in the same order, written once, and the two order statistics around
    the quantile are found by counting their digits. The cost is the same for any distribution
    and any number of equal values. Null and NaN take no part; a group without values has no row.
    """
    keyed = df.filter(F.col(by).isin(*groups)).select(F.col(by).alias("group"), double_key(F.col(value).cast("double")).alias("key"))
    keyed = cut_lineage(keyed.filter(F.col("key").isNotNull()))
    positions = {r["group"]: (r["n"] - 1) * p for r in keyed.groupBy("group").agg(F.count("*").alias("n")).collect()}
    ranks = {g: sorted({math.floor(at) + 1, math.ceil(at) + 1}) for g, at in positions.items()}
    found = at_ranks(keyed, ranks)
    rows = []
    for g, at in positions.items():
        low, high = (key_double(found[g, r + 1].key) for r in (math.floor(at), math.ceil(at)))
        rows.append((g, low if low == high else low + (at - math.floor(at)) * (high - low)))
    kind = df.schema[by].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{by}` {kind}, quantile double")
