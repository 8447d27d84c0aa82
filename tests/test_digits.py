"""Ranks found by digits against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from notewright.operators.digits import at_ranks, double_key, key_double


def test_keys_at_ranks(spark):
    rng = random.Random(7)
    rows = [("a", rng.choice([rng.getrandbits(64) - (1 << 63), rng.randrange(-3, 3), (1 << 63) - 1, -(1 << 63)])) for _ in range(800)]
    rows += [("b", 5)] * 300 + [("b", -1), ("c", 9), (None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "group string, key long")
    ordered = {g: sorted(k for h, k in rows if h == g and k is not None) for g in ("a", "b")}
    wanted = {"a": [1, 2, 399, 400, len(ordered["a"])], "b": [1, 2, 301]}
    found = at_ranks(df, wanted)
    assert set(found) == {(g, r) for g, ranks in wanted.items() for r in ranks}
    for (g, r), place in found.items():
        key = ordered[g][r - 1]
        assert (place.key, place.before, place.rows) == (key, sum(k < key for k in ordered[g]), ordered[g].count(key))


def test_a_rank_beyond_the_group_is_an_error(spark):
    df = spark.createDataFrame([("a", 1)], "group string, key long")
    assert at_ranks(df, {}) == {}
    for wanted in ({"a": [2]}, {"b": [1]}):
        with pytest.raises(ValueError):
            at_ranks(df, wanted)


def test_doubles_keep_their_order_as_keys(spark):
    values = [-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 0.1, 0.99999999, 1.0, 1e300, math.inf]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").withColumn("k", double_key("v"))
    keys = {r["v"]: r["k"] for r in df.collect()}
    assert keys.pop(None) is None
    assert [k for _, k in sorted(keys.items())] == sorted(keys.values())
    assert keys[-0.0] == keys[0.0]
    assert [key_double(keys[v]) for v in values] == values
    assert df.where(F.col("k").isNull()).count() == 1
