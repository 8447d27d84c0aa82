"""Selection by rank without a sort: 64-bit keys are counted by 16 bits, from the highest down.

Each round counts the rows that agree with a wanted key so far by their next 16 bits, so a
round ships at most 65536 counts a wanted rank, whatever the distribution, and four rounds
name the exact key; two do where keys are spread evenly. Nothing is ranked or gathered, and equal keys cost no more than one.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_BITS = 16
_LOWEST = -(1 << 63)
_ALL = (1 << 64) - 1
# Rows around the wanted keys that are counted by whole keys at once.
_FEW = 1 << 16


@dataclass(frozen=True)
class Place:
    """A key, how many rows come before it, and how many hold it."""

    key: int
    before: int
    rows: int


@F.pandas_udf(LongType())
def double_key(values: pd.Series) -> pd.Series:
    """Doubles as longs in the same order; both zeros are one key, null and NaN give null."""
    number = values.to_numpy(dtype=np.float64, na_value=np.nan) + 0.0
    bits = number.view(np.int64)
    keys = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
    return pd.Series(pd.array(keys, dtype="Int64")).mask(values.isna().to_numpy())


def key_double(key: int) -> float:
    """The double of a key."""
    bits = np.int64(key) if key >= 0 else np.int64(key) ^ np.int64((1 << 63) - 1)
    return float(bits.view(np.float64))


def _signed(number: int) -> int:
    """The long whose bits, sign flipped, are ``number``."""
    return number - (1 << 63)


def at_ranks(
    rows: DataFrame, ranks: Mapping[Hashable, Sequence[int]], group: str = "group", key: str = "key"
) -> dict[tuple[Hashable, int], Place]:
    """The key at each wanted rank (from 1, in ascending order) of each listed group.

    ``rows`` is read once per 16 bits, so it should be a written or cheap table. Rows of other
    groups or with a null key take no part. A rank beyond its group's rows raises ValueError.
    """
    # Per wanted rank: the known high bits of its key, rows before them, rows with them, rank among these.
    targets = {(g, r): (0, 0, 0, r) for g, wanted in ranks.items() for r in wanted}
    if not targets:
        return {}
    # Flipping the sign makes the order of the bits the order of the numbers.
    ordered = F.col(key).bitwiseXOR(F.lit(_LOWEST))
    counted = rows.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), ordered.alias("k"))
    known = 64
    while known:
        # Few rows left are counted by their whole keys at once.
        few = known < 64 and sum({(g, p): n for (g, _), (p, _, n, _) in targets.items()}.values()) <= _FEW
        shift = 0 if few else known - _BITS
        conditions = []
        for g in {g for g, _ in targets}:
            own = F.col("g") == F.lit(g)
            prefixes = {p for (h, _), (p, _, _, _) in targets.items() if h == g}
            conditions.append(own if known == 64 else own & F.shiftrightunsigned("k", known).isin(*prefixes))
        inside = counted.where(reduce(lambda a, b: a | b, conditions))
        counts = inside.groupBy("g", F.shiftrightunsigned("k", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        per: dict[tuple, list[tuple[int, int]]] = {}
        for row in counts:
            number = row["p"] & _ALL
            per.setdefault((row["g"], number >> (known - shift)), []).append((number, row["n"]))
        per = {at: sorted(found) for at, found in per.items()}
        for target, (prefix, before, _, left) in targets.items():
            for number, n in per.get((target[0], prefix), []):
                if left <= n:
                    break
                left, before = left - n, before + n
            else:
                raise ValueError(f"rank {target[1]} exceeds the rows of {target[0]!r}")
            targets[target] = (number, before, n, left)
        known = shift
    return {at: Place(_signed(number), before, n) for at, (number, before, n, _) in targets.items()}
