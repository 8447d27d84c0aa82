"""Exact, seed-keyed splitting and sampling.

Every row has the sort key ``(md5(seed:id), id)``. To hold out the first ``n``
rows of a class in that order nothing is sorted or ranked: the key at the quota is
found digit by digit from counts (``digits.py``) and becomes the class's cut key.
What is left of the split is a comparison of each row with one constant per listed
class, so the table itself is neither shuffled nor joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators.digits import Place, at_ranks
from notewright.operators.select import is_labelled, is_official_test, union_phases
from notewright.schema import ID, LABEL, SCHEME, LabelScheme
from notewright.session import cut_lineage

SPLIT = "split"
TRAIN, VALIDATION, TEST, UNLABELLED = "train", "validation", "test", "unlabelled"

Quotas = Callable[[Mapping[str, int]], Mapping[str, int]]


def order_key(seed: int, id_col: str = ID) -> Column:
    """A uniform, reproducible sort key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def _held_out(
    df: DataFrame, within: Column, labels: Sequence[str], quotas: Quotas, seed: int, id_col: str, label_col: str
) -> Column:
    """True for the first rows of each class among ``within``, as many as its quota.

    ``quotas`` maps rows per class to rows wanted. The column is false for other
    rows of a class with a quota and NULL for all others.
    """
    keyed = cut_lineage(df.filter(within & F.col(label_col).isin(*labels)).select(
        F.col(label_col).alias("group"), F.col(id_col).alias("id"), _first_bits(order_key(seed, id_col)).alias("key")
    ))
    totals = {row["group"]: row["n"] for row in keyed.groupBy("group").agg(F.count("*").alias("n")).collect()}
    wanted = dict(quotas(totals))
    for label, quota in wanted.items():
        if quota > totals[label]:
            raise ValueError(f"a quota of {quota} exceeds the {totals[label]} rows of {label}")
    places = {label: place for (label, _), place in at_ranks(keyed, {k: [n] for k, n in wanted.items() if n > 0}).items()}
    cuts = _cut_ids(keyed, places, wanted, seed) if places else {}

    key, own = order_key(seed, id_col), F.col(id_col)
    held = F.lit(None).cast("boolean")
    for label in wanted:
        first = F.lit(False)
        if label in cuts:
            last_key, last_id = cuts[label]
            first = (key < last_key) | ((key == last_key) & (own <= F.lit(last_id)))
        held = F.when(F.col(label_col) == label, first).otherwise(held)
    return F.when(within, held)


def _first_bits(key: Column) -> Column:
    """The first 64 bits of a hexadecimal key as a long in the same order."""
    high, low = (F.conv(F.substring(key, start, 8), 16, 10).cast("long") for start in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def _cut_ids(keyed: DataFrame, places: Mapping[str, Place], wanted: Mapping[str, int], seed: int) -> dict[str, tuple]:
    """Per class the whole key and the id of the last row held out.

    Rows of one id share all bits, so only they and chance collisions stand at the cut; they are
    counted per id.
    """
    at_cut = reduce(lambda a, b: a | b, [
        (F.col("group") == F.lit(label)) & (F.col("key") == F.lit(place.key)) for label, place in places.items()
    ])
    ids = keyed.filter(at_cut).groupBy("group", order_key(seed, "id").alias("whole"), "id").agg(F.count("*").alias("n"))
    cuts: dict[str, tuple] = {}
    left = {label: wanted[label] - place.before for label, place in places.items()}
    for row in sorted(ids.collect(), key=lambda r: (r["group"], r["whole"], r["id"])):
        if left[row["group"]] > 0:
            cuts[row["group"]] = (row["whole"], row["id"])
            left[row["group"]] -= row["n"]
    return cuts


def _fraction_quotas(fractions: Mapping[str, float]) -> Quotas:
    return lambda totals: {label: max(1, int(n * fractions[label])) for label, n in totals.items()}


def _stratified_quotas(fraction: float) -> Quotas:
    def quotas(totals: Mapping[str, int]) -> dict[str, int]:
        small = sorted(label for label, n in totals.items() if n < 2)
        if small:
            raise ValueError(f"classes with fewer than two rows cannot be split: {small}")
        rows = sum(totals.values())
        wanted = math.ceil(rows * fraction)
        shares = {label: wanted * n / rows for label, n in totals.items()}
        quota = {label: int(share) for label, share in shares.items()}
        by_remainder = sorted(shares, key=lambda label: (-round(shares[label] - quota[label], 9), label))
        for label in by_remainder[:wanted - sum(quota.values())]:
            quota[label] += 1
        return quota

    return quotas


def split_by_fraction_per_label(
    df: DataFrame,
    fractions: Mapping[str, float] = fv.HOLD_OUT_FRACTIONS,
    within: Column | None = None,
    seed: int = fv.SEED,
    id_col: str = ID,
    label_col: str = LABEL,
) -> DataFrame:
    """Add ``split``: per class ``max(1, floor(n * fraction))`` rows to test, the rest to train.

    Rows outside ``within`` and classes without a fraction have a NULL split.
    """
    within = F.lit(True) if within is None else within
    held = _held_out(df, within, list(fractions), _fraction_quotas(fractions), seed, id_col, label_col)
    return df.withColumn(SPLIT, F.when(held, TEST).when(~held, TRAIN))


def split_stratified_total(
    df: DataFrame,
    fraction: float = fv.VALIDATION_FRACTION,
    within: Column | None = None,
    names: tuple[str, str] = (TRAIN, VALIDATION),
    seed: int = fv.SEED,
    id_col: str = ID,
    label_col: str = LABEL,
    labels: Sequence[str] = fv.LABELS,
) -> DataFrame:
    """Add ``split``: ``ceil(n * fraction)`` rows held out, shared over classes by largest remainder.

    Rows outside ``within`` and classes outside ``labels`` have a NULL split.
    """
    within = F.lit(True) if within is None else within
    held = _held_out(df, within, labels, _stratified_quotas(fraction), seed, id_col, label_col)
    return df.withColumn(SPLIT, F.when(held, names[1]).when(~held, names[0]))


def four_way_split(
    df: DataFrame, fraction: float = fv.VALIDATION_FRACTION, seed: int = fv.SEED, scheme: LabelScheme = SCHEME
) -> DataFrame:
    """Add ``split``: train, validation, unlabelled or test; every row gets exactly one."""
    parts = split_stratified_total(df, fraction, within=is_labelled(scheme), seed=seed)
    return parts.withColumn(
        SPLIT, F.when(is_official_test(), TEST).otherwise(F.coalesce(F.col(SPLIT), F.lit(UNLABELLED)))
    )


def ratio_split(
    df: DataFrame,
    ratios: Mapping[str, float] = fv.SPLIT_RATIOS,
    seed: int = fv.SEED,
    id_col: str = ID,
    label_col: str = LABEL,
    labels: Sequence[str] = fv.LABELS,
) -> DataFrame:
    """Add ``split`` by three ratios: the test share is held out first, then validation.

    Classes outside ``labels`` have a NULL split.
    """
    rest = ratios[TRAIN] + ratios[VALIDATION]
    options = (seed, id_col, label_col)
    test = _held_out(df, F.lit(True), labels, _stratified_quotas(ratios[TEST]), *options)
    kept = F.coalesce(~test, F.lit(False))
    validation = _held_out(df, kept, labels, _stratified_quotas(ratios[VALIDATION] / rest), *options)
    return df.withColumn(SPLIT, F.when(test, TEST).when(validation, VALIDATION).when(~validation, TRAIN))


def resplit(train: DataFrame, validation: DataFrame, **options) -> DataFrame:
    """Put two parts back together and split them anew per class."""
    merged = union_phases(*[part.drop(SPLIT) for part in (train, validation)])
    return split_by_fraction_per_label(merged, **options)


def sample_n(df: DataFrame, n: int = fv.NEITHER_SAMPLE, seed: int = fv.SEED, id_col: str = ID) -> DataFrame:
    """Exactly ``min(count, n)`` rows, the same ones for the same seed."""
    return df.orderBy(order_key(seed, id_col), F.col(id_col)).limit(n)


def first_per_class(df: DataFrame, value: Column, id_col: str = ID, label_col: str = LABEL) -> DataFrame:
    """One example per class: the value of the row with the smallest id."""
    return df.groupBy(label_col).agg(F.min_by(value, F.col(id_col)).alias("example"))


def leaked_ids(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Ids that occur in more than one split; empty when the splits are disjoint."""
    parts = df.groupBy(id_col).agg(F.min(SPLIT).alias("first_split"), F.max(SPLIT).alias("last_split"))
    return parts.filter(F.col("first_split") != F.col("last_split"))


def with_case_number(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Number rows from 1 in id order without ranking them in one task.

    The sorted rows are written down, so that their partitions are the same when
    they are counted and when they are numbered; a row's number is its place in
    its partition plus the rows of all partitions before.
    """
    # The second sort key lets rows of one id fall to several partitions.
    ordered = df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(id_col, "_tie").drop("_tie")
    placed = cut_lineage(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per partition of the sorted table.
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("case_num", F.col("_before") + place + 1)
        .drop("_part", "_place", "_before")
    )
