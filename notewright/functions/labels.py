"""Column expressions on flags and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.schema import SCHEME, LabelScheme


def clean_flag(flag: Column) -> Column:
    """A flag as a nullable double: NaN becomes NULL."""
    value = flag.cast("double")
    return F.when(~F.isnan(value), value)


def is_set(flag: Column) -> Column:
    """True where the flag is 1.0; NULL and NaN count as not set."""
    return F.coalesce(flag == F.lit(1.0), F.lit(False))


def combined_label(flag_a: Column, flag_b: Column, scheme: LabelScheme = SCHEME) -> Column:
    """The four-way label; anything that is not set falls to ``neither``."""
    a, b = is_set(flag_a), is_set(flag_b)
    return (
        F.when(a & b, F.lit(scheme.both))
        .when(a, F.lit(scheme.only_a))
        .when(b, F.lit(scheme.only_b))
        .otherwise(F.lit(scheme.neither))
    )


def agrees(predicted: Column, truth: Column, null_as_wrong: bool = False) -> Column:
    """Whether a predicted flag equals its truth; an unknown truth gives NULL unless asked."""
    same = predicted == clean_flag(truth)
    return F.coalesce(same, F.lit(False)) if null_as_wrong else same


def label_literals(scheme: LabelScheme = SCHEME) -> Column:
    """The labels as one constant array, in canonical order."""
    return F.array(*[F.lit(label) for label in scheme.labels])


def label_at(probabilities: Column, scheme: LabelScheme = SCHEME) -> Column:
    """The label with the highest probability; ties go to the earlier label."""
    best = F.array_position(probabilities, F.array_max(probabilities))
    return F.element_at(label_literals(scheme), best.cast("int"))


def probability_of(probabilities: Column, label: Column, scheme: LabelScheme = SCHEME) -> Column:
    """The probability held for ``label`` in an array ordered like the labels."""
    place = F.array_position(label_literals(scheme), label)
    return F.when(place > 0, F.element_at(probabilities, place.cast("int")))
