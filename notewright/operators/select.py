"""Row filters and projections over a note table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from notewright import fixed_values as fv
from notewright.functions.labels import combined_label
from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, SOURCE, TEST_SET, TEXT, LabelScheme

LabelFunction = Callable[[Column, Column], Column]


def with_label(df: DataFrame, scheme: LabelScheme = SCHEME, label_fn: LabelFunction | None = None) -> DataFrame:
    """Add the combined label; ``label_fn`` maps the two flag columns to a label column."""
    label_fn = label_fn or (lambda a, b: combined_label(a, b, scheme))
    return df.withColumn(LABEL, label_fn(F.col(scheme.flag_a), F.col(scheme.flag_b)))


def is_official_test() -> Column:
    return F.coalesce(F.col(TEST_SET) == 1, F.lit(False))


def is_labelled(scheme: LabelScheme = SCHEME) -> Column:
    """Outside the official test, with both flags known."""
    return (F.col(TEST_SET) == 0) & F.col(scheme.flag_a).isNotNull() & F.col(scheme.flag_b).isNotNull()


def is_unlabelled_any(scheme: LabelScheme = SCHEME) -> Column:
    """Outside the official test, with at least one flag unknown."""
    return (F.col(TEST_SET) == 0) & (F.col(scheme.flag_a).isNull() | F.col(scheme.flag_b).isNull())


def is_unlabelled_all(scheme: LabelScheme = SCHEME) -> Column:
    """Outside the official test, with both flags unknown."""
    return (F.col(TEST_SET) == 0) & F.col(scheme.flag_a).isNull() & F.col(scheme.flag_b).isNull()


def labelled(df: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    return df.filter(is_labelled(scheme))


def unlabelled_any(df: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    return df.filter(is_unlabelled_any(scheme))


def unlabelled_all(
    df: DataFrame, *taken: DataFrame, scheme: LabelScheme = SCHEME, id_col: str = ID
) -> DataFrame:
    """Rows open to pseudo-labelling: both flags unknown, id in none of ``taken``."""
    return exclude_ids(df.filter(is_unlabelled_all(scheme)), *taken, id_col=id_col)


def official_test(df: DataFrame) -> DataFrame:
    return df.filter(is_official_test())


def labelled_complete(df: DataFrame) -> DataFrame:
    """Rows outside the official test with no NULL in any column."""
    return df.filter(F.col(TEST_SET) == 0).na.drop("any")


def without_flags(df: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    """Rows with both flags unknown, whichever set they belong to."""
    return df.filter(F.col(scheme.flag_a).isNull() & F.col(scheme.flag_b).isNull())


def exclude_ids(df: DataFrame, *taken: DataFrame, id_col: str = ID) -> DataFrame:
    """Rows whose id occurs in none of ``taken``; an id repeated there is shipped once."""
    for other in taken:
        df = df.join(other.select(id_col).distinct(), id_col, "left_anti")
    return df


def attach(df: DataFrame, columns: DataFrame, id_col: str = ID) -> DataFrame:
    """Add columns computed elsewhere, matched by id and never by position."""
    return df.join(columns, id_col, "left")


def features_labels_text(df: DataFrame, include_text: bool = True, id_col: str = ID) -> DataFrame:
    """Id, feature vector, label and, on request, text."""
    columns = [
        F.col(id_col),
        array_to_vector(F.col(EMBEDDING).cast("array<double>")).alias("features"),
        F.col(LABEL),
    ]
    return df.select(*columns, *([F.col(TEXT)] if include_text else []))


def merge_synonym_columns(df: DataFrame, keep: str = fv.HEADER_SYNONYM[0], synonym: str = fv.HEADER_SYNONYM[1]) -> DataFrame:
    """Fill ``keep`` from ``synonym`` and drop the latter; rename it when ``keep`` is absent."""
    if synonym not in df.columns:
        return df
    if keep not in df.columns:
        return df.withColumnRenamed(synonym, keep)
    return df.withColumn(keep, F.coalesce(F.col(keep), F.col(synonym))).drop(synonym)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """Say where the rows' labels came from."""
    return df.withColumn(SOURCE, F.lit(source))


def union_phases(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; a column missing from one is NULL there."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
