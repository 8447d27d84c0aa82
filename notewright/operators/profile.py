"""Profiles of a note table: quality, distributions, coverage, keyword tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import is_set
from notewright.operators.quantiles import exact_quantile
from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, TEXT, LabelScheme
from notewright.session import cut_lineage


def data_quality(df: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    """One row of counts about a note table, in one pass."""
    a, b = F.col(scheme.flag_a), F.col(scheme.flag_b)
    missing_vectors = F.count_if(F.col(EMBEDDING).isNull()) if EMBEDDING in df.columns else F.lit(0).cast("long")
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col(TEXT).isNull()).alias("missing_text"),
        missing_vectors.alias("missing_embeddings"),
        F.count_if(F.length(TEXT) == 0).alias("empty_text"),
        F.avg(F.length(TEXT)).alias("avg_text_length"),
        F.count_if(a.isNotNull() & b.isNotNull()).alias("labeled_records"),
        F.count_if(a.isNull() | b.isNull()).alias("unlabeled_records"),
    )


def class_distribution(df: DataFrame, by: Sequence[str] = (), label_col: str = LABEL) -> DataFrame:
    """Count and percentage per class, over the table or within each ``by`` group."""
    counts = df.groupBy(*by, label_col).agg(F.count("*").alias("n"))
    # The window sees one row per class and group, not the table.
    whole = F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])))
    return counts.withColumn("percentage", F.round(F.col("n") * 100.0 / whole, 2))


def header_rows(df: DataFrame, headers: str = "headers", id_col: str = ID) -> DataFrame:
    """(id, header, value), one row per header of a note.

    The outer form keeps the optimiser from parsing each note a second time just
    to drop notes without headers before they are unfolded.
    """
    rows = df.select(F.col(id_col), F.explode_outer(headers).alias("header", "value"))
    return rows.filter(F.col("header").isNotNull())


def header_coverage(df: DataFrame, headers: str = "headers", id_col: str = ID, top: int = 20) -> DataFrame:
    """The most frequent headers, with a sample value each."""
    return (
        header_rows(df, headers, id_col)
        .groupBy("header")
        .agg(F.count("*").alias("n"), F.min_by("value", id_col).alias("sample_value"))
        .orderBy(F.desc("n"), "header")
        .limit(top)
    )


def widen_headers(
    df: DataFrame, headers: str = "headers", names: Sequence[str] = fv.NOTE_HEADERS
) -> DataFrame:
    """The listed headers as columns, NULL where a note lacks one."""
    kept = [c for c in df.columns if c != headers]
    return df.select(*kept, *[F.col(headers)[name].alias(name) for name in names])


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count and percentage of each listed column, in one pass."""
    totals = df.agg(
        F.count("*").alias("_all"),
        *[F.count(F.col(f"`{name}`")).alias(f"_{i}") for i, name in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"_{i}").alias("n"),
                 F.round(F.try_divide(F.col(f"_{i}") * 100.0, F.col("_all")), 1).alias("percentage"))
        for i, name in enumerate(columns)
    ])
    return totals.select(F.inline(rows))


def text_length_stats(
    df: DataFrame, label_col: str = LABEL, length: Column | None = None, labels: Sequence[str] = fv.LABELS
) -> DataFrame:
    """Mean, exact median, minimum and maximum text length per listed class."""
    length = F.length(TEXT) if length is None else length
    rows = cut_lineage(df.filter(F.col(label_col).isin(*labels)).select(label_col, length.alias("length")))
    stats = rows.groupBy(label_col).agg(F.avg("length").alias("mean"), F.min("length").alias("min"), F.max("length").alias("max"))
    median = exact_quantile(rows, label_col, labels, "length").withColumnRenamed("quantile", "median")
    return stats.join(F.broadcast(median), label_col, "left").select(label_col, "mean", "median", "min", "max")


def crosstab_share(df: DataFrame, flag: str, label_col: str = LABEL) -> DataFrame:
    """Share of rows without and with a flag, in percent of each class."""
    counts = df.groupBy(label_col).agg(
        F.count("*").alias("_all"), F.count_if(F.col(flag)).alias("_with")
    )
    return counts.select(
        label_col,
        F.round((F.col("_all") - F.col("_with")) * 100.0 / F.col("_all"), 1).alias("without_flag"),
        F.round(F.col("_with") * 100.0 / F.col("_all"), 1).alias("with_flag"),
    )


def crosstab_counts(df: DataFrame, values: Sequence[str], column: str = "source", label_col: str = LABEL) -> DataFrame:
    """Rows per class and listed value, one column per value."""
    return df.groupBy(label_col).agg(
        *[F.count_if(F.col(column) == value).alias(value) for value in values]
    )


def condition_totals(df: DataFrame, scheme: LabelScheme = SCHEME, label_col: str = LABEL) -> DataFrame:
    """Rows per condition, where the both-label counts for each."""
    label = F.col(label_col)
    return df.agg(
        F.count_if(label.isin(scheme.only_a, scheme.both)).alias("condition_a"),
        F.count_if(label.isin(scheme.only_b, scheme.both)).alias("condition_b"),
        F.count_if(label == scheme.neither).alias("neither"),
    )


def keyword_totals(df: DataFrame, hit_a: str = "has_cancer_kw", hit_b: str = "has_diabetes_kw") -> DataFrame:
    """Rows with a keyword of either kind, and of both."""
    return df.agg(
        F.count_if(F.col(hit_a)).alias("hits_a"),
        F.count_if(F.col(hit_b)).alias("hits_b"),
        F.count_if(F.col(hit_a) & F.col(hit_b)).alias("hits_both"),
    )


def probability_diagnostics(
    df: DataFrame, scores: Mapping[str, tuple[str, str]], threshold: float = fv.RELAXED_NEITHER_BELOW
) -> DataFrame:
    """Per classifier: highest probability, mean over positives and negatives, rows under a threshold.

    ``scores`` maps a classifier's name to its (probability, true flag) columns.
    """
    aggregates: list[Column] = []
    for name, (probability, truth) in scores.items():
        p, positive = F.col(probability), is_set(F.col(truth))
        negative = F.coalesce(F.col(truth) == 0.0, F.lit(False))
        aggregates += [
            F.max(p).alias(f"{name}_max"),
            F.avg(F.when(positive, p)).alias(f"{name}_positive"),
            F.avg(F.when(negative, p)).alias(f"{name}_negative"),
            F.count_if(p < threshold).alias(f"{name}_below"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("classifier"),
            F.col(f"{name}_max").alias("max_probability"),
            F.col(f"{name}_positive").alias("mean_positive"),
            F.col(f"{name}_negative").alias("mean_negative"),
            F.col(f"{name}_below").alias("n_below"),
        )
        for name in scores
    ])
    return df.agg(*aggregates).select(F.inline(rows))


def training_metadata(
    df: DataFrame, scheme: LabelScheme = SCHEME, label_col: str = LABEL, source_col: str = "source"
) -> DataFrame:
    """Sizes of the labelled and expanded training sets, and the labelled share of ``neither``."""
    given = F.col(source_col) == fv.SOURCE_LABELED
    return df.agg(
        F.count_if(given).alias("n_baseline_train"),
        F.count("*").alias("n_semisup_train"),
        (F.count("*") - F.count_if(given)).alias("n_synthetic"),
        F.try_divide(F.count_if(given & (F.col(label_col) == scheme.neither)), F.count_if(given)).alias(
            "baseline_neither_pct"
        ),
    )
