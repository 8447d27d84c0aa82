"""Classification metrics.

Rows are first reduced to counts per (truth, prediction); everything after that
works on at most one row per pair of labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import agrees


def _share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _label_table(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))


def confusion_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per (true_label, predicted_label); rows without a truth cannot be judged and are left out."""
    return (
        df.filter(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("predicted_label"))
        .agg(F.count("*").alias("n"))
    )


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of rows whose labels are equal, over rows with a truth."""
    return _accuracy(confusion_counts(df, truth, predicted))


def _accuracy(counts: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0)))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_judged"), (hits / F.sum("n")).alias("accuracy"))


def flag_accuracy(df: DataFrame, correct: str = "correct") -> DataFrame:
    """Mean of a correctness flag; NULL flags do not count."""
    return df.agg(F.count(correct).alias("n_judged"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def per_class_scores(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None = fv.LABELS
) -> DataFrame:
    """Precision, recall, F1 and support per label.

    With ``labels`` exactly those are scored, present or not; with None the
    labels seen in truth or prediction are.
    """
    return _scores(confusion_counts(df, truth, predicted), labels)


def _scores(counts: DataFrame, labels: Sequence[str] | None) -> DataFrame:
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("predicted_label").alias("label"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("hits")),
    )))
    sums = sides.filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    if labels is not None:
        table = _label_table(counts.sparkSession, labels)
        sums = table.join(sums, "label", "left").na.fill(0, ["support", "predicted", "hits"])
    precision = _share(F.col("hits"), F.col("predicted"))
    recall = _share(F.col("hits"), F.col("support"))
    f1 = _share(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    return sums.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def _averages(scores: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a per-class table, as one row."""
    columns = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    columns += [
        _share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
        for m in ("precision", "recall", "f1")
    ]
    return scores.agg(*columns, F.sum("support").alias("support"))


def compute_metrics(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = fv.LABELS
) -> DataFrame:
    """Accuracy, averages and per-class scores over a fixed label list, as (scope, metric, value)."""
    # All parts start from the same counts, whose shuffle is done once.
    counts = confusion_counts(df, truth, predicted)
    scores = _scores(counts, labels)
    names = [f"{kind}_{m}" for kind in ("macro", "weighted") for m in ("precision", "recall", "f1")]
    overall = _long(_accuracy(counts), F.lit("overall"), ["accuracy"])
    averages = _long(_averages(scores), F.lit("overall"), names)
    per_class = _long(scores, F.col("label"), ["precision", "recall", "f1", "support"])
    return overall.unionByName(averages).unionByName(per_class)


def classification_report(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] | None = None
) -> DataFrame:
    """Per-class lines, accuracy and both averages as (scope, metric, value); by default over the labels seen."""
    counts = confusion_counts(df, truth, predicted)
    scores = _scores(counts, labels)
    averages = _averages(scores)
    parts = [
        _long(scores, F.col("label"), ["precision", "recall", "f1", "support"]),
        _long(_accuracy(counts), F.lit("accuracy"), ["accuracy"]),
    ]
    for kind in ("macro", "weighted"):
        line = averages.select(
            *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")], "support"
        )
        parts.append(_long(line, F.lit(f"{kind} avg"), ["precision", "recall", "f1", "support"]))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _long(df: DataFrame, scope: Column, metrics: Sequence[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])
    return df.select(scope.cast("string").alias("scope"), F.inline(rows))


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, labels: Sequence[str] = fv.LABELS
) -> DataFrame:
    """One row per pair of listed labels, 0 where it never occurs; other pairs are dropped."""
    listed = F.array(*[F.lit(x) for x in labels])
    pairs = _label_table(df.sparkSession, labels).select(
        F.col("label").alias("true_label"), F.explode(listed).alias("predicted_label")
    )
    counts = confusion_counts(df, truth, predicted)
    return pairs.join(counts, ["true_label", "predicted_label"], "left").na.fill(0, ["n"])


def unknown_labels(df: DataFrame, predicted: str, labels: Sequence[str] = fv.LABELS) -> DataFrame:
    """How many predictions lie outside the label list."""
    return df.agg(F.count_if(~F.col(predicted).isin(*labels)).alias("unknown_label"))


def class_recall(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows, hits and recall per true label; labels without rows do not appear."""
    hit = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    return (
        df.filter(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("true_label"))
        .agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"))
        .withColumn("recall", F.col("correct") / F.col("n"))
    )


def model_recall_table(df: DataFrame, truth: str, models: Mapping[str, str]) -> DataFrame:
    """Per true label the recall of several models side by side.

    ``models`` maps a name to its prediction column; all are judged in one pass.
    """
    hits = {name: F.coalesce(F.col(truth) == F.col(column), F.lit(False)) for name, column in models.items()}
    return (
        df.filter(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("true_label"))
        .agg(F.count("*").alias("n"), *[F.avg(hit.cast("double")).alias(f"{name}_recall") for name, hit in hits.items()])
    )


def model_accuracy_table(df: DataFrame, truth: str, models: Mapping[str, str], base: str) -> DataFrame:
    """Overall accuracy per model and its change against ``base`` in points."""
    judged = df.filter(F.col(truth).isNotNull())
    means = judged.agg(*[
        F.avg(F.coalesce(F.col(truth) == F.col(column), F.lit(False)).cast("double")).alias(name)
        for name, column in models.items()
    ])
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("model"),
            F.col(name).alias("accuracy"),
            ((F.col(name) - F.col(base)) * 100.0).alias("points_over_base"),
        )
        for name in models
    ])
    return means.select(F.inline(rows))


def confidence_summary(
    df: DataFrame, initial: str = "initial_confidence", final: str = "final_confidence", skip_zero: bool = False
) -> DataFrame:
    """Mean first and final confidence; ``skip_zero`` leaves zeros out of the means."""
    def mean(name: str) -> Column:
        value = F.col(name)
        return F.avg(F.when(value != 0.0, value) if skip_zero else value)

    return df.agg(mean(initial).alias("avg_initial_confidence"), mean(final).alias("avg_final_confidence"))


def _changed(initial: str, final: str) -> Column:
    return ~F.col(initial).eqNullSafe(F.col(final))


def cases_changed(
    df: DataFrame, initial: str = "initial_classification", final: str = "final_classification"
) -> DataFrame:
    """How many rows' final label differs from the first one, and in percent."""
    changed = F.count_if(_changed(initial, final))
    return df.agg(
        F.count("*").alias("total_cases"),
        changed.alias("cases_changed"),
        F.try_divide(changed * 100.0, F.count("*")).alias("changed_pct"),
    )


def changed_cases(
    df: DataFrame, initial: str = "initial_classification", final: str = "final_classification"
) -> DataFrame:
    """The rows whose final label differs from the first one."""
    return df.filter(_changed(initial, final))


def improvement(
    df: DataFrame,
    truth: str = "true_label",
    initial: str = "initial_classification",
    final: str = "final_classification",
) -> DataFrame:
    """Accuracy of the first and the final label, and the cases won."""
    judged = df.filter(F.col(truth).isNotNull())
    first, last = (F.count_if(F.col(truth) == F.col(c)) for c in (initial, final))
    return judged.agg(
        F.try_divide(first, F.count("*")).alias("initial_accuracy"),
        F.try_divide(last, F.count("*")).alias("final_accuracy"),
        (last - first).alias("improvement"),
    )


def flag_report(df: DataFrame, truth: str, predicted: str, name: str) -> DataFrame:
    """Accuracy, per-value scores and the 2x2 confusion of one 0/1 flag, as (flag, scope, metric, value)."""
    text = df.select(
        F.when(F.col(truth) == 1.0, "1").when(F.col(truth) == 0.0, "0").alias("truth"),
        F.when(F.col(predicted) == 1.0, "1").when(F.col(predicted) == 0.0, "0").alias("predicted"),
    )
    report = classification_report(text, "truth", "predicted", labels=("0", "1"))
    cells = confusion_matrix(text, "truth", "predicted", ("0", "1")).select(
        F.lit("confusion").alias("scope"),
        F.concat_ws("->", "true_label", "predicted_label").alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    return report.unionByName(cells).select(F.lit(name).alias("flag"), "scope", "metric", "value")


def performance_by_label(df: DataFrame, truth: str = "true_label", correct: str = "correct") -> DataFrame:
    """Rows, correct rows and their share per true label."""
    return df.groupBy(F.col(truth).alias("true_label")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(correct)).alias("n_correct"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
    )


def with_correctness(
    df: DataFrame,
    predicted: tuple[str, str] = ("pred_has_cancer", "pred_has_diabetes"),
    truth: tuple[str, str] = ("true_has_cancer", "true_has_diabetes"),
    null_as_wrong: bool = False,
) -> DataFrame:
    """Add ``correct_cancer``, ``correct_diabetes`` and ``correct``."""
    first = agrees(F.col(predicted[0]), F.col(truth[0]), null_as_wrong)
    second = agrees(F.col(predicted[1]), F.col(truth[1]), null_as_wrong)
    return df.withColumns({"correct_cancer": first, "correct_diabetes": second, "correct": first & second})
