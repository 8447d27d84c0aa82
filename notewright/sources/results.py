"""Prediction tables, metrics and reports on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators import compare, metrics
from notewright.operators.compare import disagreements, high_confidence_disagreements
from notewright.operators.profile import training_metadata
from notewright.sources.notes import CSV_OPTIONS, CSV_WRITE_OPTIONS

VALIDATION, TEST = "validation", "test"


def routing_table(routed: DataFrame, true_label: str = "combined_label") -> DataFrame:
    """The columns of a routing prediction table, with ``correct`` by label."""
    return (
        routed.withColumn("true_label", F.col(true_label))
        .withColumn("correct", F.col("predicted_label") == F.col("true_label"))
        .select(*fv.ROUTING_COLUMNS)
    )


def save_predictions(df: DataFrame, path: str, csv: bool = False) -> None:
    """Write a prediction table as Parquet, or as CSV on request."""
    writer = df.write.mode("overwrite")
    if csv:
        writer.options(**CSV_WRITE_OPTIONS).csv(path)
    else:
        writer.parquet(path)


def save_dataset_predictions(df: DataFrame, path: str, dataset: str) -> None:
    """Write a retrieval prediction table under its dataset; anything but ``test`` is validation.

    Only that dataset's folder is replaced.
    """
    folder = TEST if dataset == TEST else VALIDATION
    df.select(*fv.RETRIEVAL_COLUMNS).write.mode("overwrite").parquet(f"{path}/dataset={folder}")


def load_results(
    spark: SparkSession, first: str, second: str, csv: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two stored prediction tables."""
    def read(path: str) -> DataFrame:
        if not csv:
            return spark.read.parquet(path)
        df = spark.read.options(**CSV_OPTIONS).csv(path)
        doubles = {c: df[c].try_cast("double") for c in df.columns if "conf" in c or c.startswith("pred_has")}
        ids = {c: df[c].try_cast("bigint") for c in ("patient_identifier", "patient_id") if c in df.columns}
        return df.withColumns({**doubles, **ids})

    return read(first), read(second)


def save_metrics_json(metrics: DataFrame, path: str) -> None:
    """Write a metrics table, which has a few rows per label, as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def _by_label(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """One row ``value``: a map from label to a struct. Rows are one per label."""
    entry = F.struct(F.col(label).alias("key"), F.struct(*columns).alias("value"))
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("value"))


def _document(**parts: DataFrame) -> DataFrame:
    """One row ``value``: the JSON text of one-row tables put side by side under their names."""
    names = list(parts)
    whole = None
    for name in names:
        part = parts[name].select(F.lit(1).alias("_one"), F.struct(*parts[name].columns).alias(name))
        whole = part if whole is None else whole.join(F.broadcast(part), "_one")
    fields = []
    for name in names:
        inner = parts[name].columns
        fields.append(F.col(f"{name}.value").alias(name) if inner == ["value"] else F.col(name))
    return whole.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def metrics_document(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, averages and per-class scores as one nested JSON text."""
    names = ["accuracy"] + [f"{kind}_{m}" for kind in ("macro", "weighted") for m in ("precision", "recall", "f1")]
    long = metrics.compute_metrics(df, truth, predicted)
    overall = long.filter(F.col("scope") == "overall").agg(
        *[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in names]
    )
    classes = long.filter(F.col("scope") != "overall").groupBy("scope").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("precision", "recall", "f1")],
        F.max(F.when(F.col("metric") == "support", F.col("value"))).cast("long").alias("support"),
    )
    per_class = _by_label(classes, "scope", ["precision", "recall", "f1", "support"])
    return _document(overall=overall, per_class=per_class)


def routing_document(
    routed: DataFrame, expanded: DataFrame, truth: str = "true_label"
) -> DataFrame:
    """The evaluation of a routing run as one nested JSON text.

    Accuracy and recall of both models and of the routed label, and the sizes of
    the training sets.
    """
    models = {"baseline": "baseline_pred", "semi_supervised": "semisup_pred", "ensemble": "predicted_label"}
    judged = routed.filter(F.col(truth).isNotNull())
    accuracy = judged.agg(*[
        F.avg((F.col(truth) == F.col(column)).cast("double")).alias(name) for name, column in models.items()
    ])
    recalls = metrics.model_recall_table(routed, truth, models)
    per_class = _by_label(recalls, "true_label", ["n", *[f"{name}_recall" for name in models]])
    return _document(
        overall_accuracy=accuracy, per_class_performance=per_class, training_metadata=training_metadata(expanded)
    )


def retrieval_document(predictions: DataFrame) -> DataFrame:
    """The evaluation of a retrieval run as one nested JSON text."""
    truth, final = "true_label", "final_classification"
    totals = predictions.agg(
        F.count("*").alias("total_cases"),
        F.avg((F.col(truth) == F.col(final)).cast("double")).alias("overall_accuracy"),
        F.avg("initial_confidence").alias("avg_initial_confidence"),
        F.avg("final_confidence").alias("avg_final_confidence"),
        F.count_if(~F.col("initial_classification").eqNullSafe(F.col(final))).alias("cases_changed"),
    )
    per_class = _by_label(metrics.class_recall(predictions, truth, final), "true_label", ["n", "correct", "recall"])
    return _document(totals=totals, per_class_metrics=per_class)


def comparison_document(aligned: DataFrame, threshold: float = fv.HIGH_CONFIDENCE) -> DataFrame:
    """The summary of a comparison as one nested JSON text."""
    shares = compare.prediction_distribution(compare.pair_sums(aligned))
    return _document(
        summary=compare.comparison_summary(aligned, threshold),
        prediction_distribution=_by_label(shares, "label", ["baseline_pct", "llm_pct", "difference"]),
    )


def save_document(document: DataFrame, path: str) -> None:
    """Write a one-row JSON document as one file."""
    document.coalesce(1).write.mode("overwrite").text(path)


def save_comparison(aligned: DataFrame, path: str, threshold: float = fv.HIGH_CONFIDENCE) -> list[str]:
    """Write the full comparison and, where not empty, both lists of disagreements.

    The lists are read off the written table, so the comparison is computed
    once. Returns the names written.
    """
    aligned.write.mode("overwrite").parquet(f"{path}/full")
    stored = aligned.sparkSession.read.schema(aligned.schema).parquet(f"{path}/full")
    lists = {
        "disagreements": disagreements(stored),
        "high_confidence_disagreements": high_confidence_disagreements(stored, threshold),
    }
    written = ["full"]
    for name, rows in lists.items():
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            written.append(name)
    return written


def text_summary(predictions: DataFrame, dataset: str = VALIDATION) -> DataFrame:
    """The readable report of a retrieval prediction table, as one row ``value``."""
    truth, final = F.col("true_label"), F.col("final_classification")
    changed = ~F.col("initial_classification").eqNullSafe(final)
    sums = predictions.agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("right"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("initial_confidence").alias("initial"),
        F.avg("final_confidence").alias("final"),
        F.count_if(changed).alias("changed"),
        *[F.count_if(truth == label).alias(f"n{i}") for i, label in enumerate(fv.LABELS)],
        *[F.count_if((truth == label) & (final == label)).alias(f"hit{i}") for i, label in enumerate(fv.LABELS)],
    )

    def line(text: str, *values: Column) -> Column:
        return F.format_string(text, *values)

    def percent(value: Column) -> Column:
        return F.format_string("%.1f%%", value * 100.0)

    def heading(text: str) -> str:
        return f"{fv.REPORT_RULE}\n{text}\n{fv.REPORT_RULE}"

    accuracy = F.when(F.col("accuracy").isNotNull(), percent(F.col("accuracy"))).otherwise("unknown")
    lines = [
        F.lit(heading(f"RETRIEVAL RUN - {dataset.upper()} SET RESULTS") + "\n"),
        line(fv.REPORT_TOTAL, F.col("n")),
        line(fv.REPORT_CORRECT, F.col("right")),
        F.concat(F.lit(fv.REPORT_ACCURACY), accuracy, F.lit("\n")),
        F.lit(fv.REPORT_CLASSES),
    ]
    for i, label in enumerate(fv.LABELS):
        n, hit = F.col(f"n{i}"), F.col(f"hit{i}")
        counts = line(fv.REPORT_CLASS.format(label=label), hit, n)
        lines.append(F.when(n > 0, F.concat(counts, percent(hit / n))))
    lines += [
        F.lit("\n" + heading(fv.REPORT_CONFIDENCE)),
        line(fv.REPORT_INITIAL, F.col("initial")),
        line(fv.REPORT_FINAL, F.col("final")),
        F.lit("\n" + heading(fv.REPORT_CHANGES)),
        F.concat(
            line(fv.REPORT_CHANGED, F.col("changed")),
            F.coalesce(percent(F.try_divide(F.col("changed"), F.col("n"))), F.lit("unknown")), F.lit(")"),
        ),
    ]
    return sums.select(F.concat_ws("\n", *lines).alias("value"))


def save_text_summary(predictions: DataFrame, path: str, dataset: str = VALIDATION) -> None:
    """Write the readable report as one text file."""
    text_summary(predictions, dataset).coalesce(1).write.mode("overwrite").text(path)
