"""Comparison of two prediction tables.

After the join, everything but the median and the row lists comes from one
table of sums per pair of predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators.quantiles import exact_quantile
from notewright.session import cut_lineage

FIRST, SECOND = "baseline", "llm"


def align_predictions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join a routing table and a retrieval table on the patient; repeated ids multiply."""
    routed = left.select(
        F.col("patient_identifier").alias("patient_id"),
        "text",
        F.col("predicted_label").alias("baseline_prediction"),
        F.col("confidence").alias("baseline_confidence"),
    )
    retrieved = right.select(
        "patient_id",
        F.col("final_classification").alias("llm_prediction"),
        "pred_has_cancer",
        "pred_has_diabetes",
        F.col("final_confidence").alias("llm_confidence"),
        "initial_classification",
        "decision_rationale",
    )
    return routed.join(retrieved, "patient_id", "inner")


def _prediction(model: str) -> Column:
    return F.col(f"{model}_prediction")


def _confidence(model: str) -> Column:
    return F.col(f"{model}_confidence")


def _same() -> Column:
    return F.coalesce(_prediction(FIRST) == _prediction(SECOND), F.lit(False))


def pair_sums(aligned: DataFrame) -> DataFrame:
    """Rows and confidence sums per pair of predictions."""
    return aligned.groupBy(f"{FIRST}_prediction", f"{SECOND}_prediction").agg(
        F.count("*").alias("n"),
        *[
            column
            for model in (FIRST, SECOND)
            for column in (
                F.sum(_confidence(model)).alias(f"{model}_sum"),
                F.count(_confidence(model)).alias(f"{model}_known"),
            )
        ],
    )


def prediction_distribution(sums: DataFrame) -> DataFrame:
    """Share of each label per model in percent, and the difference, over the labels of either."""
    zero = F.lit(0).cast("long")
    sides = sums.select(F.inline(F.array(
        F.struct(_prediction(FIRST).alias("label"), F.col("n").alias("first_n"), zero.alias("second_n")),
        F.struct(_prediction(SECOND).alias("label"), zero.alias("first_n"), F.col("n").alias("second_n")),
    )))
    per_label = sides.groupBy("label").agg(F.sum("first_n").alias("first_n"), F.sum("second_n").alias("second_n"))
    whole = F.sum("first_n").over(Window.partitionBy(F.lit(1)))
    shares = per_label.select(
        "label",
        (F.col("first_n") / whole * 100.0).alias("baseline_pct"),
        (F.col("second_n") / whole * 100.0).alias("llm_pct"),
    )
    return shares.filter(F.col("label").isNotNull()).withColumn(
        "difference", F.col("llm_pct") - F.col("baseline_pct")
    )


def disagreement_summary(sums: DataFrame) -> DataFrame:
    """Rows, agreements, disagreements and the agreement rate."""
    total, agreed = F.sum("n"), F.coalesce(F.sum(F.when(_same(), F.col("n"))), F.lit(0))
    return sums.agg(
        total.alias("total_cases"),
        agreed.alias("agreements"),
        (total - agreed).alias("disagreements"),
        (agreed / total).alias("agreement_rate"),
    )


def disagreement_patterns(sums: DataFrame) -> DataFrame:
    """Pairs of differing predictions by frequency, with their share of all disagreements."""
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    pair = (f"{FIRST}_prediction", f"{SECOND}_prediction")
    return (
        sums.filter(~_same())
        .select(*pair, "n", (F.col("n") * 100.0 / whole).alias("pct_of_disagreements"))
        .orderBy(F.desc("n"), *pair)
    )


def _by_model(aligned: DataFrame) -> DataFrame:
    """Predictions and confidences of both models stacked as (model, prediction, confidence)."""
    return aligned.select(F.inline(F.array(*[
        F.struct(F.lit(model).alias("model"), _prediction(model).alias("prediction"),
                 _confidence(model).alias("confidence"))
        for model in (FIRST, SECOND)
    ])))


def confidence_describe(aligned: DataFrame) -> DataFrame:
    """Mean, exact median, sample deviation, minimum and maximum of each model's confidence.

    The median takes several passes, so the confidences are written down first.
    """
    stacked = cut_lineage(_by_model(aligned).select("model", "confidence"))
    moments = stacked.groupBy("model").agg(
        F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
    )
    median = exact_quantile(stacked, "model", (FIRST, SECOND), "confidence").withColumnRenamed("quantile", "median")
    return moments.join(F.broadcast(median), "model", "left")


def confidence_by_agreement(sums: DataFrame) -> DataFrame:
    """Mean confidence of each model where the two agree and where they differ; NULL for an empty group."""
    def mean(model: str, rows: Column) -> Column:
        return F.sum(F.when(rows, F.col(f"{model}_sum"))) / F.nullif(
            F.sum(F.when(rows, F.col(f"{model}_known"))), F.lit(0)
        )

    return sums.agg(
        mean(FIRST, _same()).alias("agreement_baseline_conf"),
        mean(SECOND, _same()).alias("agreement_llm_conf"),
        mean(FIRST, ~_same()).alias("disagreement_baseline_conf"),
        mean(SECOND, ~_same()).alias("disagreement_llm_conf"),
    )


def confidence_by_class(sums: DataFrame) -> DataFrame:
    """Rows and mean confidence per model and predicted label."""
    sides = sums.select(F.inline(F.array(*[
        F.struct(F.lit(model).alias("model"), _prediction(model).alias("label"), F.col("n"),
                 F.col(f"{model}_sum").alias("total"), F.col(f"{model}_known").alias("known"))
        for model in (FIRST, SECOND)
    ])))
    return sides.groupBy("model", "label").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("avg_confidence")
    )


def disagreements(aligned: DataFrame) -> DataFrame:
    """The rows on which the models differ."""
    return aligned.filter(~_same())


def high_confidence_disagreements(aligned: DataFrame, threshold: float = fv.HIGH_CONFIDENCE) -> DataFrame:
    """Rows on which the models differ and both are surer than ``threshold``."""
    return disagreements(aligned).filter(
        (_confidence(FIRST) > threshold) & (_confidence(SECOND) > threshold)
    )


def first_cases(df: DataFrame, n: int = 10, id_col: str = "patient_id") -> DataFrame:
    """The first ``n`` rows by id, for a report."""
    return df.orderBy(id_col).limit(n)


def comparison_summary(aligned: DataFrame, threshold: float = fv.HIGH_CONFIDENCE) -> DataFrame:
    """All scalar results of a comparison as one row, from one pass over the joined rows."""
    same, strong = _same(), (_confidence(FIRST) > threshold) & (_confidence(SECOND) > threshold)
    columns = [
        F.count("*").alias("total_cases"),
        F.count_if(same).alias("agreements"),
        F.count_if(~same).alias("disagreements"),
        F.try_divide(F.count_if(same), F.count("*")).alias("agreement_rate"),
        F.count_if(~same & strong).alias("high_confidence_disagreements"),
    ]
    for model in (FIRST, SECOND):
        c = _confidence(model)
        columns += [
            F.avg(c).alias(f"{model}_mean"),
            F.stddev_samp(c).alias(f"{model}_std"),
            F.avg(F.when(same, c)).alias(f"agreement_{model}_conf"),
            F.avg(F.when(~same, c)).alias(f"disagreement_{model}_conf"),
        ]
    return aligned.agg(*columns)
