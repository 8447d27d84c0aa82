"""Tiered routing of each row between keywords and two models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import label_at, probability_of
from notewright.schema import SCHEME, LabelScheme


def decision(
    kw_a: Column, kw_b: Column, b: Column, pb: Column, s: Column, ps: Column, scheme: LabelScheme = SCHEME
) -> Column:
    """The routing decision as a struct (predicted_label, confidence, decision_reason).

    ``b`` and ``s`` are the labels of the baseline and the semi-supervised model,
    ``pb`` and ``ps`` their probabilities. Keywords decide first; then agreement
    of the models; then the model that is stronger on the label it predicts;
    then a weighted vote, whose ties go to the baseline.
    """
    def outcome(label: Column, confidence: Column, reason: Column) -> Column:
        return F.struct(
            label.alias("predicted_label"), confidence.alias("confidence"), reason.alias("decision_reason")
        )

    sure = F.lit(1.0)
    b_weight = F.when(b == scheme.neither, fv.BASELINE_NEITHER_WEIGHT).otherwise(1.0)
    s_weight = F.when(s != scheme.neither, fv.SEMISUP_POSITIVE_WEIGHT).otherwise(1.0)
    winner = F.when(pb * b_weight >= ps * s_weight, b).otherwise(s)
    share = F.greatest(pb * b_weight, ps * s_weight) / (b_weight + s_weight)
    return (
        F.when(kw_a & kw_b, outcome(F.lit(scheme.both), sure, F.lit(fv.REASON_BOTH_KEYWORDS)))
        .when(kw_b, outcome(F.lit(scheme.only_b), sure, F.lit(fv.REASON_DIABETES_KEYWORD)))
        .when(kw_a, outcome(F.lit(scheme.only_a), sure, F.lit(fv.REASON_CANCER_KEYWORD)))
        .when(b == s, outcome(b, (pb + ps) / 2.0, F.format_string(fv.REASON_AGREEMENT, b)))
        .when(b == scheme.neither, outcome(b, pb, F.lit(fv.REASON_BASELINE)))
        .when(s.isin(scheme.only_a, scheme.only_b, scheme.both), outcome(s, ps, F.lit(fv.REASON_SEMISUP)))
        .otherwise(outcome(winner, share, F.format_string(fv.REASON_VOTE, winner)))
    )


def route(
    df: DataFrame,
    baseline_probs: str = "baseline_probs",
    semisup_probs: str = "semisup_probs",
    kw_a: str = "has_cancer_kw",
    kw_b: str = "has_diabetes_kw",
    scheme: LabelScheme = SCHEME,
) -> DataFrame:
    """Add both models' own label and confidence, and the decision between them."""
    picked = df.withColumns({
        "baseline_pred": label_at(F.col(baseline_probs), scheme),
        "baseline_conf": F.array_max(baseline_probs),
        "semisup_pred": label_at(F.col(semisup_probs), scheme),
        "semisup_conf": F.array_max(semisup_probs),
    })
    decided = decision(
        F.col(kw_a), F.col(kw_b), F.col("baseline_pred"), F.col("baseline_conf"),
        F.col("semisup_pred"), F.col("semisup_conf"), scheme,
    )
    return picked.withColumn("_decision", decided).select(*picked.columns, "_decision.*")


def soft_vote(
    df: DataFrame,
    probabilities: Mapping[str, str],
    weights: Mapping[str, float] = fv.SOFT_VOTE_WEIGHTS,
    scheme: LabelScheme = SCHEME,
) -> DataFrame:
    """Add ``vote_probs``, the weighted mean of probability arrays, and the label it picks.

    ``probabilities`` maps the name used in ``weights`` to a column.
    """
    whole = sum(weights[name] for name in probabilities)
    votes = [
        sum((F.col(column)[i] * (weights[name] / whole) for name, column in probabilities.items()), F.lit(0.0))
        for i in range(len(scheme.labels))
    ]
    voted = df.withColumn("vote_probs", F.array(*votes))
    label = label_at(F.col("vote_probs"), scheme)
    return voted.withColumn("vote_label", label).withColumn(
        "vote_confidence", probability_of(F.col("vote_probs"), F.col("vote_label"), scheme)
    )
