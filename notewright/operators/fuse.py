"""A fixed policy that weighs retrieved cases, a first label and the text itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import combined_label, label_literals
from notewright.schema import LABEL, SCHEME, LabelScheme


def neighbour_vote(hits: DataFrame, scheme: LabelScheme = SCHEME) -> DataFrame:
    """Per query the most frequent label of its retrieved cases, and its share.

    Equal counts go to the earlier label. ``mixed`` says that no label holds
    more than half of the cases.
    """
    counts = hits.groupBy("query_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(LABEL) == label).alias(f"_{i}") for i, label in enumerate(scheme.labels)],
    )
    votes = F.array(*[F.col(f"_{i}") for i in range(len(scheme.labels))])
    top = F.array_max(votes)
    place = F.array_position(votes, top).cast("int")
    return counts.select(
        "query_id",
        F.element_at(label_literals(scheme), place).alias("neighbour_label"),
        (top / F.col("n")).alias("neighbour_share"),
        (top * 2 <= F.col("n")).alias("mixed"),
    )


def fuse_evidence(
    df: DataFrame,
    initial: str = "initial_classification",
    confidence: str = "initial_confidence",
    kw_a: str = "has_cancer_kw",
    kw_b: str = "has_diabetes_kw",
    low: float = fv.LOW_CONFIDENCE,
    scheme: LabelScheme = SCHEME,
) -> DataFrame:
    """Add ``final_classification``, ``final_confidence`` and ``evidence``.

    This library's reading of the policy: a neighbour vote that agrees with the
    first label confirms it; an unsure first label gives way to neighbours that
    are not mixed; otherwise the text decides, that is its keywords, or the
    first label where it has none.
    """
    first, sure = F.col(initial), F.col(confidence)
    vote, share = F.col("neighbour_label"), F.col("neighbour_share")
    has_keyword = F.col(kw_a) | F.col(kw_b)
    keyword_label = combined_label(F.col(kw_a).cast("double"), F.col(kw_b).cast("double"), scheme)
    evidence = (
        F.when(first == vote, "agreement")
        .when((sure < low) & ~F.col("mixed"), "retrieval")
        .when(has_keyword, "text")
        .otherwise("first answer")
    )
    decided = df.withColumn("evidence", evidence)
    by = F.col("evidence")
    return decided.withColumns({
        "final_classification": F.when(by == "retrieval", vote).when(by == "text", keyword_label).otherwise(first),
        "final_confidence": F.when(by == "agreement", F.greatest(sure, share))
        .when(by == "retrieval", share).when(by == "text", F.lit(1.0)).otherwise(sure),
    })
