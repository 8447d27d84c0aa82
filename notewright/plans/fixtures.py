"""Predictions and scores derived from the given tables, with their SQL twins.

These stand in for model output when an operator that takes scores or
predictions is checked; they are not trained models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.labels import combined_label, label_at
from notewright.functions.rules import matches_any
from notewright.operators import select
from notewright.operators.compare import align_predictions
from notewright.operators.neighbours import similarity_search
from notewright.plans.driver_tables import logistic_score, notes, softmax_scores
from notewright.plans.oracle import LABELLED_NOTES, NOTES, label, logistic, matches, neighbours, pick, softmax
from notewright.schema import EMBEDDING, ID, LABEL, TEXT

WORDS_A = (r"\bthble\b", r"\bertion\b")
WORDS_B = (r"\blicense\b", r"\bapache\b", r"\bnicht\b")
PREFIXES_A = (r"\bthble", r"\bertion")
PREFIXES_B = (r"\blicense", r"\bapache", r"\bnicht")


def word_flags(text: Column) -> dict[str, Column]:
    return {"has_cancer_kw": matches_any(text, WORDS_A), "has_diabetes_kw": matches_any(text, WORDS_B)}


def flag_label(a: str, b: str) -> Column:
    return combined_label(F.col(a).cast("double"), F.col(b).cast("double"))


def scored_notes(spark: SparkSession, folder: str, with_text: bool = False) -> DataFrame:
    """Notes with a vector, keyword flags, and class and flag scores read off the vector."""
    text = F.col("text")
    features = word_flags(text) | ({TEXT: text} if with_text else {})
    df = notes(spark, folder, features=features, vectors=True, truth=True).filter(F.col(EMBEDDING).isNotNull())
    vector = F.col(EMBEDDING)
    return df.withColumns({
        "baseline_probs": softmax_scores(vector, 0),
        "semisup_probs": softmax_scores(vector, 4),
        "p_a": logistic_score(vector, 0),
        "p_b": logistic_score(vector, 1),
    })


_FLAGS_SQL = f"""flags AS (
  SELECT doc_id, {matches("coalesce(text, '')", WORDS_A)} AS kw_a, {matches("coalesce(text, '')", WORDS_B)} AS kw_b
  FROM documents)"""

SCORED = f"""{LABELLED_NOTES}, {_FLAGS_SQL}, scored AS (
  SELECT n.*, kw_a, kw_b, {logistic(0)} AS p_a, {logistic(1)} AS p_b,
    {', '.join(f'{e} AS b{i}' for i, e in enumerate(softmax(0)))},
    {', '.join(f'{e} AS s{i}' for i, e in enumerate(softmax(4)))}
  FROM notes n JOIN flags f ON f.doc_id = n.patient_identifier WHERE embedding IS NOT NULL)"""


def judged_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a first and a final label, confidences, and its truth where known."""
    text = F.col("text")
    features = word_flags(text) | {
        "_ma": matches_any(text, PREFIXES_A), "_mb": matches_any(text, PREFIXES_B),
        "initial_confidence": F.when(F.col("lang") == "es", F.lit(None).cast("double"))
        .when(F.col("lang") == "de", 0.0).otherwise(F.length("text") / (F.length("text") + 1000.0)),
    }
    df = notes(spark, folder, features=features, truth=True)
    known = F.col("true_a").isNotNull() & F.col("true_b").isNotNull()
    return df.select(
        F.col(ID).alias("patient_id"),
        F.when(known, combined_label(F.col("true_a"), F.col("true_b"))).alias("true_label"),
        F.col("true_a").alias("true_has_cancer"),
        F.col("true_b").alias("true_has_diabetes"),
        flag_label("_ma", "_mb").alias("initial_classification"),
        flag_label("has_cancer_kw", "has_diabetes_kw").alias("final_classification"),
        F.col("has_cancer_kw").cast("double").alias("pred_has_cancer"),
        F.col("has_diabetes_kw").cast("double").alias("pred_has_diabetes"),
        "initial_confidence",
        F.when(F.col("has_cancer_kw") | F.col("has_diabetes_kw"), 1.0).otherwise(0.5).alias("final_confidence"),
    )


JUDGED = f"""{NOTES}, {_FLAGS_SQL}, loose AS (
  SELECT doc_id, lang, {matches("coalesce(text, '')", PREFIXES_A)} AS ma, {matches("coalesce(text, '')", PREFIXES_B)} AS mb
  FROM documents), judged_notes AS (
  SELECT patient_identifier AS patient_id,
    CASE WHEN true_a IS NOT NULL AND true_b IS NOT NULL THEN {label('true_a', 'true_b')} END AS true_label,
    true_a AS true_has_cancer, true_b AS true_has_diabetes,
    {label('CAST(ma AS INTEGER)', 'CAST(mb AS INTEGER)')} AS initial_classification,
    {label('CAST(kw_a AS INTEGER)', 'CAST(kw_b AS INTEGER)')} AS final_classification,
    CAST(kw_a AS DOUBLE) AS pred_has_cancer, CAST(kw_b AS DOUBLE) AS pred_has_diabetes,
    CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN 0.0 ELSE length(text) / (length(text) + 1000.0) END AS initial_confidence,
    CASE WHEN kw_a OR kw_b THEN 1.0 ELSE 0.5 END AS final_confidence
  FROM notes JOIN flags f ON f.doc_id = patient_identifier JOIN loose l ON l.doc_id = patient_identifier)"""


def keyword_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """First model of the comparison: the keyword label of every document."""
    text = F.col("text")
    df = notes(spark, folder, features=word_flags(text) | {TEXT: text}, vectors=True)
    hit = F.col("has_cancer_kw") | F.col("has_diabetes_kw")
    best = F.array_max(softmax_scores(F.col(EMBEDDING), 0))
    return df.select(
        ID, TEXT,
        flag_label("has_cancer_kw", "has_diabetes_kw").alias("predicted_label"),
        F.when(hit, 1.0).otherwise(F.coalesce(best, F.lit(0.5))).alias("confidence"),
    )


def cases_and_questions(spark: SparkSession, folder: str, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labelled notes with a vector as the store, all other notes with a vector as questions."""
    text = {TEXT: F.col("text")} if with_text else {TEXT: F.lit("")}
    df = select.with_label(notes(spark, folder, features=text, vectors=True)).filter(F.col(EMBEDDING).isNotNull())
    known = F.coalesce(select.is_labelled(), F.lit(False))
    return df.filter(known), df.filter(~known)


def neighbour_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Second model of the comparison: the label of the nearest stored case."""
    store, asked = cases_and_questions(spark, folder)
    near = similarity_search(asked, store, k=1)
    first = asked.select(F.col(ID).alias("query_id"), label_at(softmax_scores(F.col(EMBEDDING), 4)).alias("initial_classification"))
    return near.join(first, "query_id").select(
        F.col("query_id").alias("patient_id"),
        F.col(LABEL).alias("final_classification"),
        F.col("has_cancer").alias("pred_has_cancer"),
        F.col("has_diabetes").alias("pred_has_diabetes"),
        F.col("similarity_score").alias("final_confidence"),
        "initial_classification",
        F.concat(F.lit("nearest case "), F.col("patient_id")).alias("decision_rationale"),
    )


def aligned_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return align_predictions(keyword_predictions(spark, folder), neighbour_predictions(spark, folder))


QUESTIONS = f"""{LABELLED_NOTES}, store AS (SELECT * FROM labelled WHERE embedding IS NOT NULL),
  asked AS (SELECT * FROM notes WHERE embedding IS NOT NULL
    AND patient_identifier NOT IN (SELECT patient_identifier FROM labelled))"""

ALIGNED = f"""{QUESTIONS}, {_FLAGS_SQL}, {neighbours('asked', 'store', 1)}, routed AS (
  SELECT patient_identifier AS patient_id, text,
    {label('CAST(kw_a AS INTEGER)', 'CAST(kw_b AS INTEGER)')} AS baseline_prediction,
    CASE WHEN kw_a OR kw_b THEN 1.0 WHEN embedding IS NULL THEN 0.5 ELSE greatest({', '.join(softmax(0))}) END AS baseline_confidence
  FROM notes JOIN flags f ON f.doc_id = patient_identifier),
  firsts AS (SELECT patient_identifier, {', '.join(f'{e} AS s{i}' for i, e in enumerate(softmax(4)))} FROM asked),
  retrieved AS (SELECT query_id AS patient_id, s.combined_label AS llm_prediction, s.has_cancer AS pred_has_cancer,
    s.has_diabetes AS pred_has_diabetes, (1 + cosine) / 2 AS llm_confidence,
    {pick(['s0', 's1', 's2', 's3'])} AS initial_classification, 'nearest case ' || neighbour_id AS decision_rationale
    FROM hits JOIN store s ON s.patient_identifier = neighbour_id JOIN firsts f ON f.patient_identifier = query_id),
  aligned AS (SELECT * FROM routed JOIN retrieved USING (patient_id))"""
