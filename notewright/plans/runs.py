"""The two whole runs: trained routing, and retrieve, classify, decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators import expand, metrics, route, score, select, split, train
from notewright.plans.driver_tables import notes
from notewright.plans.fixtures import QUESTIONS, cases_and_questions, word_flags
from notewright.plans.oracle import label, neighbours
from notewright.schema import EMBEDDING, LABEL, SCHEME, TEXT, LabelScheme
from notewright.session import cut_lineage


@dataclass(frozen=True)
class RoutingRun:
    """What a routing run leaves behind."""

    routed: DataFrame
    expanded: DataFrame
    baseline: train.FittedClassifier
    semisup: train.FittedClassifier


def train_and_route(df: DataFrame, scheme: LabelScheme = SCHEME) -> RoutingRun:
    """Split, grow the training set, fit both models and route every held-out row.

    ``df`` holds notes with a vector and keyword flags ``has_cancer_kw`` and
    ``has_diabetes_kw``; its text is not needed. The split rows are written down
    once, as six passes read them.
    """
    labelled = select.with_label(df, scheme)
    parts = split.split_by_fraction_per_label(labelled, within=select.is_labelled(scheme))
    part = F.when(select.is_official_test(), split.TEST).when(
        F.col(split.SPLIT) == split.TEST, split.VALIDATION
    ).otherwise(F.coalesce(F.col(split.SPLIT), F.lit(split.UNLABELLED)))
    rows = cut_lineage(parts.withColumn(split.SPLIT, part))

    train_rows = rows.filter(F.col(split.SPLIT) == split.TRAIN)
    open_rows = rows.filter(select.is_unlabelled_all(scheme))
    scored = train.score_flags(open_rows, train.fit_flag_models(train_rows, scheme, written=True))
    expanded = cut_lineage(expand.expand_training_set(train_rows, expand.assign_phase(scored, scheme)))

    baseline = train.fit_label_model(train_rows, scheme, written=True)
    semisup = train.fit_label_model(expanded, scheme, written=True)
    held_out = rows.filter(F.col(split.SPLIT).isin(split.VALIDATION, split.TEST))
    scored_rows = train.score_labels(train.score_labels(held_out, baseline, "baseline", scheme), semisup, "semisup", scheme)
    return RoutingRun(route.route(scored_rows, scheme=scheme), expanded, baseline, semisup)


def routing_metrics(run: RoutingRun) -> DataFrame:
    """Metrics of the routed labels on the validation part."""
    validation = run.routed.filter(F.col(split.SPLIT) == split.VALIDATION)
    return metrics.compute_metrics(validation, LABEL, "predicted_label")


def routing_run(spark: SparkSession, folder: str) -> RoutingRun:
    """The routing run on the given tables."""
    df = notes(spark, folder, features=word_flags(F.col("text")), vectors=True)
    return train_and_route(df.filter(F.col(EMBEDDING).isNotNull()))


# --- retrieve, classify, decide on the given tables ---------------------------------------

PROMPTS = score.Prompts(
    first="Label this note:\n{patient_text}\n",
    final=(
        "Cases:\n{retrieval_context}\nFirst: {initial_classification}\nSure: {initial_confidence}\n"
        "Reasoning: {initial_reasoning}\nNote:\n{patient_text}\n"
    ),
)


def first_responder():
    """A stand-in classifier that looks for two letter groups; it garbles notes on licenses."""
    def answer(prompt: str) -> str:
        text = prompt.split("\n", 1)[1]
        a, b = "ertion" in text, "anea" in text
        name = "Both" if a and b else "Cancer Only" if a else "Diabetes Only" if b else "Neither"
        flag_b = "yes" if "License" in text else f"{float(b)}"
        sure = 0.9 if a != b else 0.5
        return (
            f"Classification: {name}\nHas Cancer: {float(a)}\nHas Diabetes: {flag_b}\n"
            f"Confidence: {sure}\nReasoning: letters"
        )

    return lambda prompts: [answer(p) for p in prompts]


def final_responder():
    """A stand-in decider: an unsure first answer gives way to the most frequent retrieved label."""
    def answer(prompt: str) -> str:
        cases, rest = prompt.split("\nFirst: ", 1)
        first, rest = rest.split("\nSure: ", 1)
        sure = float(rest.split("\n", 1)[0])
        if sure < fv.LOW_CONFIDENCE:
            counts = [cases.count(f"  Label: {name}\n") for name in fv.LABELS]
            name, why = fv.LABELS[counts.index(max(counts))], "cases"
            sure = max(counts) / max(1, sum(counts))
        else:
            name, why = first, "first answer"
        a, b = float(name in ("Cancer Only", "Both")), float(name in ("Diabetes Only", "Both"))
        return (
            f"Final Classification: {name}\nHas Cancer: {a}\nHas Diabetes: {b}\n"
            f"Final Confidence: {sure}\nDecision Rationale: {why}"
        )

    return lambda prompts: [answer(p) for p in prompts]


def retrieval_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The retrieval run with stand-in models: labelled notes answer for all other notes with a vector."""
    store, asked = cases_and_questions(spark, folder, with_text=True)
    return score.retrieve_classify_decide(asked, store, PROMPTS, first_responder, final_responder)


def validation_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The retrieval run over the labelled notes held out, with the other labelled ones as the store: truths are known."""
    df = select.with_label(select.labelled(notes(spark, folder, features={TEXT: F.col("text")}, vectors=True)))
    parts = cut_lineage(split.split_stratified_total(df))
    train_rows, held_out = (parts.filter(F.col(split.SPLIT) == part).filter(F.col(EMBEDDING).isNotNull()) for part in (split.TRAIN, split.VALIDATION))
    return score.retrieve_classify_decide(held_out, train_rows, PROMPTS, first_responder, final_responder)


def retrieval_sql(questions: str = QUESTIONS) -> str:
    """CTEs ``decided`` and ``failed``: what the stand-in models make of ``store`` and ``asked``."""
    counts = ", ".join(f"count(*) FILTER (s.combined_label = '{x}') AS n{i}" for i, x in enumerate(fv.LABELS))
    arms = " ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3) THEN '{x}'" for i, x in enumerate(fv.LABELS))
    return f"""WITH {questions}, {neighbours('asked', 'store', fv.TOP_K)},
  tally AS (SELECT query_id, count(*) AS n, {counts} FROM hits JOIN store s ON s.patient_identifier = neighbour_id GROUP BY query_id),
  seen AS (SELECT a.*, contains(text, 'ertion') AS ka, contains(text, 'anea') AS kb, contains(text, 'License') AS broken FROM asked a),
  firsts AS (SELECT *, {label('CAST(ka AS INTEGER)', 'CAST(kb AS INTEGER)')} AS initial, CASE WHEN ka <> kb THEN 0.9 ELSE 0.5 END AS sure FROM seen),
  failed AS (SELECT patient_identifier AS patient_id FROM firsts WHERE broken),
  finals AS (SELECT f.*, CASE WHEN sure < 0.6 THEN (CASE {arms} END) ELSE initial END AS final,
    CASE WHEN sure < 0.6 THEN greatest(n0, n1, n2, n3) / n ELSE sure END AS final_sure
    FROM firsts f JOIN tally ON query_id = patient_identifier WHERE NOT broken),
  flagged AS (SELECT *, CAST(final IN ('Cancer Only', 'Both') AS DOUBLE) AS pa, CAST(final IN ('Diabetes Only', 'Both') AS DOUBLE) AS pb FROM finals),
  decided AS (SELECT patient_identifier AS patient_id, md5(text) AS text_md5, {label('has_cancer', 'has_diabetes')} AS true_label,
    has_cancer AS true_has_cancer, has_diabetes AS true_has_diabetes, initial AS initial_classification, final AS final_classification,
    pa AS pred_has_cancer, pb AS pred_has_diabetes, round(CAST(sure AS DOUBLE), 6) AS initial_confidence, round(final_sure, 6) AS final_confidence,
    CAST(pa = has_cancer AND pb = has_diabetes AS INTEGER) AS correct, CAST(pa = has_cancer AS INTEGER) AS correct_cancer,
    CAST(pb = has_diabetes AS INTEGER) AS correct_diabetes,
    CASE WHEN sure < 0.6 THEN 'cases' ELSE 'first answer' END AS decision_rationale FROM flagged)"""


def summary_sql() -> str:
    """The readable report of the retrieval run, hashed."""
    rule = "=" * 80
    lines = [
        f"'{rule}'", "'RETRIEVAL RUN - TEST SET RESULTS'", f"'{rule}'", "''",
        "'Total predictions: ' || count(*)", "'Correct predictions: ' || count(*) FILTER (correct = 1)",
        "CASE WHEN count(correct) = 0 THEN 'Accuracy: unknown' ELSE printf('Accuracy: %.1f%%', 100 * avg(correct)) END", "''",
        "'Per-class performance:'",
    ]
    for name in fv.LABELS:
        n, hit = f"count(*) FILTER (true_label = '{name}')", f"count(*) FILTER (true_label = '{name}' AND final_classification = '{name}')"
        lines.append(f"CASE WHEN {n} > 0 THEN '  {name:20s}: ' || {hit} || '/' || {n} || printf(' = %.1f%%', {hit} * 100.0::DOUBLE / {n}) END")
    lines += [
        "''", f"'{rule}'", "'Confidence statistics:'", f"'{rule}'",
        "printf('  Average Initial Confidence: %.3f', avg(initial_confidence))",
        "printf('  Average Final Confidence:   %.3f', avg(final_confidence))",
        "''", f"'{rule}'", "'Decision changes:'", f"'{rule}'",
        "'  Cases where final differed from initial: ' || count(*) FILTER (initial_classification <> final_classification) || "
        "printf(' (%.1f%%)', count(*) FILTER (initial_classification <> final_classification) * 100.0::DOUBLE / count(*))",
    ]
    return f"{retrieval_sql()} SELECT md5(concat_ws(chr(10), {', '.join(lines)})) AS report_md5 FROM decided"
