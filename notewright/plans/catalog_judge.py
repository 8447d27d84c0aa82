"""Registered queries on metrics and on comparing predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import label_at
from notewright.operators import compare, metrics
from notewright.plans.fixtures import ALIGNED, JUDGED, SCORED, aligned_predictions, judged_notes, scored_notes
from notewright.plans.fixtures import flag_label, keyword_predictions, neighbour_predictions
from notewright.plans.oracle import label as label_sql
from notewright.plans.oracle import long_rows, metric_rows, pick
from notewright.plans.registry import register, rounded
from notewright.session import scratch_path
from notewright.sources import results

_PAIRS = f"{JUDGED}, pairs AS (SELECT true_label AS truth, final_classification AS predicted FROM judged_notes)"
_SCORES = ["precision", "recall", "f1", "support"]
_AVERAGES = [f"{k}_{m}" for k in ("macro", "weighted") for m in ("precision", "recall", "f1")]
T, P = "true_label", "final_classification"


# --- metrics ---------------------------------------------------------------------

@register(f"WITH {_PAIRS}, {metric_rows('pairs', fv.LABELS)} SELECT (SELECT count(*) FROM judged) AS n_judged, round(accuracy, 6) AS accuracy FROM overall")
def accuracy_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.accuracy(judged_notes(spark, folder), T, P))


_CORRECT = f"""{JUDGED}, flagged AS (SELECT *, pred_has_cancer = true_has_cancer AS correct_cancer,
  pred_has_diabetes = true_has_diabetes AS correct_diabetes FROM judged_notes),
  checked AS (SELECT *, correct_cancer AND correct_diabetes AS correct FROM flagged)"""


@register(f"""WITH {_CORRECT} SELECT patient_id, CAST(correct_cancer AS INTEGER) AS correct_cancer,
  CAST(correct_diabetes AS INTEGER) AS correct_diabetes, CAST(correct AS INTEGER) AS correct FROM checked""")
def correctness_flags(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.with_correctness(judged_notes(spark, folder))
    return rounded(df.select("patient_id", "correct_cancer", "correct_diabetes", "correct"))


@register(f"""WITH {_CORRECT} SELECT patient_id, CAST(coalesce(correct_cancer, false) AND coalesce(correct_diabetes, false) AS INTEGER) AS correct FROM checked""")
def correctness_flags_null_as_wrong(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.with_correctness(judged_notes(spark, folder), null_as_wrong=True)
    return rounded(df.select("patient_id", "correct"))


@register(f"WITH {_CORRECT} SELECT count(correct) AS n_judged, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM checked")
def accuracy_by_flags(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.flag_accuracy(metrics.with_correctness(judged_notes(spark, folder))))


_METRICS_SQL = f"""WITH {_PAIRS}, {metric_rows('pairs', fv.LABELS)}
  {long_rows('overall', "'overall'", ['accuracy'])} UNION ALL {long_rows('averages', "'overall'", _AVERAGES)}
  UNION ALL {long_rows('per_class', 'label', _SCORES)}"""


@register(_METRICS_SQL)
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.compute_metrics(judged_notes(spark, folder), T, P))


@register(_METRICS_SQL)
def metrics_json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    results.save_metrics_json(metrics.compute_metrics(judged_notes(spark, folder), T, P), path)
    return rounded(spark.read.schema("scope string, metric string, value double").json(path))


def _report_sql(source: str, labels) -> str:
    """Rows of a classification report over ``source(truth, predicted)``."""
    averages = " UNION ALL ".join(
        long_rows("averages", f"'{kind} avg'", [f"{kind}_{m}" for m in ("precision", "recall", "f1")] + ["support"], _SCORES)
        for kind in ("macro", "weighted")
    )
    return f"{long_rows('per_class', 'label', _SCORES)} UNION ALL {long_rows('overall', chr(39) + 'accuracy' + chr(39), ['accuracy'])} UNION ALL {averages}"


@register(f"WITH {_PAIRS}, {metric_rows('pairs', None)} {_report_sql('pairs', None)}")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.classification_report(judged_notes(spark, folder), T, P))


@register(f"""WITH {_PAIRS}, labels_listed AS (SELECT unnest(['Neither', 'Cancer Only', 'Diabetes Only', 'Both']) AS l)
  SELECT t.l AS true_label, p.l AS predicted_label, (SELECT count(*) FROM pairs WHERE truth = t.l AND predicted = p.l) AS n
  FROM labels_listed t, labels_listed p""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(judged_notes(spark, folder), T, P)


@register(f"WITH {_PAIRS} SELECT count(*) FILTER (predicted NOT IN ('Neither', 'Both')) AS unknown_label FROM pairs")
def labels_outside_list(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.unknown_labels(judged_notes(spark, folder), P, ("Neither", "Both"))


@register(f"""WITH {_PAIRS} SELECT truth AS true_label, count(*) AS n, count(*) FILTER (truth = predicted) AS correct,
  round(count(*) FILTER (truth = predicted) / count(*), 6) AS recall FROM pairs WHERE truth IS NOT NULL GROUP BY truth""")
def class_recall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.class_recall(judged_notes(spark, folder), T, P))


_MODELS = f"""{SCORED}, models AS (SELECT
    CASE WHEN true_a IS NOT NULL AND true_b IS NOT NULL THEN {label_sql('true_a', 'true_b')} END AS truth,
    {pick(['b0', 'b1', 'b2', 'b3'])} AS baseline, {pick(['s0', 's1', 's2', 's3'])} AS semisup,
    {label_sql('CAST(kw_a AS INTEGER)', 'CAST(kw_b AS INTEGER)')} AS ensemble FROM scored)"""
MODELS = {"baseline": "baseline_pred", "semisup": "semisup_pred", "ensemble": "ensemble_pred"}


def _three_models(spark: SparkSession, folder: str) -> DataFrame:
    df = scored_notes(spark, folder)
    known = F.col("true_a").isNotNull() & F.col("true_b").isNotNull()
    return df.select(
        F.when(known, flag_label("true_a", "true_b")).alias(T),
        label_at(F.col("baseline_probs")).alias("baseline_pred"),
        label_at(F.col("semisup_probs")).alias("semisup_pred"),
        flag_label("has_cancer_kw", "has_diabetes_kw").alias("ensemble_pred"),
    )


@register(f"WITH {_MODELS} SELECT truth AS true_label, count(*) AS n, " + ", ".join(
    f"round(avg(CASE WHEN {m} = truth THEN 1.0 ELSE 0.0 END), 6) AS {m}_recall" for m in MODELS)
    + " FROM models WHERE truth IS NOT NULL GROUP BY truth")
def model_recalls(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.model_recall_table(_three_models(spark, folder), T, MODELS))


@register(f"WITH {_MODELS}, means AS (SELECT " + ", ".join(
    f"avg(CASE WHEN {m} = truth THEN 1.0 ELSE 0.0 END) AS {m}" for m in MODELS)
    + " FROM models WHERE truth IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{m}' AS model, round({m}, 6) AS accuracy, round(({m} - baseline) * 100, 6) AS points_over_base FROM means" for m in MODELS))
def model_accuracies(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.model_accuracy_table(_three_models(spark, folder), T, MODELS, base="baseline"))


@register(f"""WITH {JUDGED} SELECT round(avg(initial_confidence), 6) AS avg_initial_confidence,
  round(avg(final_confidence), 6) AS avg_final_confidence FROM judged_notes""")
def confidence_means(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.confidence_summary(judged_notes(spark, folder)))


@register(f"""WITH {JUDGED} SELECT round(avg(nullif(initial_confidence, 0)), 6) AS avg_initial_confidence,
  round(avg(nullif(final_confidence, 0)), 6) AS avg_final_confidence FROM judged_notes""")
def confidence_means_without_zeros(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.confidence_summary(judged_notes(spark, folder), skip_zero=True))


_CHANGED = "initial_classification IS DISTINCT FROM final_classification"


@register(f"""WITH {JUDGED} SELECT count(*) AS total_cases, count(*) FILTER ({_CHANGED}) AS cases_changed,
  round(count(*) FILTER ({_CHANGED}) * 100.0 / count(*), 6) AS changed_pct FROM judged_notes""")
def cases_changed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.cases_changed(judged_notes(spark, folder)))


@register(f"WITH {JUDGED} SELECT patient_id, initial_classification, final_classification FROM judged_notes WHERE {_CHANGED}")
def changed_cases(spark: SparkSession, folder: str) -> DataFrame:
    df = metrics.changed_cases(judged_notes(spark, folder))
    return df.select("patient_id", "initial_classification", "final_classification")


@register(f"""WITH {JUDGED} SELECT round(avg(CASE WHEN initial_classification = true_label THEN 1.0 ELSE 0.0 END), 6) AS initial_accuracy,
  round(avg(CASE WHEN final_classification = true_label THEN 1.0 ELSE 0.0 END), 6) AS final_accuracy,
  count(*) FILTER (final_classification = true_label) - count(*) FILTER (initial_classification = true_label) AS improvement
  FROM judged_notes WHERE true_label IS NOT NULL""")
def improvement_over_first(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.improvement(judged_notes(spark, folder)))


def _flag_sql(truth: str, predicted: str, name: str) -> str:
    as_text = "CASE WHEN {0} = 1 THEN '1' WHEN {0} = 0 THEN '0' END"
    confusion = " UNION ALL ".join(
        f"SELECT 'confusion' AS scope, '{t}->{p}' AS metric, CAST(count(*) FILTER (truth = '{t}' AND predicted = '{p}') AS DOUBLE) AS value FROM pairs"
        for t in "01" for p in "01"
    )
    return f"""SELECT '{name}' AS flag, * FROM (WITH {JUDGED}, pairs AS (SELECT {as_text.format(truth)} AS truth,
      {as_text.format(predicted)} AS predicted FROM judged_notes), {metric_rows('pairs', ('0', '1'))}
      {_report_sql('pairs', ('0', '1'))} UNION ALL {confusion})"""


@register(_flag_sql("true_has_cancer", "pred_has_cancer", "cancer") + " UNION ALL "
          + _flag_sql("true_has_diabetes", "pred_has_diabetes", "diabetes"))
def flag_reports(spark: SparkSession, folder: str) -> DataFrame:
    df = judged_notes(spark, folder)
    first = metrics.flag_report(df, "true_has_cancer", "pred_has_cancer", "cancer")
    return rounded(first.unionByName(metrics.flag_report(df, "true_has_diabetes", "pred_has_diabetes", "diabetes")))


@register(f"""WITH {_CORRECT} SELECT true_label, count(*) AS n, count(*) FILTER (correct) AS n_correct,
  round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM checked GROUP BY true_label""")
def performance_by_true_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.performance_by_label(metrics.with_correctness(judged_notes(spark, folder))))


# --- comparison of two models ------------------------------------------------------

_SAME = "baseline_prediction = llm_prediction"


@register(f"""WITH {ALIGNED} SELECT patient_id, md5(text) AS text_md5, baseline_prediction, round(baseline_confidence, 6) AS baseline_confidence,
  llm_prediction, pred_has_cancer, pred_has_diabetes, round(llm_confidence, 6) AS llm_confidence, initial_classification, decision_rationale FROM aligned""")
def aligned_predictions_table(spark: SparkSession, folder: str) -> DataFrame:
    df = aligned_predictions(spark, folder)
    return rounded(df.withColumn("text_md5", F.md5("text")).drop("text"))


_REPORT = f"""WITH {ALIGNED} SELECT count(*) AS total_cases, count(*) FILTER ({_SAME}) AS agreements,
  count(*) FILTER (NOT {_SAME}) AS disagreements, round(count(*) FILTER ({_SAME}) / count(*), 6) AS agreement_rate,
  count(*) FILTER (NOT {_SAME} AND baseline_confidence > 0.8 AND llm_confidence > 0.8) AS high_confidence_disagreements,
  """ + ", ".join(
    f"""round(avg({m}_confidence), 6) AS {m}_mean, round(stddev_samp({m}_confidence), 6) AS {m}_std,
  round(avg({m}_confidence) FILTER ({_SAME}), 6) AS agreement_{m}_conf,
  round(avg({m}_confidence) FILTER (NOT {_SAME}), 6) AS disagreement_{m}_conf""" for m in ("baseline", "llm")) + " FROM aligned"


@register(_REPORT)
def comparison_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.comparison_summary(aligned_predictions(spark, folder)))


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    return compare.pair_sums(aligned_predictions(spark, folder))


@register(f"""WITH {ALIGNED}, seen AS (SELECT baseline_prediction AS label FROM aligned UNION SELECT llm_prediction FROM aligned),
  shares AS (SELECT label, count(*) FILTER (baseline_prediction = label) * 100.0 / count(*) AS b,
    count(*) FILTER (llm_prediction = label) * 100.0 / count(*) AS l FROM seen, aligned GROUP BY label)
  SELECT label, round(b, 6) AS baseline_pct, round(l, 6) AS llm_pct, round(l - b, 6) AS difference FROM shares""")
def prediction_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.prediction_distribution(_sums(spark, folder)))


@register(f"""WITH {ALIGNED} SELECT count(*) AS total_cases, count(*) FILTER ({_SAME}) AS agreements,
  count(*) FILTER (NOT {_SAME}) AS disagreements, round(count(*) FILTER ({_SAME}) / count(*), 6) AS agreement_rate FROM aligned""")
def disagreement_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.disagreement_summary(_sums(spark, folder)))


@register(f"""WITH {ALIGNED} SELECT baseline_prediction, llm_prediction, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct_of_disagreements FROM aligned WHERE NOT {_SAME} GROUP BY ALL""")
def disagreement_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.disagreement_patterns(_sums(spark, folder)))


@register(f"WITH {ALIGNED} " + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, round(avg({m}_confidence), 6) AS mean, round(quantile_cont({m}_confidence, 0.5), 6) AS median,
  round(stddev_samp({m}_confidence), 6) AS std, round(min({m}_confidence), 6) AS min, round(max({m}_confidence), 6) AS max FROM aligned"""
    for m in ("baseline", "llm")))
def confidence_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.confidence_describe(aligned_predictions(spark, folder)))


@register(f"WITH {ALIGNED} SELECT " + ", ".join(
    f"""round(avg({m}_confidence) FILTER ({_SAME}), 6) AS agreement_{m}_conf,
  round(avg({m}_confidence) FILTER (NOT {_SAME}), 6) AS disagreement_{m}_conf""" for m in ("baseline", "llm")) + " FROM aligned")
def confidence_by_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.confidence_by_agreement(_sums(spark, folder)))


@register(f"WITH {ALIGNED} " + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, {m}_prediction AS label, count(*) AS n, round(avg({m}_confidence), 6) AS avg_confidence
  FROM aligned GROUP BY {m}_prediction""" for m in ("baseline", "llm")))
def confidence_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.confidence_by_class(_sums(spark, folder)))


_STRONG = f"""SELECT patient_id, baseline_prediction, llm_prediction FROM aligned
  WHERE NOT {_SAME} AND baseline_confidence > 0.68 AND llm_confidence > 0.68"""


@register(f"WITH {ALIGNED} {_STRONG}")
def high_confidence_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    df = compare.high_confidence_disagreements(aligned_predictions(spark, folder), 0.68)
    return df.select("patient_id", "baseline_prediction", "llm_prediction")


@register(f"WITH {ALIGNED} {_STRONG} ORDER BY patient_id LIMIT 10")
def first_high_confidence_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    df = compare.high_confidence_disagreements(aligned_predictions(spark, folder), 0.68)
    return compare.first_cases(df.select("patient_id", "baseline_prediction", "llm_prediction"))


@register(f"""WITH {ALIGNED}, strong AS ({_STRONG}) SELECT 'full' AS sink, count(*) AS n, count(DISTINCT patient_id) AS n_ids FROM aligned
  UNION ALL SELECT 'disagreements', count(*), count(DISTINCT patient_id) FROM aligned WHERE NOT {_SAME}
  UNION ALL SELECT 'high_confidence_disagreements', count(*), count(DISTINCT patient_id) FROM strong HAVING count(*) > 0""")
def comparison_sinks(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "comparison")
    names = results.save_comparison(aligned_predictions(spark, folder), path, 0.68)
    out = None
    for name in names:
        part = spark.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("sink"), F.count("*").alias("n"), F.count_distinct("patient_id").alias("n_ids")
        )
        out = part if out is None else out.unionByName(part)
    return out


@register(f"WITH {ALIGNED} SELECT patient_id, baseline_prediction, llm_prediction, round(llm_confidence, 6) AS llm_confidence FROM aligned")
def stored_results_aligned(spark: SparkSession, folder: str) -> DataFrame:
    one, two = scratch_path(spark, "routing"), scratch_path(spark, "retrieval")
    results.save_predictions(keyword_predictions(spark, folder), one, csv=True)
    results.save_predictions(neighbour_predictions(spark, folder), two, csv=True)
    df = compare.align_predictions(*results.load_results(spark, one, two, csv=True))
    return rounded(df.select("patient_id", "baseline_prediction", "llm_prediction", "llm_confidence"))


# --- nested documents -----------------------------------------------------------------

def _read_document(spark: SparkSession, document: DataFrame, schema: str) -> DataFrame:
    path = scratch_path(spark, "document")
    results.save_document(document, path)
    return spark.read.schema(schema).json(path)


_SCORE_STRUCT = "struct<precision double, recall double, f1 double, support bigint>"


@register(f"""WITH {_PAIRS}, {metric_rows('pairs', fv.LABELS)} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support, (SELECT round(accuracy, 6) FROM overall) AS accuracy, (SELECT round(weighted_f1, 6) FROM averages) AS weighted_f1 FROM per_class""")
def metrics_document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    document = results.metrics_document(judged_notes(spark, folder), T, P)
    stored = _read_document(
        spark, document, f"overall struct<accuracy double, weighted_f1 double>, per_class map<string, {_SCORE_STRUCT}>"
    )
    rows = stored.select("overall.*", F.explode("per_class").alias("label", "s"))
    return rounded(rows.select("label", "s.*", "accuracy", "weighted_f1"))


@register(f"""WITH {ALIGNED}, seen AS (SELECT baseline_prediction AS label FROM aligned UNION SELECT llm_prediction FROM aligned)
  SELECT label, round(count(*) FILTER (baseline_prediction = label) * 100.0 / count(*), 6) AS baseline_pct,
  round(count(*) FILTER (llm_prediction = label) * 100.0 / count(*), 6) AS llm_pct, count(*) AS total_cases,
  round(count(*) FILTER ({_SAME}) / count(*), 6) AS agreement_rate FROM seen, aligned GROUP BY label""")
def comparison_document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    document = results.comparison_document(aligned_predictions(spark, folder))
    stored = _read_document(
        spark, document,
        "summary struct<total_cases bigint, agreement_rate double>, "
        "prediction_distribution map<string, struct<baseline_pct double, llm_pct double, difference double>>",
    )
    rows = stored.select("summary.*", F.explode("prediction_distribution").alias("label", "s"))
    return rounded(rows.select("label", "s.baseline_pct", "s.llm_pct", "total_cases", "agreement_rate"))


@register(f"""WITH {JUDGED} SELECT true_label, count(*) AS n, count(*) FILTER (true_label = final_classification) AS correct,
  (SELECT count(*) FROM judged_notes) AS total_cases, (SELECT count(*) FROM judged_notes WHERE {_CHANGED}) AS cases_changed,
  (SELECT round(avg(CASE WHEN true_label = final_classification THEN 1.0 ELSE 0.0 END), 6) FROM judged_notes WHERE true_label IS NOT NULL) AS overall_accuracy
  FROM judged_notes WHERE true_label IS NOT NULL GROUP BY true_label""")
def retrieval_document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    stored = _read_document(
        spark, results.retrieval_document(judged_notes(spark, folder)),
        "totals struct<total_cases bigint, overall_accuracy double, cases_changed bigint>, "
        "per_class_metrics map<string, struct<n bigint, correct bigint, recall double>>",
    )
    rows = stored.select("totals.*", F.explode("per_class_metrics").alias("true_label", "s"))
    return rounded(rows.select("true_label", "s.n", "s.correct", "total_cases", "overall_accuracy", "cases_changed"))
