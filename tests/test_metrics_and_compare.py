"""Metrics against published results and small hand-made tables."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from notewright import fixed_values as fv
from notewright.operators import compare, metrics
from notewright.operators.quantiles import exact_quantile

N, C, D, B = fv.LABELS
FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def pairs(spark, counted):
    rows = [(t, p) for t, p, n in counted for _ in range(n)]
    return spark.createDataFrame(rows, "t string, p string")


def as_dict(df):
    return {(r.scope, r.metric): r.value for r in df.collect()}


RETRIEVAL = [(N, N, 6), (C, C, 3), (C, N, 2), (D, D, 2), (B, B, 1)]
ROUTING = [(N, N, 5), (N, C, 1), (C, C, 4), (C, N, 1), (D, D, 2), (B, B, 1)]


@pytest.mark.parametrize("counted, macro, weighted", [(RETRIEVAL, 0.901786, 0.849490), (ROUTING, 0.908333, 0.857143)])
def test_published_scores(spark, counted, macro, weighted):
    df = pairs(spark, counted)
    got = as_dict(metrics.compute_metrics(df, "t", "p"))
    assert got["overall", "accuracy"] == pytest.approx(12 / 14)
    assert got["overall", "macro_f1"] == pytest.approx(macro, abs=1e-6)
    assert got["overall", "weighted_f1"] == pytest.approx(weighted, abs=1e-6)
    report = as_dict(metrics.classification_report(df, "t", "p"))
    assert report["macro avg", "f1"] == pytest.approx(macro, abs=1e-6)
    assert report["weighted avg", "support"] == 14


def test_fixed_and_seen_labels_differ_in_the_macro_average(spark):
    df = pairs(spark, [(N, N, 3), (C, C, 1)])
    assert as_dict(metrics.compute_metrics(df, "t", "p"))["overall", "macro_f1"] == 0.5
    assert as_dict(metrics.classification_report(df, "t", "p"))["macro avg", "f1"] == 1.0


def test_label_outside_the_list(spark):
    df = pairs(spark, [(N, "Unsure", 2), (N, N, 2)])
    report = as_dict(metrics.classification_report(df, "t", "p"))
    assert report["Unsure", "support"] == 0 and report["accuracy", "accuracy"] == 0.5
    cells = {(r.true_label, r.predicted_label): r.n for r in metrics.confusion_matrix(df, "t", "p").collect()}
    assert len(cells) == 16 and sum(cells.values()) == 2
    assert metrics.unknown_labels(df, "p").first()[0] == 2


def python_scores(rows, labels):
    out = {}
    for x in labels:
        hit = sum(t == p == x for t, p in rows)
        said, real = sum(p == x for _, p in rows), sum(t == x for t, _ in rows)
        out[x] = (hit / said if said else 0, hit / real if real else 0, 2 * hit / (said + real) if said + real else 0, real)
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from(fv.LABELS), st.sampled_from([*fv.LABELS, "x"])), min_size=1, max_size=40))
def test_scores_match_counting(spark, rows):
    df = spark.createDataFrame(rows, "t string, p string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.per_class_scores(df, "t", "p").collect()}
    for label, expected in python_scores(rows, fv.LABELS).items():
        assert got[label] == pytest.approx(expected)


def test_rows_without_truth_are_not_judged(spark):
    df = spark.createDataFrame([(None, N), (N, N), (C, N)], "t string, p string")
    assert tuple(metrics.accuracy(df, "t", "p").first()) == (2, 0.5)
    empty = spark.createDataFrame([(None, N)], "t string, p string")
    assert tuple(metrics.accuracy(empty, "t", "p").first()) == (0, None)


def test_three_models_side_by_side(spark):
    df = spark.createDataFrame([(N, N, C), (N, N, N), (C, N, C)], "t string, a string, b string")
    models = {"a": "a", "b": "b"}
    table = {r.true_label: (r.n, r.a_recall, r.b_recall) for r in metrics.model_recall_table(df, "t", models).collect()}
    assert table == {N: (2, 1.0, 0.5), C: (1, 0.0, 1.0)}
    points = {r.model: r.points_over_base for r in metrics.model_accuracy_table(df, "t", models, "a").collect()}
    assert points == {"a": 0.0, "b": 0.0}


ALIGNED = "patient_id long, baseline_prediction string, baseline_confidence double, llm_prediction string, llm_confidence double"


def aligned(spark, rows):
    return spark.createDataFrame(rows, ALIGNED)


def test_agreement_rate_of_the_published_comparison(spark):
    df = aligned(spark, [(i, N, 0.9, N if i < 136 else C, 0.9) for i in range(200)])
    assert tuple(compare.disagreement_summary(compare.pair_sums(df)).first()) == (200, 136, 64, 0.68)


def test_confidence_of_exactly_the_threshold_is_not_high(spark):
    df = aligned(spark, [(1, N, 0.8, C, 0.9), (2, N, 0.81, C, 0.9), (3, N, 0.9, N, 0.9), (4, None, 0.9, C, 0.9)])
    assert {r.patient_id for r in compare.high_confidence_disagreements(df).collect()} == {2, 4}


def test_empty_group_has_no_mean(spark):
    row = compare.confidence_by_agreement(compare.pair_sums(aligned(spark, [(1, N, 0.4, N, 0.6)]))).first()
    assert tuple(row) == (0.4, 0.6, None, None)


def test_repeated_and_one_sided_ids(spark):
    left = spark.createDataFrame([(1, "a", N, 0.5), (1, "b", C, 0.6), (2, "c", N, 0.7)],
                                 "patient_identifier long, text string, predicted_label string, confidence double")
    right = spark.createDataFrame([(1, N, 0.0, 0.0, 0.9, N, "r"), (1, C, 1.0, 0.0, 0.8, C, "s"), (3, N, 0.0, 0.0, 0.1, N, "t")],
                                  "patient_id long, final_classification string, pred_has_cancer double, pred_has_diabetes double,"
                                  "final_confidence double, initial_classification string, decision_rationale string")
    joined = compare.align_predictions(left, right)
    assert joined.count() == 4 and len(joined.columns) == 10


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [0.5] * 1000 + [0.7, 0.9], [i / 998 for i in range(999)],
    [1.0 - 1e-15 * i for i in range(500)] + [0.0], [-5.0, 1e300, 3.0, 3.0, 2.0], [0.1, None, 0.3],
])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0)], "k string, v double").repartition(4)
    known = [v for v in values if v is not None]
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.quantile for r in exact_quantile(df, "k", ("g", "h"), "v", p).collect()}
        assert got["g"] == pytest.approx(float(np.quantile(known, p)), rel=1e-12)
        assert got["h"] == 4.0


def test_empty_tables_give_nulls_not_errors(spark):
    from notewright.operators import profile, weak

    none = spark.createDataFrame([], "true_label string, initial_classification string, final_classification string")
    assert tuple(metrics.cases_changed(none).first()) == (0, 0, None)
    assert tuple(metrics.improvement(none).first()) == (None, None, 0)
    assert metrics.compute_metrics(none, "true_label", "final_classification").count() == 7 + 16
    empty = aligned(spark, [])
    assert compare.comparison_summary(empty).first().agreement_rate is None
    assert compare.disagreement_summary(compare.pair_sums(empty)).count() == 1
    assert compare.confidence_describe(empty).count() == 0
    labelled = spark.createDataFrame([], "combined_label string, source string, a double, b double")
    assert profile.training_metadata(labelled).first().baseline_neither_pct is None
    assert profile.column_coverage(labelled, ["source"]).first().percentage is None
    assert weak.vote_diagnostics(labelled, ("a", "b"), ("b", "a")).first().no_signal_pct is None
