"""Registered queries on pseudo-labels, routing, votes, trained models and whole runs."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import label_at
from notewright.functions.rules import CANCER_RULES, DIABETES_RULES, rule_votes
from notewright.operators import expand, fuse, neighbours, profile, route, select, tfidf, train, weak
from notewright.plans import runs
from notewright.plans.catalog_split import stratified
from notewright.plans.driver_tables import clinical, documents, notes
from notewright.plans.fixtures import QUESTIONS, SCORED, cases_and_questions, flag_label, scored_notes
from notewright.plans.oracle import clinical as clinical_sql
from notewright.plans.oracle import label as label_sql
from notewright.plans.oracle import LABELLED_NOTES, order_key, pick, quoted, softmax, vote
from notewright.plans.oracle import neighbours as neighbours_sql
from notewright.plans.registry import register, rounded
from notewright.schema import EMBEDDING, ID, LABEL, SOURCE, TEXT
from notewright.session import cut_lineage, scratch_path
from notewright.sources import results

# --- pseudo-labels -----------------------------------------------------------------

_PHASED = f"""{SCORED}, open_rows AS (SELECT *, CASE
    WHEN p_a >= {fv.POSITIVE_AT_LEAST} OR p_b >= {fv.POSITIVE_AT_LEAST} OR (p_a < {fv.NEITHER_BELOW} AND p_b < {fv.NEITHER_BELOW}) THEN '{fv.SOURCE_MODEL}'
    WHEN kw_a OR kw_b THEN '{fv.SOURCE_RULES}'
    WHEN p_a < {fv.RELAXED_NEITHER_BELOW} AND p_b < {fv.RELAXED_NEITHER_BELOW} THEN '{fv.SOURCE_NEITHER}' END AS source
    FROM scored WHERE test_set = 0 AND has_cancer IS NULL AND has_diabetes IS NULL),
  filled AS (SELECT patient_identifier, source,
    CASE source WHEN '{fv.SOURCE_MODEL}' THEN CAST(p_a >= {fv.POSITIVE_AT_LEAST} AS DOUBLE) WHEN '{fv.SOURCE_RULES}' THEN CAST(kw_a AS DOUBLE) ELSE 0.0 END AS fa,
    CASE source WHEN '{fv.SOURCE_MODEL}' THEN CAST(p_b >= {fv.POSITIVE_AT_LEAST} AS DOUBLE) WHEN '{fv.SOURCE_RULES}' THEN CAST(kw_b AS DOUBLE) ELSE 0.0 END AS fb
    FROM open_rows WHERE source IS NOT NULL),
  phased AS (SELECT patient_identifier, source, fa AS has_cancer, fb AS has_diabetes, {label_sql('fa', 'fb')} AS combined_label FROM filled),
  expanded AS (
    SELECT patient_identifier, '{fv.SOURCE_LABELED}' AS source, has_cancer, has_diabetes, combined_label FROM labelled WHERE embedding IS NOT NULL
    UNION ALL SELECT * FROM phased WHERE source <> '{fv.SOURCE_NEITHER}'
    UNION ALL SELECT * FROM (SELECT * FROM phased WHERE source = '{fv.SOURCE_NEITHER}'
      ORDER BY {order_key('patient_identifier')}, patient_identifier LIMIT {fv.NEITHER_SAMPLE}))"""


def _phased(spark: SparkSession, folder: str) -> DataFrame:
    return expand.assign_phase(select.unlabelled_all(scored_notes(spark, folder)))


def _expanded(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_notes(spark, folder)
    labelled = select.with_label(select.labelled(scored))
    return expand.expand_training_set(labelled, expand.assign_phase(select.unlabelled_all(scored)))


_ROW = [ID, SOURCE, "has_cancer", "has_diabetes", LABEL]


@register(f"WITH {_PHASED} SELECT * FROM phased WHERE source = '{fv.SOURCE_MODEL}'")
def model_phase_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    return expand.model_phase(_phased(spark, folder)).select(*_ROW)


@register(f"WITH {_PHASED} SELECT * FROM phased WHERE source = '{fv.SOURCE_RULES}'")
def rule_phase_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    return expand.rule_phase(_phased(spark, folder)).select(*_ROW)


@register(f"WITH {_PHASED} SELECT * FROM expanded WHERE source = '{fv.SOURCE_NEITHER}'")
def neither_phase_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    return expand.neither_phase(_phased(spark, folder)).select(*_ROW)


@register(f"WITH {_PHASED} SELECT * FROM expanded")
def expanded_set_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _expanded(spark, folder).select(*_ROW)


_SOURCES = (fv.SOURCE_LABELED, fv.SOURCE_MODEL, fv.SOURCE_RULES, fv.SOURCE_NEITHER)


@register(f"WITH {_PHASED} SELECT combined_label, " + ", ".join(
    f"count(*) FILTER (source = '{s}') AS {s}" for s in _SOURCES) + " FROM expanded GROUP BY combined_label")
def source_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return profile.crosstab_counts(_expanded(spark, folder), _SOURCES)


@register(f"""WITH {_PHASED} SELECT count(*) FILTER (source = '{fv.SOURCE_LABELED}') AS n_baseline_train, count(*) AS n_semisup_train,
  count(*) FILTER (source <> '{fv.SOURCE_LABELED}') AS n_synthetic,
  round(count(*) FILTER (source = '{fv.SOURCE_LABELED}' AND combined_label = 'Neither') / count(*) FILTER (source = '{fv.SOURCE_LABELED}'), 6)
  AS baseline_neither_pct FROM expanded""")
def training_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.training_metadata(_expanded(spark, folder)))


@register(f"""WITH {_PHASED}, judged AS (SELECT CASE WHEN true_a IS NOT NULL AND true_b IS NOT NULL THEN {label_sql('true_a', 'true_b')} END AS truth,
    {pick(['b0', 'b1', 'b2', 'b3'])} AS baseline FROM scored)
  SELECT truth AS true_label, count(*) AS n, round(avg(CASE WHEN truth = baseline THEN 1.0 ELSE 0.0 END), 6) AS baseline_recall,
  (SELECT count(*) FROM expanded) AS n_semisup_train,
  (SELECT round(avg(CASE WHEN truth = baseline THEN 1.0 ELSE 0.0 END), 6) FROM judged WHERE truth IS NOT NULL) AS baseline
  FROM judged WHERE truth IS NOT NULL GROUP BY truth""")
def routing_document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    known = F.col("true_a").isNotNull() & F.col("true_b").isNotNull()
    routed = route.route(scored_notes(spark, folder)).withColumn("true_label", F.when(known, flag_label("true_a", "true_b")))
    path = scratch_path(spark, "document")
    results.save_document(results.routing_document(routed, _expanded(spark, folder)), path)
    stored = spark.read.schema(
        "overall_accuracy struct<baseline double>, training_metadata struct<n_semisup_train bigint>, "
        "per_class_performance map<string, struct<n bigint, baseline_recall double>>"
    ).json(path)
    rows = stored.select(
        "overall_accuracy.baseline", "training_metadata.n_semisup_train",
        F.explode("per_class_performance").alias("true_label", "s"),
    )
    return rounded(rows.select("true_label", "s.n", "s.baseline_recall", "n_semisup_train", "baseline"))


@register(f"WITH {SCORED} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS classifier, round(max({p}), 6) AS max_probability, round(avg({p}) FILTER ({t} = 1), 6) AS mean_positive,
  round(avg({p}) FILTER ({t} = 0), 6) AS mean_negative, count(*) FILTER ({p} < {fv.RELAXED_NEITHER_BELOW}) AS n_below FROM scored"""
    for name, p, t in (("cancer", "p_a", "has_cancer"), ("diabetes", "p_b", "has_diabetes"))))
def probability_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    scores = {"cancer": ("p_a", "has_cancer"), "diabetes": ("p_b", "has_diabetes")}
    return rounded(profile.probability_diagnostics(scored_notes(spark, folder), scores))


# --- routing -------------------------------------------------------------------------

_ROUTED = f"""{SCORED}, picked AS (SELECT *, {pick(['b0', 'b1', 'b2', 'b3'])} AS b, {pick(['s0', 's1', 's2', 's3'])} AS s,
    greatest(b0, b1, b2, b3) AS pb, greatest(s0, s1, s2, s3) AS ps FROM scored),
  weighed AS (SELECT *, CASE WHEN b = 'Neither' THEN 1.5 ELSE 1.0 END::DOUBLE AS wb, CASE WHEN s <> 'Neither' THEN 2.0 ELSE 1.0 END::DOUBLE AS ws FROM picked),
  voted AS (SELECT *, CASE WHEN pb * wb >= ps * ws THEN b ELSE s END AS winner FROM weighed),
  routed AS (SELECT patient_identifier, text, has_cancer, has_diabetes, {label_sql('has_cancer', 'has_diabetes')} AS true_label,
    CASE WHEN kw_a AND kw_b THEN 'Both' WHEN kw_b THEN 'Diabetes Only' WHEN kw_a THEN 'Cancer Only' WHEN b = s THEN b
      WHEN b = 'Neither' THEN b WHEN s <> 'Neither' THEN s ELSE winner END AS predicted_label,
    CASE WHEN kw_a AND kw_b THEN {quoted(fv.REASON_BOTH_KEYWORDS)} WHEN kw_b THEN {quoted(fv.REASON_DIABETES_KEYWORD)}
      WHEN kw_a THEN {quoted(fv.REASON_CANCER_KEYWORD)} WHEN b = s THEN replace({quoted(fv.REASON_AGREEMENT)}, '%s', b)
      WHEN b = 'Neither' THEN {quoted(fv.REASON_BASELINE)} WHEN s <> 'Neither' THEN {quoted(fv.REASON_SEMISUP)}
      ELSE replace({quoted(fv.REASON_VOTE)}, '%s', winner) END AS decision_reason,
    round(CASE WHEN kw_a OR kw_b THEN 1.0 WHEN b = s THEN (pb + ps) / 2 WHEN b = 'Neither' THEN pb WHEN s <> 'Neither' THEN ps
      ELSE greatest(pb * wb, ps * ws) / (wb + ws) END, 6) AS confidence,
    b AS baseline_pred, round(pb, 6) AS baseline_conf, s AS semisup_pred, round(ps, 6) AS semisup_conf,
    CAST(kw_b AS INTEGER) AS has_diabetes_kw, CAST(kw_a AS INTEGER) AS has_cancer_kw FROM voted)"""


@register(f"WITH {_ROUTED} SELECT * EXCLUDE (text, has_cancer, has_diabetes, true_label) FROM routed")
def route_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = route.route(scored_notes(spark, folder))
    return rounded(df.select(ID, *fv.ROUTING_COLUMNS[5:6], *fv.ROUTING_COLUMNS[7:]))


@register(f"""WITH {_ROUTED} SELECT * EXCLUDE (text), md5(text) AS text_md5, CAST(predicted_label = true_label AS INTEGER) AS correct FROM routed""")
def routing_prediction_table(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "routing")
    df = select.with_label(scored_notes(spark, folder, with_text=True))
    results.save_predictions(results.routing_table(route.route(df)), path)
    return rounded(spark.read.parquet(path).withColumn("text_md5", F.md5(TEXT)).drop(TEXT))


def _vote_sql() -> str:
    thirds = [f"(b{i} * 0.4::DOUBLE + s{i} * 0.4::DOUBLE + (CASE WHEN c = {i} THEN 1.0 ELSE 0.0 END) * 0.2::DOUBLE)" for i in range(4)]
    code = "CASE WHEN kw_a AND kw_b THEN 3 WHEN kw_b THEN 2 WHEN kw_a THEN 1 ELSE 0 END"
    return f"""WITH {SCORED}, coded AS (SELECT *, {code} AS c FROM scored),
      votes AS (SELECT patient_identifier, {', '.join(f'{t} AS v{i}' for i, t in enumerate(thirds))} FROM coded)
      SELECT patient_identifier, {pick(['v0', 'v1', 'v2', 'v3'])} AS vote_label, round(greatest(v0, v1, v2, v3), 6) AS vote_confidence FROM votes"""


@register(_vote_sql())
def soft_vote_on_fixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = scored_notes(spark, folder)
    own = flag_label("has_cancer_kw", "has_diabetes_kw")
    rules = F.array(*[(own == label).cast("double") for label in fv.LABELS])
    voted = route.soft_vote(
        df.withColumn("rule_probs", rules),
        {"logistic": "baseline_probs", "random_forest": "semisup_probs", "semisup": "rule_probs"},
    )
    return rounded(voted.select(ID, "vote_label", "vote_confidence"))


# --- rule votes ------------------------------------------------------------------------

_VOTES = "votes AS MATERIALIZED (SELECT doc_id, " + ", ".join(
    [f"{vote('body', r.vote, r.patterns)} AS d{i}" for i, r in enumerate(DIABETES_RULES)]
    + [f"{vote('body', r.vote, r.patterns)} AS c{i}" for i, r in enumerate(CANCER_RULES)]
) + f" FROM (SELECT doc_id, {clinical_sql('text')} AS body FROM documents))"


def _voted(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), clinical(F.col("text")).alias(TEXT))
    return docs.select(
        ID, rule_votes(F.col(TEXT), DIABETES_RULES).alias("dm"), rule_votes(F.col(TEXT), CANCER_RULES).alias("ca")
    )


def _majority(prefix: str, n: int) -> str:
    positive = " + ".join(f"(CASE WHEN {prefix}{i} = 1 THEN 1 ELSE 0 END)" for i in range(n))
    cast = " + ".join(f"(CASE WHEN {prefix}{i} <> -1 THEN 1 ELSE 0 END)" for i in range(n))
    return f"CASE WHEN ({cast}) > 0 THEN ({positive}) / ({cast}) ELSE 0.5 END"


@register(f"WITH {_VOTES} SELECT doc_id AS patient_identifier, round({_majority('d', 5)}, 6) AS dm, round({_majority('c', 5)}, 6) AS ca FROM votes")
def majority_votes(spark: SparkSession, folder: str) -> DataFrame:
    df = _voted(spark, folder)
    return rounded(df.select(
        ID, weak.majority_probability(F.col("dm")).alias("dm"), weak.majority_probability(F.col("ca")).alias("ca")
    ))


@register(f"""WITH {LABELLED_NOTES}, {_VOTES}, p AS (SELECT doc_id, {_majority('d', 5)} AS dm, {_majority('c', 5)} AS ca FROM votes),
  t AS (SELECT * FROM p JOIN notes ON patient_identifier = doc_id)
  SELECT count(*) AS total, count(*) FILTER (dm = 0.5 AND ca = 0.5) AS no_signal,
  round(count(*) FILTER (dm = 0.5 AND ca = 0.5) * 100.0 / count(*), 6) AS no_signal_pct,
  count(*) FILTER (dm > 0.8) AS sure_first, count(*) FILTER (ca > 0.8) AS sure_second,
  round(avg(CASE WHEN CAST(dm >= 0.8 AS INTEGER) = true_b THEN 1.0 WHEN true_b IS NOT NULL THEN 0.0 END), 6) AS accuracy_first,
  round(avg(CASE WHEN CAST(ca >= 0.8 AS INTEGER) = true_a THEN 1.0 WHEN true_a IS NOT NULL THEN 0.0 END), 6) AS accuracy_second FROM t""")
def vote_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    text = clinical(F.col("text"))
    df = notes(spark, folder, features={"dm": rule_votes(text, DIABETES_RULES), "ca": rule_votes(text, CANCER_RULES)}, truth=True)
    scored = df.withColumns({"dm": weak.majority_probability(F.col("dm")), "ca": weak.majority_probability(F.col("ca"))})
    return rounded(weak.vote_diagnostics(scored, ("dm", "true_b"), ("ca", "true_a")))


def _label_model_sql(prefix: str, n: int, epochs: int, digits: int = 5) -> str:
    """The vote model spelled out round by round over the pattern table."""
    names = [f"{prefix}{i}" for i in range(n)]
    start = math.log(0.7 / 0.3)
    parts = [f"patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM votes GROUP BY ALL)",
             "half AS (SELECT sum(n) / 2.0::DOUBLE AS h, " + ", ".join(
                 f"sum(n) FILTER ({x} = {value}) AS seen_{x}_{tag}" for x in names for value, tag in ((1, "p"), (0, "n"))
             ) + " FROM patterns)",
             "odds0 AS (SELECT " + ", ".join(f"{start}::DOUBLE AS {x}_p, {-start}::DOUBLE AS {x}_n" for x in names) + ")"]

    def posterior(odds: str) -> str:
        total = " + ".join(f"CASE WHEN {x} = 1 THEN {odds}.{x}_p WHEN {x} = 0 THEN {odds}.{x}_n ELSE 0 END" for x in names)
        return f"1 / (1 + exp(-({total})))"

    for r in range(1, epochs + 1):
        parts.append(f"post{r} AS MATERIALIZED (SELECT patterns.*, {posterior(f'odds{r - 1}')} AS q FROM patterns, odds{r - 1})")
        cells = []
        for x in names:
            for value, tag in ((1, "p"), (0, "n")):
                up, down = (
                    f"greatest((coalesce(sum(n * {q}) FILTER ({x} = {value}), 0) + {share}::DOUBLE * coalesce(max(seen_{x}_{tag}), 0))"
                    f" / (sum(n * {q}) + max(h)), 1e-9)"
                    for q, share in (("q", 0.7 if value else 0.3), ("(1 - q)", 0.3 if value else 0.7))
                )
                cells.append(f"ln({up} / {down}) AS {x}_{tag}")
        parts.append(f"odds{r} AS MATERIALIZED (SELECT {', '.join(cells)} FROM post{r}, half)")
    return f"""WITH {_VOTES}, {', '.join(parts)} SELECT doc_id AS patient_identifier, round({posterior(f'odds{epochs}')}, {digits}) AS probability
      FROM votes, odds{epochs}"""


# Rounds spelled out in SQL; the fit itself goes on until it settles and agrees by then.
_ROUNDS = 60


@register(_label_model_sql("d", 5, _ROUNDS))
def diabetes_label_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = weak.label_model(_voted(spark, folder), len(DIABETES_RULES), votes="dm")
    return rounded(scored.select(ID, "probability"), 5)


@register(_label_model_sql("c", 5, _ROUNDS))
def cancer_label_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = weak.label_model(_voted(spark, folder), len(CANCER_RULES), votes="ca")
    return rounded(scored.select(ID, "probability"), 5)


def _moments_sql(prefix: str, n: int) -> str:
    """Precisions of rules from triples of agreements."""
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, count(*) AS n, avg(CASE WHEN {prefix}{i} = {prefix}{j} THEN 1.0::DOUBLE ELSE -1.0 END) AS m FROM votes "
        f"WHERE {prefix}{i} <> {fv.ABSTAIN} AND {prefix}{j} <> {fv.ABSTAIN} HAVING count(*) > 0" for i in range(n) for j in range(n) if i != j)
    return f"""moments AS MATERIALIZED ({pairs}),
  edges AS (SELECT a.i AS rule, count(*) AS n_triples, quantile_cont(least(sqrt(abs(a.m * b.m / c.m)), 0.98), 0.5) AS edge
    FROM moments a JOIN moments b ON a.i = b.i AND a.j < b.j JOIN moments c ON c.i = a.j AND c.j = b.j WHERE c.m <> 0 GROUP BY a.i)
  SELECT CAST(r AS INTEGER) AS rule, coalesce(n_triples, 0) AS n_triples, round(coalesce((1 + edge) / 2, 0.7), 6) AS precision
  FROM range({n}) t(r) LEFT JOIN edges ON rule = r"""


@register(f"WITH {_VOTES}, {_moments_sql('d', 5)}")
def diabetes_rule_precisions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(weak.moment_precisions(_voted(spark, folder), len(DIABETES_RULES), votes="dm"))


@register(f"WITH {_VOTES}, {_moments_sql('c', 5)}")
def cancer_rule_precisions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(weak.moment_precisions(_voted(spark, folder), len(CANCER_RULES), votes="ca"))


_SETTLED = 40


@register(f"""SELECT patient_identifier, dm_prob, ca_prob, CAST(dm_prob >= {fv.VOTE_LABEL_THRESHOLD} AS INTEGER) AS dm_label,
  CAST(ca_prob >= {fv.VOTE_LABEL_THRESHOLD} AS INTEGER) AS ca_label FROM
  (SELECT patient_identifier, probability AS dm_prob FROM ({_label_model_sql('d', 5, _SETTLED)}))
  JOIN (SELECT patient_identifier, probability AS ca_prob FROM ({_label_model_sql('c', 5, _SETTLED)})) USING (patient_identifier)""")
def label_model_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Both vote models after the same number of rounds, with the label each probability gives."""
    df = _voted(spark, folder)
    df = weak.label_model(df, len(DIABETES_RULES), votes="dm", probability="dm_prob", epochs=_SETTLED)
    df = weak.label_model(df, len(CANCER_RULES), votes="ca", probability="ca_prob", epochs=_SETTLED)
    return rounded(df.select(
        ID, "dm_prob", "ca_prob",
        weak.vote_label(F.col("dm_prob")).alias("dm_label"), weak.vote_label(F.col("ca_prob")).alias("ca_label"),
    ), 5)


# --- trained models ----------------------------------------------------------------------

@register(f"""WITH {LABELLED_NOTES}, counts AS (SELECT combined_label, count(*) AS n FROM labelled GROUP BY combined_label)
  SELECT combined_label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM counts""")
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    df = select.with_label(select.labelled(notes(spark, folder, features={})))
    return rounded(train.class_weights(df))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with a vector, and all rows with a vector."""
    df = select.with_label(notes(spark, folder, features={}, vectors=True).filter(F.col(EMBEDDING).isNotNull()))
    return select.labelled(df), df


@register()
def flag_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    labelled, everything = _vectors(spark, folder)
    return rounded(train.score_flags(everything, train.fit_flag_models(labelled)).select(ID, "p_a", "p_b"), 4)


def _label_scores(df: DataFrame, name: str) -> DataFrame:
    probs = F.col(f"{name}_probs")
    return rounded(df.select(ID, F.col(f"{name}_pred").alias("predicted_label"), *[probs[i].alias(f"p{i}") for i in range(4)]), 4)


@register()
def label_model_scores_balanced(spark: SparkSession, folder: str) -> DataFrame:
    labelled, everything = _vectors(spark, folder)
    return _label_scores(train.score_labels(everything, train.fit_label_model(labelled), "lr"), "lr")


@register()
def label_model_scores_unbalanced(spark: SparkSession, folder: str) -> DataFrame:
    labelled, everything = _vectors(spark, folder)
    return _label_scores(train.score_labels(everything, train.fit_label_model(labelled, balanced=False), "lr"), "lr")


_NEWTON_STEPS = 12


def _two_entry_newton() -> str:
    """Newton steps from zero for two entries and an intercept, each a system of three by Cramer's rule."""
    names = ("u", "v", "o")
    parts = [f"""{LABELLED_NOTES}, seen AS (SELECT *, embedding[1] AS u, embedding[2] AS v, 1.0::DOUBLE AS o FROM labelled WHERE embedding IS NOT NULL),
  weighed AS (SELECT *, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY has_cancer)) AS w FROM seen),
  b0 AS (SELECT 0.0::DOUBLE AS bu, 0.0::DOUBLE AS bv, 0.0::DOUBLE AS bo)"""]
    for k in range(_NEWTON_STEPS):
        free = {"u": 1.0, "v": 1.0, "o": 0.0}
        gradient = ", ".join(f"sum(w * (p - has_cancer) * {x}) + {free[x]} * any_value(b{x}) AS g{x}" for x in names)
        bend = ", ".join(f"sum(w * p * (1 - p) * {x} * {y}) + {free[x] if x == y else 0.0} AS h{x}{y}"
                         for i, x in enumerate(names) for y in names[i:])

        def det(c: dict[str, tuple[str, str, str]]) -> str:
            (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = c["u"], c["v"], c["o"]
            return f"({a1} * ({b2} * {c3} - {c2} * {b3}) - {b1} * ({a2} * {c3} - {c2} * {a3}) + {c1} * ({a2} * {b3} - {b2} * {a3}))"

        columns = {"u": ("huu", "huv", "huo"), "v": ("huv", "hvv", "hvo"), "o": ("huo", "hvo", "hoo")}
        moves = ", ".join(f"b{x} - {det(columns | {x: ('gu', 'gv', 'go')})} / {det(columns)} AS b{x}" for x in names)
        parts.append(f"""b{k + 1} AS MATERIALIZED (SELECT {moves} FROM (SELECT {gradient}, {bend}, any_value(bu) AS bu, any_value(bv) AS bv, any_value(bo) AS bo
    FROM (SELECT weighed.*, bu, bv, bo, 1 / (1 + exp(-(bu * u + bv * v + bo))) AS p FROM weighed, b{k})))""")
    return ", ".join(parts)


@register(f"""WITH {_two_entry_newton()} SELECT patient_identifier,
  round(1 / (1 + exp(-(bu * embedding[1] + bv * embedding[2] + bo))), 6) AS p_a FROM notes, b{_NEWTON_STEPS} WHERE embedding IS NOT NULL""")
def flag_model_of_two_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The balanced flag model on the first two entries of the vectors, next to Newton steps in SQL."""
    labelled, everything = (df.withColumn(EMBEDDING, F.slice(EMBEDDING, 1, 2)) for df in _vectors(spark, folder))
    model = train.fit_logistic(labelled, "has_cancer", (0.0, 1.0))
    scored = model.transform(everything, (0.0, 1.0), "p")
    return rounded(scored.select(ID, F.col("p")[1].alias("p_a")))


def _optimality(spark: SparkSession, folder: str, balanced: bool) -> DataFrame:
    """The gradient of the penalised loss per class and entry (the intercept last), from the scores of the labelled rows."""
    labelled, _ = _vectors(spark, folder)
    labelled = cut_lineage(labelled.select(ID, LABEL, EMBEDDING))
    fitted = train.fit_label_model(labelled, balanced=balanced, written=True)
    coefficients = fitted.model.coefficientMatrix.toArray()
    scored = train.score_labels(labelled, fitted, "lr")
    counts = {r[LABEL]: r["n"] for r in labelled.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    rows, classes = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    for label, n in counts.items() if balanced else ():
        weight = F.when(F.col(LABEL) == label, rows / (classes * n)).otherwise(weight)
    entries = F.concat(F.transform(EMBEDDING, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    errors = [F.struct(F.lit(label).alias("label"), (F.col("lr_probs")[fv.LABELS.index(label)] - (F.col(LABEL) == label).cast("double")).alias("e"))
              for label in fitted.classes]
    each = scored.select(weight.alias("w"), entries.alias("x"), F.explode(F.array(*errors)).alias("c"))
    sums = each.select("w", "c", F.posexplode("x").alias("entry", "x")).groupBy(F.col("c.label").alias("label"), "entry").agg(
        F.sum(F.col("w") * F.col("c.e") * F.col("x")).alias("s"))
    own = F.coalesce(*[F.when(F.col("label") == label, F.array(*[F.lit(float(v)) for v in [*coefficients[i], 0.0]]))
                       for i, label in enumerate(fitted.classes)])
    return rounded(sums.select("label", "entry", (F.col("s") + F.get(own, F.col("entry")) / fv.LOGISTIC["C"]).alias("gradient")), 4)


_ZERO_GRADIENT = f"""WITH {LABELLED_NOTES}, seen AS (SELECT combined_label, len(embedding) AS d FROM labelled WHERE embedding IS NOT NULL)
  SELECT label, CAST(entry AS INTEGER) AS entry, 0.0::DOUBLE AS gradient FROM (SELECT DISTINCT combined_label AS label FROM seen),
  (SELECT unnest(range(max(d) + 1)) AS entry FROM seen)"""


@register(_ZERO_GRADIENT)
def label_model_gradient_balanced(spark: SparkSession, folder: str) -> DataFrame:
    return _optimality(spark, folder, True)


@register(_ZERO_GRADIENT)
def label_model_gradient_unbalanced(spark: SparkSession, folder: str) -> DataFrame:
    return _optimality(spark, folder, False)


@register()
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    labelled, everything = _vectors(spark, folder)
    return _label_scores(train.score_labels(everything, train.fit_forest(labelled), "rf"), "rf")


# --- text features -------------------------------------------------------------------------

_TERMS = r"""docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
  singles AS (SELECT doc_id, unnest(w) AS term FROM docs),
  pairs AS (SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2])) AS term FROM docs WHERE len(w) > 1),
  terms AS (SELECT * FROM singles UNION ALL SELECT * FROM pairs),
  stats AS (SELECT term, count(DISTINCT doc_id) AS n_notes, count(*) AS n_uses FROM terms GROUP BY term)"""


@register(f"WITH {_TERMS} SELECT * FROM stats")
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return tfidf.term_statistics(documents(spark, folder))


_VOCABULARY = f"""{_TERMS}, size AS (SELECT count(*) AS n FROM documents),
  vocabulary AS (SELECT term, n_notes, n_uses, ln((1.0 + n) / (1.0 + n_notes)) + 1 AS idf FROM stats, size
    WHERE n_notes >= {fv.TFIDF['min_df']} AND n_notes <= {fv.TFIDF['max_df']}::DOUBLE * n
    ORDER BY n_uses DESC, term LIMIT {fv.TFIDF['max_features']})"""


@register(f"WITH {_VOCABULARY} SELECT term, n_notes, n_uses, round(idf, 6) AS idf FROM vocabulary")
def tfidf_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return rounded(tfidf.vocabulary(docs, docs.count()))


@register(f"""WITH {_VOCABULARY}, counts AS (SELECT doc_id, term, count(*) * max(idf) AS x FROM terms JOIN vocabulary USING (term) GROUP BY doc_id, term),
  norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm, count(*) AS n_terms, max(x) AS top FROM counts GROUP BY doc_id)
  SELECT d.doc_id AS patient_identifier, coalesce(n_terms, 0) AS n_terms, round(coalesce(top / norm, 0), 6) AS top_weight
  FROM documents d LEFT JOIN norms n ON n.doc_id = d.doc_id""")
def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), TEXT)
    weights = vector_to_array("tfidf")
    out = tfidf.tfidf_features(docs).select(ID, F.filter(weights, lambda x: x > 0).alias("w"))
    return rounded(out.select(
        ID, F.size("w").cast("long").alias("n_terms"), F.coalesce(F.array_max("w"), F.lit(0.0)).alias("top_weight")
    ))


# --- evidence and whole runs -----------------------------------------------------------------

_FUSED = f"""{QUESTIONS}, {neighbours_sql('asked', 'store', fv.TOP_K)},
  tally AS (SELECT query_id, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (s.combined_label = '{x}') AS n{i}" for i, x in enumerate(fv.LABELS)) + f"""
    FROM hits JOIN store s ON s.patient_identifier = neighbour_id GROUP BY query_id),
  votes AS (SELECT query_id, {pick(['n0', 'n1', 'n2', 'n3'])} AS neighbour_label, greatest(n0, n1, n2, n3) / n AS share,
    greatest(n0, n1, n2, n3) * 2 <= n AS mixed FROM tally)"""


@register(f"""WITH {_FUSED} SELECT query_id, neighbour_label, round(share, 6) AS neighbour_share, CAST(mixed AS INTEGER) AS mixed FROM votes""")
def neighbour_votes(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = cases_and_questions(spark, folder)
    return rounded(fuse.neighbour_vote(neighbours.similarity_search(asked, store)))


@register(f"""WITH {_FUSED}, scored AS (SELECT patient_identifier AS query_id, kw_a, kw_b, {', '.join(f'{e} AS s{i}' for i, e in enumerate(softmax(0)))}
    FROM asked JOIN (SELECT doc_id, {label_sql('1', '1')} AS ignored, regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:thble|ertion)(?:$|[^\\p{{L}}\\p{{N}}_])', 'i') AS kw_a,
      regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:license|apache|nicht)(?:$|[^\\p{{L}}\\p{{N}}_])', 'i') AS kw_b FROM documents) f ON f.doc_id = patient_identifier),
  first AS (SELECT query_id, kw_a, kw_b, {pick(['s0', 's1', 's2', 's3'])} AS initial, greatest(s0, s1, s2, s3) AS conf FROM scored),
  weighed AS (SELECT *, CASE WHEN initial = neighbour_label THEN 'agreement' WHEN conf < 0.6 AND NOT mixed THEN 'retrieval'
    WHEN kw_a OR kw_b THEN 'text' ELSE 'first answer' END AS evidence FROM first JOIN votes USING (query_id))
  SELECT query_id, evidence, CASE evidence WHEN 'retrieval' THEN neighbour_label WHEN 'text' THEN
    {label_sql('CAST(kw_a AS INTEGER)', 'CAST(kw_b AS INTEGER)')} ELSE initial END AS final_classification,
  round(CASE evidence WHEN 'agreement' THEN greatest(conf, share) WHEN 'retrieval' THEN share WHEN 'text' THEN 1.0 ELSE conf END, 6) AS final_confidence
  FROM weighed""")
def fused_evidence(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = cases_and_questions(spark, folder)
    votes = fuse.neighbour_vote(neighbours.similarity_search(asked, store))
    first = scored_notes(spark, folder).select(
        F.col(ID).alias("query_id"), "has_cancer_kw", "has_diabetes_kw",
        label_at(F.col("baseline_probs")).alias("initial_classification"),
        F.array_max("baseline_probs").alias("initial_confidence"),
    )
    fused = fuse.fuse_evidence(votes.join(first, "query_id"))
    return rounded(fused.select("query_id", "evidence", "final_classification", "final_confidence"))


_DECIDED = runs.retrieval_sql()


@register(_DECIDED + " SELECT * FROM decided")
def retrieve_classify_decide(spark: SparkSession, folder: str) -> DataFrame:
    predictions, _ = runs.retrieval_run(spark, folder)
    return rounded(predictions.withColumn("text_md5", F.md5(TEXT)).drop(TEXT))


@register(_DECIDED + " SELECT patient_id, 'classify' AS step, 'a flag in the answer is no number' AS error FROM failed")
def failed_answers(spark: SparkSession, folder: str) -> DataFrame:
    return runs.retrieval_run(spark, folder)[1]


_VALIDATED = runs.retrieval_sql(f"""{LABELLED_NOTES}, {stratified('labelled', 'val', fv.VALIDATION_FRACTION, 'validation', 'train')},
  store AS (SELECT * FROM val WHERE part_val = 'train' AND embedding IS NOT NULL),
  asked AS (SELECT * FROM val WHERE part_val = 'validation' AND embedding IS NOT NULL)""")


@register(_VALIDATED + " SELECT * FROM decided")
def validated_answers(spark: SparkSession, folder: str) -> DataFrame:
    predictions, _ = runs.validation_run(spark, folder)
    return rounded(predictions.withColumn("text_md5", F.md5(TEXT)).drop(TEXT))


@register(_VALIDATED + """ SELECT count(*) AS n, count(*) FILTER (correct = 1) AS n_correct, round(avg(correct), 6) AS accuracy,
  round(avg(correct_cancer), 6) AS accuracy_a, round(avg(correct_diabetes), 6) AS accuracy_b, (SELECT count(*) FROM failed) AS n_failed FROM decided""")
def validation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    predictions, failed = runs.validation_run(spark, folder)
    sums = predictions.agg(
        F.count("*").alias("n"), F.count_if("correct").alias("n_correct"),
        *[F.avg(F.col(c).cast("int")).alias(n) for c, n in (("correct", "accuracy"), ("correct_cancer", "accuracy_a"), ("correct_diabetes", "accuracy_b"))],
    )
    return rounded(sums.withColumn("n_failed", F.lit(failed.count()).cast("long")))


@register(_DECIDED + """ SELECT 'test' AS dataset, patient_id, final_classification FROM decided WHERE patient_id IN (SELECT patient_identifier FROM notes WHERE test_set = 1)
  UNION ALL SELECT 'validation', patient_id, final_classification FROM decided WHERE patient_id NOT IN (SELECT patient_identifier FROM notes WHERE test_set = 1)""")
def retrieval_prediction_tables(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "retrieval")
    predictions, _ = runs.retrieval_run(spark, folder)
    test = select.official_test(notes(spark, folder, features={})).select(F.col(ID).alias("patient_id"))
    results.save_dataset_predictions(predictions.join(test, "patient_id", "left_semi"), path, "test")
    results.save_dataset_predictions(predictions.join(test, "patient_id", "left_anti"), path, "validation")
    return spark.read.parquet(path).select("dataset", "patient_id", "final_classification")


@register(runs.summary_sql())
def text_summary_report(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    predictions, _ = runs.retrieval_run(spark, folder)
    results.save_text_summary(predictions, path, "test")
    report = spark.read.text(path, wholetext=True)
    return report.select(F.md5(F.regexp_replace("value", r"\n\z", "")).alias("report_md5"))


@register()
def trained_routing_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole routing run with trained models: one row per test and validation note."""
    run = runs.routing_run(spark, folder)
    return rounded(run.routed.select(ID, "split", "predicted_label", "decision_reason", "baseline_pred", "semisup_pred"))


@register()
def trained_routing_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the routing run."""
    return rounded(runs.routing_metrics(runs.routing_run(spark, folder)), 4)
