"""SQL fragments over the given tables, for checking queries with a second engine."""

from __future__ import annotations

from collections.abc import Sequence

from notewright import fixed_values as fv
from notewright.plans.driver_tables import CLINICAL_PHRASES, HEADER_WORDS, TEST_SOURCES

_WORD = r"[^\p{L}\p{N}_]"
_SPACE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NEITHER, ONLY_A, ONLY_B, BOTH = fv.LABELS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def matches(text: str, patterns: Sequence[str]) -> str:
    """Whether any pattern occurs, with word boundaries of all scripts spelled out."""
    spelled = []
    for pattern in patterns:
        if pattern.startswith(r"\b"):
            pattern = rf"(?:^|{_WORD})" + pattern[2:]
        if pattern.endswith(r"\b"):
            pattern = pattern[:-2] + rf"(?:$|{_WORD})"
        pattern = pattern.replace(r"[-\s]", "[-" + _SPACE[1:]).replace(r"\s", _SPACE) if r"[-\s]" in pattern \
            else pattern.replace(r"\s", _SPACE)
        spelled.append(pattern)
    return f"regexp_matches({text}, {quoted('|'.join(spelled))}, 'i')"


def clinical(text: str) -> str:
    for word, phrase in CLINICAL_PHRASES:
        text = f"replace({text}, {quoted(word)}, {quoted(phrase)})"
    return text


def headed(text: str) -> str:
    text = rf"regexp_replace({text}, '(?m)^([\p{{L}}\p{{N}}_]+) ', '\1: ', 'g')"
    for word, header in HEADER_WORDS:
        text = f"regexp_replace({text}, '(?m)^{word}: ', '{header}: ', 'g')"
    return text


def label(a: str, b: str) -> str:
    """The combined label of two flag expressions."""
    return (
        f"CASE WHEN {a} = 1 AND {b} = 1 THEN '{BOTH}' WHEN {a} = 1 THEN '{ONLY_A}' "
        f"WHEN {b} = 1 THEN '{ONLY_B}' ELSE '{NEITHER}' END"
    )


def vote(text: str, value: int, patterns: Sequence[str]) -> str:
    return f"CASE WHEN {matches(text, patterns)} THEN {value} ELSE {fv.ABSTAIN} END"


NOTES = f"""notes AS (
  SELECT d.doc_id AS patient_identifier, coalesce(d.text, '') AS text, d.source AS note_source,
    CASE WHEN d.source IN {any_of(TEST_SOURCES)} THEN 1 ELSE 0 END AS test_set,
    CASE WHEN d.source NOT IN {any_of(TEST_SOURCES)} THEN CAST(l.quality AS DOUBLE) END AS has_cancer,
    CASE WHEN d.source NOT IN {any_of(TEST_SOURCES)} THEN CAST(l.toxic AS DOUBLE) END AS has_diabetes,
    CAST(l.quality AS DOUBLE) AS true_a, CAST(l.toxic AS DOUBLE) AS true_b,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

LABELLED_NOTES = f"""{NOTES}, labelled AS (
  SELECT *, {label('has_cancer', 'has_diabetes')} AS combined_label FROM notes
  WHERE test_set = 0 AND has_cancer IS NOT NULL AND has_diabetes IS NOT NULL)"""

KEYWORDS = f"""words AS (
  SELECT doc_id AS patient_identifier,
    {matches(clinical("coalesce(text, '')"), fv.CANCER_KEYWORDS)} AS kw_a,
    {matches(clinical("coalesce(text, '')"), fv.DIABETES_KEYWORDS)} AS kw_b
  FROM documents)"""


def softmax(first: int) -> list[str]:
    """Four class scores from entries ``first`` to ``first + 3`` of ``embedding``, counted from 0."""
    parts = [f"exp(embedding[{first + i + 1}] * 8)" for i in range(4)]
    whole = " + ".join(parts)
    return [f"{p} / ({whole})" for p in parts]


def logistic(entry: int) -> str:
    return f"1 / (1 + exp(embedding[{entry + 1}] * -8))"


def pick(scores: Sequence[str], values: Sequence[str] = fv.LABELS) -> str:
    """The name of the highest of several columns, the earlier one on a tie."""
    top = f"greatest({', '.join(scores)})"
    arms = " ".join(f"WHEN {s} = {top} THEN {quoted(v)}" for s, v in zip(scores, values))
    return f"CASE {arms} END"


def order_key(id_col: str, seed: int = fv.SEED) -> str:
    return f"md5('{seed}:' || {id_col})"


def neighbours(queries: str, store: str, k: int, query_id: str = "patient_identifier") -> str:
    """A CTE ``hits`` of the k nearest rows of ``store`` for each row of ``queries``."""
    return f"""hits AS (
  SELECT query_id, neighbour_id, cosine, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS rank FROM (
      SELECT q.{query_id} AS query_id, s.{query_id} AS neighbour_id,
        round(list_cosine_similarity(q.embedding, s.embedding), 9) AS cosine
      FROM {queries} q, {store} s WHERE q.embedding IS NOT NULL AND s.embedding IS NOT NULL))
  WHERE rank <= {k})"""


def metric_rows(source: str, labels: Sequence[str] | None, names: str = "metrics") -> str:
    """CTEs ending in ``per_class`` and ``averages`` over ``source(truth, predicted)``."""
    if labels is None:
        listed = f"SELECT truth AS label FROM {source} WHERE truth IS NOT NULL UNION SELECT predicted FROM {source} WHERE truth IS NOT NULL AND predicted IS NOT NULL"
    else:
        listed = "SELECT unnest([" + ", ".join(quoted(x) for x in labels) + "]) AS label"
    return f"""listed AS ({listed}),
  judged AS (SELECT * FROM {source} WHERE truth IS NOT NULL),
  raw AS (SELECT label,
      (SELECT count(*) FROM judged WHERE truth = label) AS support,
      (SELECT count(*) FROM judged WHERE predicted = label) AS predicted,
      (SELECT count(*) FROM judged WHERE predicted = label AND truth = label) AS hits FROM listed),
  per_class AS (SELECT label, support,
      CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
      CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
      CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f1 FROM raw),
  averages AS (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
      sum(precision * support) / sum(support) AS weighted_precision,
      sum(recall * support) / sum(support) AS weighted_recall,
      sum(f1 * support) / sum(support) AS weighted_f1, sum(support) AS support FROM per_class),
  overall AS (SELECT avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM judged)"""


def long_rows(source: str, scope: str, columns: Sequence[str], names: Sequence[str] | None = None) -> str:
    """UNION ALL of (scope, metric, value) rows, one per column."""
    names = names or columns
    return " UNION ALL ".join(
        f"SELECT {scope} AS scope, {quoted(n)} AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM {source}"
        for c, n in zip(columns, names)
    )
