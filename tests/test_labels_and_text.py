"""Label, rule, header, prompt and answer expressions against small Python models."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions import answers, labels, rules
from notewright.functions.text import header_map, preview, prompt_text, render_prompt, retrieval_context, strip

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def rows_of(spark, values, schema="id int, x string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def ask(spark, values, column, schema="id int, x string"):
    rows = rows_of(spark, values, schema).select("id", column.alias("y")).orderBy("id").collect()
    return [r.y for r in rows]


@pytest.mark.parametrize("a, b, expected", [
    (1.0, 1.0, "Both"), (1.0, 0.0, "Cancer Only"), (0.0, 1.0, "Diabetes Only"), (0.0, 0.0, "Neither"),
    (None, None, "Neither"), (None, 1.0, "Diabetes Only"), (1.0, None, "Cancer Only"), (math.nan, 1.0, "Diabetes Only"),
])
def test_combined_label(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(labels.combined_label(F.col("a"), F.col("b"))).first()[0] == expected


def test_clean_flag_turns_nan_to_null(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "a double")
    assert [r[0] for r in df.select(labels.clean_flag(F.col("a"))).collect()] == [1.0, None, None]


def test_agreement_with_unknown_truth(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, math.nan), (1.0, 1.0), (1.0, 0.0)], "p double, t double")
    p, t = F.col("p"), F.col("t")
    assert [r[0] for r in df.select(labels.agrees(p, t)).collect()] == [None, None, True, False]
    assert [r[0] for r in df.select(labels.agrees(p, t, True)).collect()] == [False, False, True, False]


def test_ties_go_to_the_earlier_label(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1],)], "p array<double>")
    assert df.select(labels.label_at(F.col("p"))).first()[0] == "Cancer Only"


@pytest.mark.parametrize("text, cancer, diabetes", [
    ("Metastatic disease", True, False),
    ("type 2 diabetes mellitus", False, True),
    ("TYPE 1DIABETES", False, True),
    ("écancer and cancerous", False, False),
    ("insulin   therapy for a tumor", True, True),
    ("saw the oncologist", True, False),
    ("MDS with\nexcess blasts", True, False),
    ("", False, False),
    (None, False, False),
])
def test_keywords(spark, text, cancer, diabetes):
    df = spark.createDataFrame([(text,)], "x string")
    row = df.select(rules.cancer_keyword(F.col("x")), rules.diabetes_keyword(F.col("x"))).first()
    assert tuple(row) == (cancer, diabetes)


def test_prevalence_is_bounded_on_the_left_only(spark):
    assert ask(spark, ["cancerous", "precancer", "glucoses"], rules.cancer_mention(F.col("x"))) == [True, False, False]
    assert ask(spark, ["hba1c level", "xinsulin"], rules.diabetes_mention(F.col("x"))) == [True, False]


def test_rule_votes(spark):
    text = F.col("x")
    got = ask(spark, [
        "no history of diabetes", "insulin dependent diabetes", "diabetes insipidus, DI", None,
    ], rules.rule_votes(text, rules.DIABETES_RULES))
    assert got == [[-1, -1, -1, 0, -1], [-1, 1, -1, -1, -1], [-1, -1, -1, -1, 0], [-1] * 5]
    got = ask(spark, [
        "history of breast cancer", "history of breast\ncancer", "history of x  y cancer", "LCH, benign",
    ], rules.rule_votes(text, rules.CANCER_RULES))
    assert got == [[-1, -1, 1, -1, -1], [-1] * 5, [-1, -1, 1, -1, -1], [-1, -1, -1, 0, 1]]


def python_headers(text):
    found = {}
    for line in (text or "").split("\n"):
        name, colon, value = line.partition(":")
        if colon and name.strip() and value.strip():
            found[name.strip()] = value.strip()
    return found


LINE = st.text(alphabet="ab: \t é\r", max_size=8)


@FEW
@given(st.lists(st.one_of(st.none(), st.lists(LINE, max_size=6).map("\n".join)), min_size=1, max_size=40))
def test_headers_match_a_dict(spark, texts):
    assert ask(spark, texts, header_map(F.col("x"))) == [python_headers(t) for t in texts]


def test_strip_knows_every_space(spark):
    spaces = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    texts = [spaces + "a b" + spaces[::-1], spaces, "\u200ba", ""]
    assert ask(spark, texts, strip(F.col("x"))) == [t.strip() for t in texts]


def test_headers_of_a_long_note(spark):
    text = "\n".join(f"k{i % 700}: v{i}" for i in range(5000))
    assert ask(spark, [text], header_map(F.col("x"))) == [python_headers(text)]


def python_answer(text, fields, defaults):
    values, error = dict(defaults), text is None
    for line in (text or "").split("\n"):
        line = line.strip()
        for name, prefix, kind in fields:
            if not line.startswith(prefix):
                continue
            value = line.split(":", 1)[1].strip()
            if kind == "text":
                values[name] = value
                continue
            try:
                values[name] = float(value)
            except ValueError:
                error = error or kind == "flag"
                values[name] = defaults[name]
    return values, error


PART = st.sampled_from([
    "Classification: Both", " Classification:Neither ", "Has Cancer: 1.0", "Has Cancer: yes", "Has Diabetes: 1e0",
    "Has Diabetes:", "Confidence: 0.7", "Confidence: high", "Confidence: 1_0", "Confidence: 5d", "Reasoning: a: b",
    "Reasoning:", "note", "classification: Both", "Has Diabetes: .5", "Confidence: +1.", "Confidence: Infinity",
])


@FEW
@given(st.lists(st.one_of(st.none(), st.lists(PART, max_size=7).map("\n".join)), min_size=1, max_size=40))
def test_answers_match_a_line_loop(spark, texts):
    names = [f[0] for f in fv.FIRST_ANSWER_FIELDS]
    defaults = {n: fv.ANSWER_DEFAULTS[n] for n in names}
    df = rows_of(spark, texts).select("id", *answers.parse_first_answer(F.col("x"))).orderBy("id")
    for row, text in zip(df.collect(), texts):
        values, error = python_answer(text, fv.FIRST_ANSWER_FIELDS, defaults)
        assert row.parse_error == error
        if not error:
            assert {n: row[n] for n in names} == values


def test_strict_answers(spark):
    texts = ["Classification: A Classification: B\n Has Cancer: 1.0\nHas Diabetes: 0.0\nKey Evidence: x: y", "Confidence: high"]
    rows = rows_of(spark, texts).select("id", *answers.parse_first_answer_strict(F.col("x"))).orderBy("id").collect()
    assert (rows[0].classification, rows[0].has_cancer, rows[0].has_diabetes) == ("A  B", None, 0.0)
    assert (rows[0].key_evidence, rows[0].raw_response, rows[0].parse_error) == ("x: y", texts[0], False)
    assert (rows[1].classification, rows[1].confidence, rows[1].parse_error) == (None, None, True)


def test_preview_and_prompt_length(spark):
    assert ask(spark, ["abcdef"], preview(F.col("x"), 3)) == ["abc..."]
    assert ask(spark, ["é" * 3000], F.length(prompt_text(F.col("x")))) == [fv.PROMPT_TEXT_CHARS]


def test_render_prompt(spark):
    column = render_prompt("a {x} {{b}} {y}", {"x": F.col("x"), "y": F.lit(1.0)})
    assert ask(spark, ["t", None], column) == ["a t {b} 1.0", "a None {b} 1.0"]


def test_retrieval_context(spark):
    df = spark.createDataFrame(
        [([(0.98765, "Both", 1.0, 1.0, "t" * 250), (0.5, "Neither", 0.0, 0.0, "u")],)],
        "c array<struct<similarity_score double, combined_label string, has_cancer double, has_diabetes double, text string>>",
    )
    lines = df.select(retrieval_context(F.col("c"))).first()[0].split("\n")
    assert lines == [
        "Similar Case 1 (Similarity: 0.988):", "  Label: Both", "  Has Cancer: 1.0", "  Has Diabetes: 1.0",
        "  Text snippet: " + "t" * 200 + "...", "",
        "Similar Case 2 (Similarity: 0.500):", "  Label: Neither", "  Has Cancer: 0.0", "  Has Diabetes: 0.0",
        "  Text snippet: u...", "",
    ]
