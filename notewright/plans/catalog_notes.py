"""Registered queries on sources, projections and text."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.answers import (
    parse_final_answer,
    parse_first_answer,
    parse_first_answer_strict,
    parse_final_answer_strict,
)
from notewright.functions.labels import combined_label
from notewright.functions.rules import (
    CANCER_RULES,
    DIABETES_RULES,
    cancer_keyword,
    cancer_mention,
    diabetes_keyword,
    diabetes_mention,
    rule_vote,
)
from notewright.functions.text import header_map, preview, prompt_text, render_prompt, text_length
from notewright.operators import profile, select
from notewright.operators.split import first_per_class
from notewright.plans.driver_tables import answer_text, clinical, documents, headed, notes, table
from notewright.plans.oracle import KEYWORDS, LABELLED_NOTES, NOTES
from notewright.plans.oracle import clinical as clinical_sql
from notewright.plans.oracle import headed as headed_sql
from notewright.plans.oracle import label as label_sql
from notewright.plans.oracle import matches, quoted, vote
from notewright.plans.registry import register, rounded
from notewright.schema import EMBEDDING, ID, LABEL, TEST_SET, TEXT
from notewright.session import scratch_path
from notewright.sources.notes import embedding_text, load_notes, parse_embedding_text, write_notes_csv
from notewright.streaming.notes_stream import drain, read_note_stream, with_keyword_flags
from notewright.sources.vectors import (
    build_vector_table,
    load_vector_table,
    newest_per_id,
    read_embeddings,
    write_embeddings,
)


def _md5(name: str = TEXT):
    return F.md5(F.col(name)).alias(f"{name}_md5")


# --- sources -----------------------------------------------------------------

_CSV_ROWS = f"""WITH {NOTES} SELECT patient_identifier, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars,
  has_cancer, has_diabetes, test_set FROM notes"""


def _csv_round_trip(spark: SparkSession, folder: str, split: bool) -> DataFrame:
    path = scratch_path(spark, "notes-csv")
    write_notes_csv(notes(spark, folder), path)
    df = load_notes(spark, path, split=split)
    return df.select(ID, _md5(), F.length(TEXT).alias("n_chars"), "has_cancer", "has_diabetes", TEST_SET)


@register(_CSV_ROWS)
def notes_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _csv_round_trip(spark, folder, split=False)


@register(_CSV_ROWS)
def notes_csv_split_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _csv_round_trip(spark, folder, split=True)


_VECTOR_ROWS = """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
  round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings"""


def _vector_rows(df: DataFrame, vector: str) -> DataFrame:
    return rounded(df.select("vec_id", F.posexplode(vector).alias("pos", "value")))


@register(_VECTOR_ROWS)
def embedding_text_parsing(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    cells = vectors.select("vec_id", embedding_text(F.col("embedding")).alias("cell"))
    return _vector_rows(cells.select("vec_id", parse_embedding_text(F.col("cell")).alias("v")), "v")


@register(_VECTOR_ROWS)
def embeddings_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "embeddings")
    write_embeddings(table(spark, folder, "embeddings"), path, id_col="vec_id")
    return _vector_rows(read_embeddings(spark, path), "embedding")


def _labelled_cases(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(select.labelled(notes(spark, folder, vectors=True)))


_CASES = f"""SELECT patient_identifier, md5(text) AS text_md5,
  has_cancer, has_diabetes, combined_label, CAST(coalesce(len(embedding), -1) AS INTEGER) AS dim FROM labelled"""


def _case_rows(df: DataFrame) -> DataFrame:
    return df.select(ID, _md5(), "has_cancer", "has_diabetes", LABEL, F.coalesce(F.size(EMBEDDING), F.lit(-1)).alias("dim"))


def _table_name(spark: SparkSession) -> tuple[str, str]:
    path = scratch_path(spark, "cases")
    return "cases_" + path.rsplit("-", 1)[1], path


@register(f"WITH {LABELLED_NOTES} {_CASES}")
def vector_table_replaced(spark: SparkSession, folder: str) -> DataFrame:
    name, path = _table_name(spark)
    cases = _labelled_cases(spark, folder)
    build_vector_table(cases, name, path)
    build_vector_table(cases, name, path, drop_existing=True)
    return _case_rows(load_vector_table(spark, name))


@register(f"WITH {LABELLED_NOTES} {_CASES} UNION ALL {_CASES}")
def vector_table_appended(spark: SparkSession, folder: str) -> DataFrame:
    name, path = _table_name(spark)
    cases = _labelled_cases(spark, folder)
    build_vector_table(cases, name, path)
    build_vector_table(cases, name, path, drop_existing=False)
    return _case_rows(load_vector_table(spark, name))


@register(f"WITH {LABELLED_NOTES} {_CASES}")
def vector_table_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    cases = _labelled_cases(spark, folder)
    twice = cases.withColumn("loaded", F.lit(1)).unionByName(cases.withColumn("loaded", F.lit(2)))
    return _case_rows(newest_per_id(twice, "loaded"))


# --- labels, filters, projections ---------------------------------------------

def _flag_notes(spark: SparkSession, folder: str) -> DataFrame:
    return notes(spark, folder, features={})


@register(f"WITH {NOTES} SELECT patient_identifier, test_set, {label_sql('has_cancer', 'has_diabetes')} AS combined_label FROM notes")
def combined_labels(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(_flag_notes(spark, folder)).select(ID, TEST_SET, LABEL)


@register(f"WITH {LABELLED_NOTES} SELECT patient_identifier, has_cancer, has_diabetes, combined_label FROM labelled")
def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = select.with_label(select.labelled(_flag_notes(spark, folder)))
    return df.select(ID, "has_cancer", "has_diabetes", LABEL)


@register(f"WITH {NOTES} SELECT patient_identifier FROM notes WHERE test_set = 0 AND (has_cancer IS NULL OR has_diabetes IS NULL)")
def unlabelled_any_rows(spark: SparkSession, folder: str) -> DataFrame:
    return select.unlabelled_any(_flag_notes(spark, folder)).select(ID)


@register(f"WITH {LABELLED_NOTES} SELECT patient_identifier FROM notes WHERE test_set = 0 AND has_cancer IS NULL "
          "AND has_diabetes IS NULL AND patient_identifier NOT IN (SELECT patient_identifier FROM labelled)")
def unlabelled_all_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = _flag_notes(spark, folder)
    return select.unlabelled_all(df, select.labelled(df), select.official_test(df)).select(ID)


@register(f"WITH {NOTES} SELECT patient_identifier, CAST(length(text) AS INTEGER) AS n_chars FROM notes WHERE test_set = 1")
def official_test_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={"n_chars": F.length("text")})
    return select.official_test(df).select(ID, "n_chars")


@register(f"""WITH {NOTES} SELECT patient_identifier, has_cancer, has_diabetes FROM notes
  WHERE test_set = 0 AND has_cancer IS NOT NULL AND has_diabetes IS NOT NULL AND embedding IS NOT NULL""")
def labelled_complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = select.labelled_complete(notes(spark, folder, features={}, vectors=True))
    return df.select(ID, "has_cancer", "has_diabetes")


@register(f"WITH {NOTES} SELECT patient_identifier, test_set FROM notes WHERE has_cancer IS NULL AND has_diabetes IS NULL")
def rows_without_flags(spark: SparkSession, folder: str) -> DataFrame:
    return select.without_flags(_flag_notes(spark, folder)).select(ID, TEST_SET)


@register(f"""WITH {LABELLED_NOTES} SELECT patient_identifier, combined_label, md5(text) AS text_md5,
  CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(embedding), 5) AS total
  FROM labelled WHERE embedding IS NOT NULL""")
def features_labels_and_text(spark: SparkSession, folder: str) -> DataFrame:
    df = select.features_labels_text(_labelled_cases(spark, folder).filter(F.col(EMBEDDING).isNotNull()))
    entries = vector_to_array("features")
    total = F.aggregate(entries, F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select(ID, LABEL, _md5(), F.size(entries).alias("dim"), total.alias("total")), 5)


@register("SELECT doc_id AS patient_identifier, " + ", ".join(
    f"substring(text, 1, {n}) || '...' AS preview_{n}" for n in (100, 200, 300)) + " FROM documents")
def text_previews(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(F.col("doc_id").alias(ID), *[preview(F.col("text"), n).alias(f"preview_{n}") for n in (100, 200, 300)])


@register(f"""SELECT doc_id AS patient_identifier, md5(substring(text, 1, {fv.PROMPT_TEXT_CHARS})) AS prompt_md5,
  CAST(length(text) AS INTEGER) AS n_chars FROM documents""")
def prompt_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(
        F.col("doc_id").alias(ID), F.md5(prompt_text(F.col("text"))).alias("prompt_md5"),
        text_length(F.col("text")).alias("n_chars"),
    )


@register(f"WITH {LABELLED_NOTES} SELECT patient_identifier, coalesce(combined_label, 'none') AS combined_label, 'labeled' AS source FROM labelled")
def tagged_sources(spark: SparkSession, folder: str) -> DataFrame:
    df = select.with_label(select.labelled(_flag_notes(spark, folder)))
    return select.tag_source(df, fv.SOURCE_LABELED).select(ID, LABEL, "source")


@register(f"""WITH {LABELLED_NOTES}, vectors AS (SELECT vec_id, label FROM embeddings)
  SELECT patient_identifier, combined_label, CAST(label AS INTEGER) AS cluster FROM labelled
  LEFT JOIN vectors ON vec_id = patient_identifier""")
def attached_columns(spark: SparkSession, folder: str) -> DataFrame:
    df = select.with_label(select.labelled(_flag_notes(spark, folder)))
    clusters = table(spark, folder, "embeddings").select(F.col("vec_id").alias(ID), F.col("label").cast("int").alias("cluster"))
    return select.attach(df, clusters).select(ID, LABEL, "cluster")


@register(f"""WITH {LABELLED_NOTES} SELECT patient_identifier, combined_label, 'train' AS part, NULL AS test_set FROM labelled
  UNION ALL SELECT patient_identifier, NULL, 'test', test_set FROM notes WHERE test_set = 1""")
def stacked_parts(spark: SparkSession, folder: str) -> DataFrame:
    df = _flag_notes(spark, folder)
    train = select.with_label(select.labelled(df)).select(ID, LABEL, F.lit("train").alias("part"))
    test = select.official_test(df).select(ID, TEST_SET, F.lit("test").alias("part"))
    return select.union_phases(train, test)


# --- text ----------------------------------------------------------------------

@register(f"WITH {KEYWORDS} SELECT patient_identifier, CAST(kw_a AS INTEGER) AS has_cancer_kw, CAST(kw_b AS INTEGER) AS has_diabetes_kw FROM words")
def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), clinical(F.col("text")).alias(TEXT))
    return rounded(docs.select(
        ID, cancer_keyword(F.col(TEXT)).alias("has_cancer_kw"), diabetes_keyword(F.col(TEXT)).alias("has_diabetes_kw")
    ))


@register(f"WITH {KEYWORDS} SELECT patient_identifier, CAST(kw_a AS INTEGER) AS has_cancer_kw, CAST(kw_b AS INTEGER) AS has_diabetes_kw FROM words")
def streamed_keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The keyword flags of the documents read as a stream of files."""
    schema = table(spark, folder, "documents").schema
    stream = read_note_stream(spark, f"{folder}/documents*.parquet", schema)
    docs = stream.select(F.col("doc_id").alias(ID), clinical(F.col("text")).alias(TEXT))
    path = scratch_path(spark, "stream")
    drain(with_keyword_flags(docs).drop(TEXT), f"{path}/rows", f"{path}/progress")
    return rounded(spark.read.parquet(f"{path}/rows"))


@register(f"""SELECT doc_id AS patient_identifier,
  CAST({matches(clinical_sql('text'), fv.CANCER_PREVALENCE)} AS INTEGER) AS cancer_mention,
  CAST({matches(clinical_sql('text'), fv.DIABETES_PREVALENCE)} AS INTEGER) AS diabetes_mention FROM documents""")
def keyword_mentions(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), clinical(F.col("text")).alias(TEXT))
    return rounded(docs.select(
        ID, cancer_mention(F.col(TEXT)).alias("cancer_mention"), diabetes_mention(F.col(TEXT)).alias("diabetes_mention")
    ))


@register("SELECT doc_id AS patient_identifier, " + ", ".join(
    f"{vote(clinical_sql('text'), value, patterns)} AS {name}"
    for name, value, patterns in fv.DIABETES_VOTING_RULES + fv.CANCER_VOTING_RULES) + " FROM documents")
def rule_vote_table(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), clinical(F.col("text")).alias(TEXT))
    return docs.select(
        ID, *[rule_vote(F.col(TEXT), rule).cast("int").alias(rule.name) for rule in DIABETES_RULES + CANCER_RULES]
    )


_TRIM = r"'^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$', '', 'g'"
_HEADERS = f"""lines AS (
    SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
      generate_subscripts(string_split(body, chr(10)), 1) AS place
    FROM (SELECT doc_id, {headed_sql('text')} AS body FROM documents)),
  pairs AS (
    SELECT doc_id, place, regexp_replace(split_part(line, ':', 1), {_TRIM}) AS header,
      regexp_replace(substring(line, instr(line, ':') + 1), {_TRIM}) AS value
    FROM lines WHERE contains(line, ':')),
  headers AS (
    SELECT doc_id, header, arg_max(value, place) AS value FROM pairs
    WHERE header <> '' AND value <> '' GROUP BY doc_id, header)"""


def _headed_notes(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), headed(F.col("text")).alias(TEXT))
    return docs.select(ID, header_map(F.col(TEXT)).alias("headers"))


@register(f"WITH {_HEADERS} SELECT doc_id AS patient_identifier, header, md5(value) AS value_md5 FROM headers")
def parsed_headers(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.header_rows(_headed_notes(spark, folder))
    return rows.select(ID, "header", F.md5("value").alias("value_md5"))


_WIDE = ", ".join(
    f"max(CASE WHEN header = {quoted(h)} THEN value END) AS \"{h}\"" for h in fv.NOTE_HEADERS
)


@register(f"WITH {_HEADERS} SELECT d.doc_id AS patient_identifier, {_WIDE} FROM documents d LEFT JOIN headers h ON h.doc_id = d.doc_id GROUP BY d.doc_id")
def widened_headers(spark: SparkSession, folder: str) -> DataFrame:
    return profile.widen_headers(_headed_notes(spark, folder))


@register(f"""WITH {_HEADERS}, wide AS (SELECT d.doc_id, {_WIDE} FROM documents d LEFT JOIN headers h ON h.doc_id = d.doc_id GROUP BY d.doc_id)
  SELECT doc_id AS patient_identifier, "Age", coalesce("Gender", "Sex") AS "Gender" FROM wide""")
def merged_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    wide = profile.widen_headers(_headed_notes(spark, folder), names=("Age", "Gender", "Sex"))
    return select.merge_synonym_columns(wide)


@register(f"""WITH {_HEADERS} SELECT header, count(*) AS n, arg_min(value, doc_id) AS sample_value
  FROM headers GROUP BY header ORDER BY n DESC, header LIMIT 20""")
def header_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return profile.header_coverage(_headed_notes(spark, folder))


@register(f"""WITH {_HEADERS}, wide AS (SELECT d.doc_id, {_WIDE} FROM documents d LEFT JOIN headers h ON h.doc_id = d.doc_id GROUP BY d.doc_id)
  """ + " UNION ALL ".join(
    f"SELECT {quoted(h)} AS \"column\", count(\"{h}\") AS n, round(count(\"{h}\") * 100.0 / count(*), 1) AS percentage FROM wide"
    for h in fv.NOTE_HEADERS))
def column_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return profile.column_coverage(profile.widen_headers(_headed_notes(spark, folder)), fv.NOTE_HEADERS)


TEMPLATE = "Label it: {label}\nSure: {score}\nWhy: {why}\n\n{patient_text}\nEnd"


@register(f"""WITH {NOTES} SELECT patient_identifier, md5('Label it: ' || {label_sql('has_cancer', 'has_diabetes')} || chr(10) || 'Sure: ' ||
  coalesce(CASE WHEN has_cancer = 1 THEN '1.0' WHEN has_cancer = 0 THEN '0.0' END, 'None') || chr(10) || 'Why: N/A' || chr(10) || chr(10) ||
  substring(text, 1, {fv.PROMPT_TEXT_CHARS}) || chr(10) || 'End') AS prompt_md5 FROM notes""")
def rendered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={"cut": prompt_text(F.col("text"))})
    prompt = render_prompt(TEMPLATE, {
        "label": combined_label(F.col("has_cancer"), F.col("has_diabetes")),
        "score": F.col("has_cancer"),
        "why": F.lit(fv.MISSING_REASONING),
        "patient_text": F.col("cut"),
    })
    return df.select(ID, F.md5(prompt).alias("prompt_md5"))


def _answer_sql(fields, strict: bool) -> str:
    """Expected parse of the answers that ``answer_text`` makes, by shape."""
    names = [f[0] for f in fields]
    reason_line = "split_part(text, chr(10), 1)"
    usual = {
        0: "CASE WHEN lang = 'en' THEN 'Both' ELSE 'Cancer Only' END",
        1: "1.0", 2: "CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END", 3: "0.9",
        4: f"regexp_replace({reason_line}, {_TRIM})",
    }
    missing = {0: "NULL", 1: "NULL", 2: "NULL", 3: "NULL", 4: "NULL"} if strict else \
        {0: "'Neither'", 1: "0.0", 2: "0.0", 3: "0.5", 4: "''"}
    shapes = {
        "src1": {**missing, 0: "'Both'"},
        "src2": {**usual, 0: "'Neither'"},
        "src3": missing if strict else usual,
        "src4": {**usual, 3: "NULL" if strict else "0.5"},
        "src5": {**usual, 1: "NULL" if strict else "0.0"},
        "src6": {**usual, 4: "'because: so'"},
        "src7": {**usual, 4: "''"},
        "src8": {**missing, 0: "'Unsure'", 3: "0.5"},
        "src9": missing,
    }
    columns = []
    for i, name in enumerate(names):
        arms = " ".join(f"WHEN source = '{s}' THEN {v[i]}" for s, v in shapes.items())
        value = f"CASE {arms} ELSE {usual[i]} END"
        columns.append(f"CAST({value} AS DOUBLE) AS {name}" if i in (1, 2, 3) else f"{value} AS {name}")
    bad = "('src4', 'src5', 'src9')" if strict else "('src5', 'src9')"
    columns.append(f"CASE WHEN source IN {bad} THEN 1 ELSE 0 END AS parse_error")
    return f"SELECT doc_id AS patient_identifier, {', '.join(columns)} FROM documents"


def _answers(spark: SparkSession, folder: str, fields) -> DataFrame:
    docs = documents(spark, folder)
    return docs.select(F.col("doc_id").alias(ID), answer_text(tuple(f[1] for f in fields)).alias("response"))


@register(_answer_sql(fv.FIRST_ANSWER_FIELDS, strict=False))
def first_answers(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder, fv.FIRST_ANSWER_FIELDS)
    return rounded(df.select(ID, *parse_first_answer(F.col("response"))))


@register(_answer_sql(fv.FINAL_ANSWER_FIELDS, strict=False))
def final_answers(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder, fv.FINAL_ANSWER_FIELDS)
    return rounded(df.select(ID, *parse_final_answer(F.col("response"))))


@register(_answer_sql(fv.FIRST_ANSWER_FIELDS, strict=True).replace(
    " AS parse_error FROM", " AS parse_error, CAST(NULL AS VARCHAR) AS key_evidence FROM"))
def first_answers_strict(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder, fv.FIRST_ANSWER_FIELDS)
    return rounded(df.select(ID, *parse_first_answer_strict(F.col("response")))).drop("raw_response")


@register(_answer_sql(fv.FINAL_ANSWER_FIELDS, strict=True))
def final_answers_strict(spark: SparkSession, folder: str) -> DataFrame:
    df = _answers(spark, folder, fv.FINAL_ANSWER_FIELDS)
    return rounded(df.select(ID, *parse_final_answer_strict(F.col("response")))).drop("raw_response")


# --- profiles --------------------------------------------------------------------

@register(f"""WITH {NOTES} SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS missing_text,
  count(*) FILTER (embedding IS NULL) AS missing_embeddings, count(*) FILTER (text = '') AS empty_text,
  round(avg(length(text)), 6) AS avg_text_length,
  count(*) FILTER (has_cancer IS NOT NULL AND has_diabetes IS NOT NULL) AS labeled_records,
  count(*) FILTER (has_cancer IS NULL OR has_diabetes IS NULL) AS unlabeled_records FROM notes""")
def data_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.data_quality(notes(spark, folder, vectors=True)))


@register(f"""WITH {NOTES}, all_labels AS (SELECT {label_sql('has_cancer', 'has_diabetes')} AS combined_label FROM notes)
  SELECT combined_label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage
  FROM all_labels GROUP BY combined_label""")
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return profile.class_distribution(select.with_label(_flag_notes(spark, folder)))


@register(f"""WITH {LABELLED_NOTES} SELECT combined_label, round(avg(length(text)), 6) AS mean,
  round(quantile_cont(length(text), 0.5), 6) AS median, CAST(min(length(text)) AS INTEGER) AS min, CAST(max(length(text)) AS INTEGER) AS max
  FROM labelled GROUP BY combined_label""")
def text_length_by_class(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={"n_chars": F.length("text")})
    return rounded(profile.text_length_stats(select.with_label(select.labelled(df)), length=F.col("n_chars")))


@register(f"""WITH {LABELLED_NOTES}, {KEYWORDS}, marked AS (SELECT combined_label, kw_a FROM labelled JOIN words USING (patient_identifier))
  SELECT combined_label, round(count(*) FILTER (NOT kw_a) * 100.0 / count(*), 1) AS without_flag,
  round(count(*) FILTER (kw_a) * 100.0 / count(*), 1) AS with_flag FROM marked GROUP BY combined_label""")
def keyword_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={"hit": cancer_keyword(clinical(F.col("text")))})
    return profile.crosstab_share(select.with_label(select.labelled(df)), "hit")


@register(f"""WITH {NOTES}, all_labels AS (SELECT {label_sql('true_a', 'true_b')} AS combined_label FROM notes)
  SELECT count(*) FILTER (combined_label IN ('Cancer Only', 'Both')) AS condition_a,
  count(*) FILTER (combined_label IN ('Diabetes Only', 'Both')) AS condition_b,
  count(*) FILTER (combined_label = 'Neither') AS neither FROM all_labels""")
def condition_totals(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={}, truth=True)
    return profile.condition_totals(df.withColumn(LABEL, combined_label(F.col("true_a"), F.col("true_b"))))


@register(f"""WITH {KEYWORDS} SELECT count(*) FILTER (kw_a) AS hits_a, count(*) FILTER (kw_b) AS hits_b,
  count(*) FILTER (kw_a AND kw_b) AS hits_both FROM words""")
def keyword_totals(spark: SparkSession, folder: str) -> DataFrame:
    text = clinical(F.col("text"))
    docs = documents(spark, folder).select(text.alias(TEXT))
    flags = docs.select(cancer_keyword(F.col(TEXT)).alias("has_cancer_kw"), diabetes_keyword(F.col(TEXT)).alias("has_diabetes_kw"))
    return profile.keyword_totals(flags)


@register(f"""WITH {LABELLED_NOTES} SELECT combined_label, arg_min(substring(text, 1, 300) || '...', patient_identifier) AS example
  FROM labelled GROUP BY combined_label""")
def example_per_class(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={"sample": preview(F.col("text"), 300)})
    return first_per_class(select.with_label(select.labelled(df)), F.col("sample"))
