"""Files, tables, streams and whole runs."""

import pytest
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.rules import cancer_keyword, diabetes_keyword
from notewright.operators import embed, score, select
from notewright.operators.profile import data_quality
from notewright.plans import runs
from notewright.plans.driver_tables import notes
from notewright.session import cut_lineage, scratch_path, shared_folder
from notewright.sources import results, vector_store
from notewright.sources.notes import load_notes, read_notes, write_notes, write_notes_csv
from notewright.sources.vectors import build_vector_table, load_vector_table, read_embeddings
from notewright.streaming.notes_stream import drain, read_note_stream, with_keyword_flags

HEADER = "patient_identifier,text,has_cancer,has_diabetes,test_set,embeddings\n"


def test_csv_with_quotes_lines_and_missing_cells(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        HEADER + '1,"say ""hi""\nthere, ok",1.0,,0,"[0.5, -1, 2e-3]"\n2,,nan,0,1,\n3,NA,0.0,1,0.0,"[1,2,3]"\n', encoding="utf-8")
    rows = {r.patient_identifier: r for r in load_notes(spark, str(tmp_path / "n.csv")).collect()}
    assert rows[1].text == 'say "hi"\nthere, ok' and rows[1].has_diabetes is None and rows[1].test_set == 0
    assert rows[1].embedding == pytest.approx([0.5, -1, 0.002])
    assert rows[2].text == "" and rows[2].has_cancer is None and rows[2].embedding is None
    assert rows[3].text == "" and (rows[3].has_cancer, rows[3].has_diabetes) == (0.0, 1.0)


def test_csv_columns_in_any_order(spark, tmp_path):
    (tmp_path / "n.csv").write_text("text,has_diabetes,patient_identifier,has_cancer\nx,1,7,0\n")
    row = load_notes(spark, str(tmp_path / "n.csv")).first()
    assert (row.patient_identifier, row.text, row.has_cancer, row.has_diabetes) == (7, "x", 0.0, 1.0)


def test_csv_keeps_awkward_text(spark, tmp_path):
    texts = ['a"b', "c\\", "d\r\ne", " lead", "", 'x\\"y', "a,b\n\n", '"']
    df = spark.createDataFrame([(i, t, 1.0, None, 0) for i, t in enumerate(texts)],
                               "patient_identifier long, text string, has_cancer double, has_diabetes double, test_set int")
    write_notes_csv(df, str(tmp_path / "t"))
    back = load_notes(spark, str(tmp_path / "t")).orderBy("patient_identifier").collect()
    assert [r.text for r in back] == texts


@pytest.mark.parametrize("size", ["64", "1000000"])
def test_split_csv_equals_the_whole_reader(spark, tmp_path, size):
    texts = ['a"b', "c\\", "d\r\ne", " lead", "", 'x\\"y', "a,b\n\n", '"', "\n".join(f'line "{i}", of many' for i in range(40)), None, "é" * 90]
    df = spark.createDataFrame([(i, t, 1.0, None, 0) for i, t in enumerate(texts * 3)],
                               "patient_identifier long, text string, has_cancer double, has_diabetes double, test_set int")
    write_notes_csv(df.repartition(2), str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        parts = spark.read.text(str(tmp_path / "t"), lineSep="\n").rdd.getNumPartitions()
        back = load_notes(spark, str(tmp_path / "t"), split=True).orderBy("patient_identifier").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 20 or size != "64"
    assert back == load_notes(spark, str(tmp_path / "t")).orderBy("patient_identifier").collect()
    assert [r.text for r in back] == [t or "" for t in texts * 3]


def test_split_csv_of_hand_written_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        "\ufeff" + HEADER + '1,"say ""hi""\nthere, ok",1.0,,0,"[0.5, -1, 2e-3]"\n\n2,,nan,0,1,\n3,NA,0.0,1,0.0,"[1,2,3]"', encoding="utf-8")
    (tmp_path / "m.csv").write_text(HEADER + "4,x,1,0,0,\r\n", newline="", encoding="utf-8")
    rows = {r.patient_identifier: r for r in load_notes(spark, str(tmp_path), split=True).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[1].text == 'say "hi"\nthere, ok' and rows[1].has_diabetes is None
    assert rows[1].embedding == pytest.approx([0.5, -1, 0.002]) and rows[3].text == "" and rows[4].text == "x"
    assert rows[2].text == "" and rows[2].has_cancer is None and rows[2].embedding is None
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "h.csv").write_text(HEADER)
    assert load_notes(spark, str(tmp_path / "only"), split=True).count() == 0


def test_notes_as_parquet_folders(spark, folder, tmp_path):
    df = notes(spark, folder)
    write_notes(df, str(tmp_path / "notes"))
    back = read_notes(spark, str(tmp_path / "notes"))
    assert back.count() == df.count()
    plan = back.filter("test_set = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(test_set" in plan


def test_missing_embeddings_and_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_embeddings(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        load_vector_table(spark, "no_such_table")


def test_vector_table_is_bucketed_by_id(spark, folder, tmp_path):
    cases = select.with_label(select.labelled(notes(spark, folder, vectors=True)))
    stored = build_vector_table(cases, "cases_for_test", str(tmp_path / "cases"), buckets=4)
    joined = stored.join(load_vector_table(spark, "cases_for_test").select("patient_identifier"), "patient_identifier")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert stored.count() == cases.count()


def _cases(spark, rows):
    return spark.createDataFrame(rows, "patient_identifier long, text string, embedding array<float>")


def _stored(df):
    return sorted((r["patient_identifier"], r["text"], r["embedding"]) for r in df.collect())


def test_merges_replace_by_id_and_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"t{i}", [float(i), 1.0]) for i in range(300)]
    built = vector_store.build_case_store(_cases(spark, rows), path, buckets=32)
    assert _stored(built) == rows and built.schema["patient_identifier"].dataType.simpleString() == "bigint"
    change = [(7, "new", None), (7, "later", [0.0, 0.0]), (10**12, "added", [2.0, 2.0])]
    touched = vector_store.merge_cases(_cases(spark, change), path)
    assert 1 <= len(touched) <= 2
    expected = [r for r in rows if r[0] != 7] + [(7, "new", None), (10**12, "added", [2.0, 2.0])]
    assert _stored(vector_store.load_case_store(spark, path)) == sorted(expected)
    assert _stored(vector_store.load_case_store(spark, path, version=0)) == rows
    lists = {}
    for r in vector_store.versions(spark, path).collect():
        lists.setdefault(r["_bucket"], {})[r["_version"]] = r["_folder"]
    assert {b for b, per in lists.items() if per[0] != per[1]} == set(touched)


def test_a_store_may_start_empty_and_missing_stores_are_errors(spark, tmp_path):
    path = str(tmp_path / "store")
    assert vector_store.build_case_store(_cases(spark, []), path).collect() == []
    assert vector_store.merge_cases(_cases(spark, [(None, "x", [1.0])]), path) == []
    vector_store.merge_cases(_cases(spark, [(1, None, [1.0])]), path)
    assert _stored(vector_store.load_case_store(spark, path)) == [(1, None, [1.0])]
    with pytest.raises(FileNotFoundError):
        vector_store.load_case_store(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        vector_store.load_case_store(spark, path, version=9)


def test_a_merge_that_fails_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, f"t{i}", [1.0]) for i in range(20)]
    vector_store.build_case_store(_cases(spark, rows), path, buckets=4)
    broken = _cases(spark, rows).withColumn("text", F.when(F.col("patient_identifier") == 3, F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        vector_store.merge_cases(broken, path)
    assert _stored(vector_store.load_case_store(spark, path)) == rows


def test_texts_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def embedder(texts):
            calls.add(len(texts))
            return [[len(t), t.count("e")] for t in texts]
        return embedder

    rows = [(1, "one"), (2, "one"), (3, None), (4, ""), (5, "three"), (None, "five")]
    df = spark.createDataFrame(rows, "patient_identifier long, text string")
    path = str(tmp_path / "vectors")
    first = embed.embed_once(df.limit(4), make, path, "m 1/a", dim=2)
    assert calls.value == 2 and first.count() == 4
    out = embed.embed_once(df, make, path, "m 1/a", dim=2, waves=3)
    assert calls.value == 4
    assert {(r[0], tuple(r["embedding"])) for r in out.collect()} == {
        (1, (3, 1)), (2, (3, 1)), (3, (0, 0)), (4, (0, 0)), (5, (5, 2)), (None, (4, 1))}
    assert embed.embed_once(df, make, path, "m 1/a", dim=2).count() == 6 and calls.value == 4
    embed.embed_once(df, make, path, "other", dim=2)
    assert calls.value == 8


def predictions(spark, rows):
    schema = ("patient_id long, text string, true_label string, true_has_cancer double, true_has_diabetes double,"
              "initial_classification string, final_classification string, pred_has_cancer double, pred_has_diabetes double,"
              "initial_confidence double, final_confidence double, correct boolean, correct_cancer boolean,"
              "correct_diabetes boolean, decision_rationale string")
    return spark.createDataFrame(rows, schema)


ROW = (1, "t", "Both", 1.0, 1.0, "Both", "Both", 1.0, 1.0, 0.9, 1.0, True, True, True, "r")


def test_summary_text(spark):
    other = (2, "t", "Neither", 0.0, 0.0, "Both", "Cancer Only", 1.0, 0.0, 0.5, 0.5, False, False, True, "r")
    text = results.text_summary(predictions(spark, [ROW, other]), "validation").first()[0]
    assert "RETRIEVAL RUN - VALIDATION SET RESULTS" in text
    assert "Total predictions: 2\nCorrect predictions: 1\nAccuracy: 50.0%" in text
    assert "  Neither             : 0/1 = 0.0%\n  Both                : 1/1 = 100.0%" in text
    assert "  Average Initial Confidence: 0.700" in text
    assert "  Cases where final differed from initial: 1 (50.0%)" in text


def test_summary_of_nothing(spark):
    text = results.text_summary(predictions(spark, [])).first()[0]
    assert "Total predictions: 0" in text and "Accuracy: unknown" in text


def test_datasets_do_not_overwrite_each_other(spark, tmp_path):
    df = predictions(spark, [ROW])
    for name in ("test", "validation", "anything"):
        results.save_dataset_predictions(df, str(tmp_path / "p"), name)
    assert sorted(r.dataset for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["test", "validation"]


def test_empty_lists_are_not_written(spark, tmp_path):
    schema = "patient_id long, baseline_prediction string, baseline_confidence double, llm_prediction string, llm_confidence double"
    df = spark.createDataFrame([(1, "Both", 0.9, "Both", 0.9)], schema)
    assert results.save_comparison(df, str(tmp_path / "c")) == ["full"]


def test_data_quality_without_vectors(spark):
    df = spark.createDataFrame([("", 1.0, None), ("abc", 1.0, 0.0)], "text string, has_cancer double, has_diabetes double")
    assert tuple(data_quality(df).first()) == (2, 0, 0, 1, 1.5, 1, 1)


def test_synonyms(spark):
    both = spark.createDataFrame([(None, "f"), ("m", "f")], "Gender string, Sex string")
    assert [tuple(r) for r in select.merge_synonym_columns(both).collect()] == [("f",), ("m",)]
    assert select.merge_synonym_columns(both.drop("Gender")).columns == ["Gender"]
    assert select.merge_synonym_columns(both.drop("Sex")).columns == ["Gender"]


def test_label_callback(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "has_cancer double, has_diabetes double")
    assert select.with_label(df, label_fn=lambda a, b: (a - b).cast("string")).first().combined_label == "1.0"


def test_complete_rows_drop_any_null(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 1.0, 1.0), (1, 1.0, 1.0)], "test_set int, has_cancer double, has_diabetes double")
    assert select.labelled_complete(df).count() == 1


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2).withColumn("y", F.lit("z")))
    plan = df.select("x")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ReadSchema: struct<x:bigint>" in plan and "Range" not in plan
    assert df.agg(F.sum("x")).first()[0] == 90
    assert scratch_path(spark, "a").startswith(shared_folder(spark))


def test_stream_reads_each_file_once(spark, tmp_path):
    schema = "patient_identifier long, text string"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = read_note_stream(spark, source, spark.createDataFrame([], schema).schema)
        drain(with_keyword_flags(stream), out, progress)
        return {r.patient_identifier: (r.has_cancer_kw, r.has_diabetes_kw) for r in spark.read.parquet(out).collect()}

    add([(1, "carcinoma")])
    assert run() == {1: (True, False)}
    add([(2, "metformin"), (3, "")])
    assert run() == {1: (True, False), 2: (False, True), 3: (False, False)}
    assert spark.read.parquet(out).count() == 3


def test_each_question_is_answered_or_failed(spark, folder):
    from notewright.plans.fixtures import cases_and_questions

    answered, failed = runs.retrieval_run(spark, folder)
    _, asked = cases_and_questions(spark, folder)
    assert answered.columns == list(fv.RETRIEVAL_COLUMNS)
    assert answered.count() + failed.count() == asked.count()
    assert answered.join(failed, "patient_id").count() == 0


def test_model_errors_are_kept(spark, folder):
    from notewright.plans.fixtures import cases_and_questions

    def broken():
        def model(prompts):
            raise TimeoutError("late")
        return model

    store, asked = cases_and_questions(spark, folder, with_text=True)
    answered, failed = score.retrieve_classify_decide(asked.limit(7), store, runs.PROMPTS, runs.first_responder, broken)
    assert answered.count() == 0 and failed.count() == 7
    assert {r.error for r in failed.filter("step = 'decide'").collect()} == {"TimeoutError: late"}


def test_routing_run(spark, folder):
    run = runs.routing_run(spark, folder)
    rows = run.routed.collect()
    assert {r.split for r in rows} == {"test", "validation"}
    assert all(0 <= r.confidence <= 1 and r.predicted_label in fv.LABELS for r in rows)
    sources = {r.source: r["count"] for r in run.expanded.groupBy("source").count().collect()}
    assert sources["labeled"] > 0 and set(sources) <= {"labeled", "ml_synthetic", "regex", "ml_neither"}
    again = {r.patient_identifier: r.predicted_label for r in runs.routing_run(spark, folder).routed.collect()}
    assert again == {r.patient_identifier: r.predicted_label for r in rows}


def test_keywords_on_given_words(spark):
    df = spark.createDataFrame([("on glyburide",)], "text string")
    assert tuple(df.select(cancer_keyword(F.col("text")), diabetes_keyword(F.col("text"))).first()) == (False, True)


def test_failed_calls_are_made_again_and_calls_in_flight_are_bounded(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import time
        import uuid

        def answer(prompts):
            call, begun = uuid.uuid4().hex, time.time()
            time.sleep(0.05)
            with open(f"{folder}/{call}", "w") as f:
                f.write(f"{begun} {time.time()}")
            for p in prompts:
                if p.startswith("later"):
                    seen = f"{folder}/seen-{p}"
                    if not os.path.exists(seen):
                        if len(prompts) == 1:
                            open(seen, "w").close()
                        raise RuntimeError("busy")
                if p == "never":
                    raise RuntimeError("no")
            return [p.upper() for p in prompts]
        return answer

    prompts = [f"p{i}" for i in range(40)] + ["later1", "later2", "never"]
    df = spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string").repartition(12)
    rows = {r["prompt"]: r for r in score.ask_all(df, make, batch=4, attempts=3, in_flight=2).collect()}
    assert len(rows) == 43
    assert all(rows[p]["response"] == p.upper() and rows[p]["attempt"] == 1 for p in prompts[:40])
    assert {rows[p]["attempt"] for p in ("later1", "later2")} == {2} and rows["later1"]["response"] == "LATER1"
    assert (rows["never"]["attempt"], rows["never"]["response"], rows["never"]["error"]) == (3, None, "RuntimeError: no")
    spans = [tuple(map(float, (tmp_path / n).read_text().split())) for n in [x.name for x in tmp_path.iterdir()] if not n.startswith("seen")]
    most = max(sum(a <= begun < b for a, b in spans) for begun, _ in spans)
    assert 1 <= most <= 2
    with pytest.raises(ValueError):
        score.ask_all(df, make, attempts=0)


def test_validation_answers_have_truths(spark, folder):
    answered, _ = runs.validation_run(spark, folder)
    assert answered.count() > 0 and answered.filter("correct IS NULL OR true_label IS NULL").count() == 0
