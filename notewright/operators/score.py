"""Batched calls of an external model, and the retrieve, classify, decide run."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import fixed_values as fv
from notewright.functions.answers import parse_final_answer, parse_first_answer
from notewright.functions.labels import combined_label
from notewright.functions.text import prompt_text, render_prompt, retrieval_context
from notewright.operators.metrics import with_correctness
from notewright.operators.neighbours import gather_cases, similarity_search
from notewright.schema import EMBEDDING, ID, SCHEME, TEXT, LabelScheme
from notewright.session import cut_lineage

Responder = Callable[[Sequence[str]], Sequence[str]]


def score_batches(
    df: DataFrame,
    make_model: Callable[[], Responder],
    prompt: str = "prompt",
    response: str = "response",
    batch: int = fv.EMBEDDING_BATCH,
) -> DataFrame:
    """Add a model's ``response`` to each prompt, and ``error`` where it failed.

    The model is built once per partition and called ``batch`` prompts at a
    time. If a call fails its prompts are tried one by one, so only the rows
    that fail themselves lose their response; no row is lost.
    """
    schema = T.StructType([
        *df.schema.fields, T.StructField(response, T.StringType()), T.StructField("error", T.StringType())
    ])

    def ask(model: Responder, prompts: Sequence[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(model(prompts))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(prompts)} prompts gave {len(answers)} answers")
            return [(answer, None) for answer in answers]
        except Exception as failure:  # a failing prompt must not fail its neighbours
            if len(prompts) > 1:
                return [pair for one in prompts for pair in ask(model, [one])]
            return [(None, f"{type(failure).__name__}: {failure}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for rows in batches:
            prompts = rows.column(rows.schema.get_field_index(prompt)).to_pylist()
            pairs = []
            for start in range(0, len(prompts), batch):
                pairs += ask(model, prompts[start:start + batch])
            answers = pa.array([p[0] for p in pairs], pa.string())
            errors = pa.array([p[1] for p in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, answers, errors], names=[*rows.schema.names, response, "error"]
            )

    return df.mapInArrow(run, schema)


def ask_all(
    df: DataFrame,
    make_model: Callable[[], Responder],
    prompt: str = "prompt",
    response: str = "response",
    batch: int = fv.EMBEDDING_BATCH,
    attempts: int = 1,
    in_flight: int | None = None,
) -> DataFrame:
    """``score_batches`` in up to ``attempts`` passes, with the number of each row's last pass as ``attempt``.

    The answers of a pass are written before the next one begins, which asks again only for the
    rows that failed; no answer is asked for twice. Each task makes one call after another, and no
    more than ``in_flight`` tasks ask, so no more calls than that are under way at a time. A row
    that fails in every pass keeps its last error.
    """
    if attempts < 1:
        raise ValueError("a row needs at least one attempt")
    pending, done = df, None
    for attempt in range(1, attempts + 1):
        if in_flight is not None:
            # A shuffle, so that reading the rows and building prompts keeps its own parallelism.
            pending = pending.repartition(in_flight)
        asked = cut_lineage(score_batches(pending, make_model, prompt, response, batch).withColumn("attempt", F.lit(attempt)))
        failed = asked.filter(F.col("error").isNotNull())
        again = attempt < attempts and not failed.isEmpty()
        settled = asked.filter(F.col("error").isNull()) if again else asked
        done = settled if done is None else done.unionByName(settled)
        if not again:
            return done
        pending = failed.drop(response, "error", "attempt")
    return done


@dataclass(frozen=True)
class Prompts:
    """Templates of the first and the final question, with ``{field}`` places."""

    first: str
    final: str


def retrieve_classify_decide(
    queries: DataFrame,
    store: DataFrame,
    prompts: Prompts,
    make_first: Callable[[], Responder],
    make_final: Callable[[], Responder],
    k: int = fv.TOP_K,
    scheme: LabelScheme = SCHEME,
    vector: str = EMBEDDING,
    null_as_wrong: bool = False,
    attempts: int = 1,
    in_flight: int | None = None,
    prompt_chars: int | None = fv.PROMPT_TEXT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Retrieve similar cases, ask for a first answer, then for a final one, for all queries at once.

    Returns the prediction table and the failed rows with the step and error
    that stopped them; each query is in exactly one of the two. Answers are
    written down before they are parsed, so no retry asks a model twice. Failed
    calls are made again in up to ``attempts`` passes, ``in_flight`` at a time
    (``ask_all``). The final prompt holds the first ``prompt_chars`` characters
    of a note, or all of it.
    """
    cases = gather_cases(similarity_search(queries, store, k, scheme, vector=vector), scheme)
    notes = queries.select(F.col(ID).alias("query_id"), TEXT, scheme.flag_a, scheme.flag_b)
    asked = notes.join(cases, "query_id", "left").select(
        "query_id", TEXT, F.col(scheme.flag_a).alias("true_a"), F.col(scheme.flag_b).alias("true_b"),
        retrieval_context(F.coalesce("cases", F.array().cast(cases.schema["cases"].dataType))).alias("context"),
        render_prompt(prompts.first, {"patient_text": F.col(TEXT)}).alias("prompt"),
    )
    first = ask_all(asked, make_first, attempts=attempts, in_flight=in_flight).drop("prompt", "attempt")
    answered = first.select(
        "query_id", TEXT, "true_a", "true_b", "context", "error",
        *[c.alias(f"first_{i}") for i, c in enumerate(parse_first_answer(F.col("response")))],
    )
    names = [field[0] for field in fv.FIRST_ANSWER_FIELDS] + ["parse_error"]
    for i, name in enumerate(names):
        answered = answered.withColumnRenamed(f"first_{i}", f"initial_{name}")
    good = answered.filter(F.col("error").isNull() & ~F.col("initial_parse_error")).drop("error")
    final_prompt = render_prompt(prompts.final, {
        "retrieval_context": F.col("context"),
        "initial_classification": F.col("initial_classification"),
        "initial_has_cancer": F.col("initial_has_cancer"),
        "initial_has_diabetes": F.col("initial_has_diabetes"),
        "initial_confidence": F.col("initial_confidence"),
        "initial_reasoning": F.coalesce("initial_reasoning", F.lit(fv.MISSING_REASONING)),
        "patient_text": F.col(TEXT) if prompt_chars is None else prompt_text(F.col(TEXT), prompt_chars),
    })
    second = ask_all(good.withColumn("prompt", final_prompt), make_final, attempts=attempts, in_flight=in_flight).drop("prompt", "attempt")
    decided = second.select("*", *parse_final_answer(F.col("response")))
    done = F.col("error").isNull() & ~F.col("parse_error")

    predictions = with_correctness(
        decided.filter(done).select(
            F.col("query_id").alias("patient_id"), TEXT,
            combined_label(F.col("true_a"), F.col("true_b"), scheme).alias("true_label"),
            F.col("true_a").alias("true_has_cancer"), F.col("true_b").alias("true_has_diabetes"),
            "initial_classification", "final_classification",
            F.col("has_cancer").alias("pred_has_cancer"), F.col("has_diabetes").alias("pred_has_diabetes"),
            "initial_confidence", "final_confidence", "decision_rationale",
        ),
        null_as_wrong=null_as_wrong,
    ).select(*fv.RETRIEVAL_COLUMNS)

    def failed(rows: DataFrame, step: str) -> DataFrame:
        return rows.select(
            F.col("query_id").alias("patient_id"), F.lit(step).alias("step"),
            F.coalesce("error", F.lit("a flag in the answer is no number")).alias("error"),
        )

    errors = failed(
        answered.filter(F.col("error").isNotNull() | F.col("initial_parse_error")), "classify"
    ).unionByName(failed(decided.filter(~done), "decide"))
    return predictions, errors
