"""The registered queries of the corpus operators, by name; SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import chat, decontaminate, html_text, licences, markov, mixing, personal, quality, resample, sharding, simhash, substring, whitening
from notewright.llm.sql import SQL  # noqa: F401
from notewright.session import cut_lineage

SHARDS = 16


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digest(licences.scan(_table(spark, folder, "documents")))


def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(mixing.sized(_table(spark, folder, "documents")))
    return mixing.taken(rows, mixing.cuts(rows)).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal.digest(personal.find(_table(spark, folder, "documents")))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    _, table = sharding.coordinates(_table(spark, folder, "documents"))
    rows = cut_lineage(table)
    placed = sharding.numbered(cut_lineage(rows.withColumn("shard", sharding.tree(rows, SHARDS))))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digest(_table(spark, folder, "documents"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digest(_table(spark, folder, "conversations"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"quality.figures.{n}").alias(n) for n in names], F.col("quality.base_failed"), F.col("quality.kept")
    )


def op11_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return markov.score(_table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(_table(spark, folder, "embeddings"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    ranks = resample.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {run.__name__: run for run in (
    op1_license_scan, op2_simhash_dedup, op3_mixing, op4_pii, op5_sharding, op6_html_text,
    op7_decontamination, op8_substring_dedup, op9_chat_format, op10_quality_rules,
    op11_lm_score, op12_whitening, op13_resampling,
)}
