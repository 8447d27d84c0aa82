"""Registered queries on splitting and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators import select, split
from notewright.operators.profile import class_distribution
from notewright.plans.driver_tables import notes
from notewright.plans.oracle import LABELLED_NOTES, order_key, quoted
from notewright.plans.registry import register
from notewright.schema import ID, LABEL, TEST_SET

_SHARE = "CASE combined_label " + " ".join(
    f"WHEN {quoted(k)} THEN CAST({v} AS DOUBLE)" for k, v in fv.HOLD_OUT_FRACTIONS.items()) + " END"


def _by_fraction(source: str) -> str:
    return f"""by_fraction AS (SELECT patient_identifier, combined_label,
    CASE WHEN r <= greatest(1, CAST(floor(n * {_SHARE}) AS BIGINT)) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY combined_label ORDER BY {order_key('patient_identifier')}, patient_identifier) AS r,
      count(*) OVER (PARTITION BY combined_label) AS n FROM {source}))"""


def stratified(source: str, name: str, fraction: float, held: str, kept: str) -> str:
    return f"""{name} AS (SELECT s.* EXCLUDE (r), CASE WHEN r <= quota THEN '{held}' ELSE '{kept}' END AS part_{name}
    FROM (SELECT *, row_number() OVER (PARTITION BY combined_label ORDER BY {order_key('patient_identifier')}, patient_identifier) AS r FROM {source}) s
    JOIN (SELECT combined_label, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, combined_label) <= wanted - sum(base) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT combined_label, wanted, floor(share) AS base, round(share - floor(share), 9) AS remainder
        FROM (SELECT combined_label, wanted, wanted * n / total AS share
          FROM (SELECT combined_label, count(*) AS n, sum(count(*)) OVER () AS total,
            ceil(sum(count(*)) OVER () * CAST({fraction} AS DOUBLE)) AS wanted FROM {source} GROUP BY combined_label)))) q
    USING (combined_label))"""


_FOUR = f"""{LABELLED_NOTES}, {stratified('labelled', 'val', fv.VALIDATION_FRACTION, 'validation', 'train')},
  four AS (SELECT n.patient_identifier, CASE WHEN n.test_set = 1 THEN 'test' ELSE coalesce(part_val, 'unlabelled') END AS split
    FROM notes n LEFT JOIN val v ON v.patient_identifier = n.patient_identifier)"""


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(select.labelled(notes(spark, folder, features={})))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(notes(spark, folder, features={}))


@register(f"WITH {LABELLED_NOTES}, {_by_fraction('labelled')} SELECT * FROM by_fraction")
def split_by_fraction_per_label(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_by_fraction_per_label(_labelled(spark, folder)).select(ID, LABEL, split.SPLIT)


@register(f"""WITH {LABELLED_NOTES}, {stratified('labelled', 'val', fv.VALIDATION_FRACTION, 'validation', 'train')}
  SELECT patient_identifier, combined_label, part_val AS split FROM val""")
def split_stratified_total(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_stratified_total(_labelled(spark, folder)).select(ID, LABEL, split.SPLIT)


@register(f"WITH {_FOUR} SELECT * FROM four")
def four_way_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.four_way_split(_all(spark, folder)).select(ID, split.SPLIT)


@register(f"""WITH {_FOUR} SELECT split, combined_label, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 2) AS percentage FROM four JOIN (
    SELECT patient_identifier, CASE WHEN has_cancer = 1 AND has_diabetes = 1 THEN 'Both' WHEN has_cancer = 1 THEN 'Cancer Only'
      WHEN has_diabetes = 1 THEN 'Diabetes Only' ELSE 'Neither' END AS combined_label FROM notes) USING (patient_identifier)
  GROUP BY split, combined_label""")
def class_distribution_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return class_distribution(split.four_way_split(_all(spark, folder)), by=[split.SPLIT])


@register(f"""WITH {LABELLED_NOTES}, {stratified('labelled', 'tested', 0.2, 'test', 'rest')},
  remaining AS (SELECT * EXCLUDE (part_tested) FROM tested WHERE part_tested = 'rest'),
  {stratified('remaining', 'val', 0.25, 'validation', 'train')}
  SELECT patient_identifier, combined_label, 'test' AS split FROM tested WHERE part_tested = 'test'
  UNION ALL SELECT patient_identifier, combined_label, part_val FROM val""")
def ratio_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.ratio_split(_labelled(spark, folder)).select(ID, LABEL, split.SPLIT)


@register(f"WITH {LABELLED_NOTES}, {_by_fraction('labelled')} SELECT * FROM by_fraction")
def resplit_after_merge(spark: SparkSession, folder: str) -> DataFrame:
    parts = split.split_stratified_total(_labelled(spark, folder))
    train = parts.filter(F.col(split.SPLIT) == split.TRAIN)
    validation = parts.filter(F.col(split.SPLIT) == split.VALIDATION)
    return split.resplit(train, validation).select(ID, LABEL, split.SPLIT)


@register(f"""WITH {LABELLED_NOTES} SELECT patient_identifier FROM notes WHERE has_cancer IS NULL AND test_set = 0
  ORDER BY {order_key('patient_identifier')}, patient_identifier LIMIT {fv.NEITHER_SAMPLE}""")
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return split.sample_n(select.unlabelled_any(notes(spark, folder, features={}))).select(ID)


@register(f"""WITH {_FOUR}, {_by_fraction('labelled')},
  placed AS (SELECT patient_identifier, split FROM four UNION ALL SELECT patient_identifier, split FROM by_fraction)
  SELECT patient_identifier, min(split) AS first_split, max(split) AS last_split FROM placed
  GROUP BY patient_identifier HAVING min(split) <> max(split)""")
def leaked_ids(spark: SparkSession, folder: str) -> DataFrame:
    one = split.four_way_split(_all(spark, folder)).select(ID, split.SPLIT)
    other = split.split_by_fraction_per_label(_labelled(spark, folder)).select(ID, split.SPLIT)
    return split.leaked_ids(one.unionByName(other))


@register(f"WITH {_FOUR} SELECT count(*) AS n_leaked FROM (SELECT patient_identifier FROM four GROUP BY 1 HAVING min(split) <> max(split))")
def four_way_split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return split.leaked_ids(split.four_way_split(_all(spark, folder))).agg(F.count("*").alias("n_leaked"))


@register(f"WITH {LABELLED_NOTES} SELECT patient_identifier, test_set, row_number() OVER (ORDER BY patient_identifier) AS case_num FROM notes")
def case_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return split.with_case_number(notes(spark, folder, features={})).select(ID, TEST_SET, "case_num")
