"""Splits: exact counts, disjoint parts, independence of partitioning."""

from collections import Counter
from hashlib import md5

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.operators import split

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
COUNTS = st.fixed_dictionaries({label: st.integers(0, 60) for label in fv.LABELS})


def table(spark, counts):
    labels = [label for label, n in counts.items() for _ in range(n)]
    rows = list(enumerate(labels))
    return spark.createDataFrame(rows, "patient_identifier long, combined_label string"), dict(rows)


def held(df, part):
    return {r.patient_identifier for r in df.filter(F.col("split") == part).collect()}


def in_order(rows, label):
    own = [i for i, x in rows.items() if x == label]
    return sorted(own, key=lambda i: (md5(f"{fv.SEED}:{i}".encode()).hexdigest(), i))


@FEW
@given(COUNTS)
def test_fraction_split_takes_the_first_of_each_class(spark, counts):
    df, rows = table(spark, counts)
    expected = set()
    for label, fraction in fv.HOLD_OUT_FRACTIONS.items():
        own = in_order(rows, label)
        expected |= set(own[:max(1, int(len(own) * fraction))])
    done = split.split_by_fraction_per_label(df)
    assert held(done, "test") == expected
    assert held(done, "train") == set(rows) - expected


def test_rows_of_one_id_stay_together(spark):
    rows = [(7, "Neither")] * 400 + [(i, "Neither") for i in range(100, 900)]
    df = spark.createDataFrame(rows, "patient_identifier long, combined_label string").repartition(6)
    done = split.split_by_fraction_per_label(df)
    assert split.leaked_ids(done).count() == 0
    assert 300 <= done.filter("split = 'test'").count() < 300 + 400


def test_one_row_class_is_held_out(spark):
    df, _ = table(spark, {"Both": 1, "Neither": 4})
    assert len(held(split.split_by_fraction_per_label(df), "test")) == 2


def test_unlisted_class_has_no_split(spark):
    df, _ = table(spark, {"Neither": 4, "Other": 3})
    for done in (split.split_by_fraction_per_label(df), split.split_stratified_total(df)):
        assert Counter(r.split for r in done.filter("combined_label = 'Other'").collect()) == {None: 3}


def test_many_buckets_and_partitions_change_nothing(spark):
    df, _ = table(spark, {"Neither": 3000, "Both": 500})
    one = held(split.split_by_fraction_per_label(df.coalesce(1)), "test")
    other = held(split.split_by_fraction_per_label(df.repartition(13)), "test")
    assert one == other and len(one) == 750 + 250


@FEW
@given(st.fixed_dictionaries({label: st.integers(2, 60) for label in fv.LABELS}))
def test_stratified_split_counts(spark, counts):
    df, rows = table(spark, counts)
    done = split.split_stratified_total(df)
    val = held(done, "validation")
    total = sum(counts.values())
    assert len(val) == -(-total // 5)
    per_label = Counter(rows[i] for i in val)
    for label, n in counts.items():
        assert abs(per_label[label] - len(val) * n / total) < 1
    assert not val & held(done, "train")


def test_class_of_one_row_cannot_be_stratified(spark):
    df, _ = table(spark, {"Neither": 10, "Both": 1})
    with pytest.raises(ValueError):
        split.split_stratified_total(df).collect()


def test_ratio_split(spark):
    df, rows = table(spark, {"Neither": 50, "Both": 30, "Cancer Only": 20})
    done = split.ratio_split(df)
    parts = {name: held(done, name) for name in ("train", "validation", "test")}
    assert {k: len(v) for k, v in parts.items()} == {"train": 60, "validation": 20, "test": 20}
    assert set().union(*parts.values()) == set(rows)


def test_four_way_split_covers_everything_once(spark):
    rows = [(i, 1 if i < 20 else 0, None if i % 3 == 0 else 1.0, None if i % 7 == 0 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "patient_identifier long, test_set int, has_cancer double, has_diabetes double")
    from notewright.operators.select import with_label

    done = split.four_way_split(with_label(df))
    assert done.filter("split is null").count() == 0 and done.count() == 200
    assert held(done, "test") == set(range(20))
    assert held(done, "unlabelled") == {i for i in range(20, 200) if i % 3 == 0 or i % 7 == 0}
    assert split.leaked_ids(done).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    df, _ = table(spark, {"Neither": 500})
    first = {r[0] for r in split.sample_n(df, 200).select("patient_identifier").collect()}
    second = {r[0] for r in split.sample_n(df.repartition(9), 200).select("patient_identifier").collect()}
    assert len(first) == 200 and first == second
    assert split.sample_n(df, 900).count() == 500


def test_case_numbers_follow_ids(spark):
    ids = [7, 10**15, -3, 42, 43, 10**6] + list(range(1000, 1400))
    df = spark.createDataFrame([(i,) for i in ids], "patient_identifier long").repartition(11)
    rows = split.with_case_number(df).collect()
    assert {r.patient_identifier: r.case_num for r in rows} == {v: i + 1 for i, v in enumerate(sorted(ids))}


def test_case_numbers_of_repeated_ids(spark):
    df = spark.createDataFrame([(5,)] * 500 + [(i,) for i in range(10)], "patient_identifier long").repartition(7)
    numbers = sorted((r.case_num, r.patient_identifier) for r in split.with_case_number(df).collect())
    assert [n for n, _ in numbers] == list(range(1, 511))
    assert [i for _, i in numbers] == sorted(i for _, i in numbers)


def test_leaks_are_found(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train"), (2, "train")], "patient_identifier long, split string")
    assert [tuple(r) for r in split.leaked_ids(df).collect()] == [(1, "test", "train")]
