"""Growing a small labelled set with pseudo-labels in three phases.

Every unlabelled row is scored once and falls to the first phase that takes it,
in one ``when`` cascade; no phase looks for its rows with a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import combined_label
from notewright.operators.select import tag_source, union_phases
from notewright.operators.split import sample_n
from notewright.schema import EMBEDDING, ID, LABEL, SCHEME, SOURCE, LabelScheme


def phase_of(p_a: Column, p_b: Column, kw_a: Column, kw_b: Column) -> Column:
    """The source that labels a row, or NULL: sure model scores, then keywords, then low scores."""
    sure = (
        (p_a >= fv.POSITIVE_AT_LEAST)
        | (p_b >= fv.POSITIVE_AT_LEAST)
        | ((p_a < fv.NEITHER_BELOW) & (p_b < fv.NEITHER_BELOW))
    )
    low = (p_a < fv.RELAXED_NEITHER_BELOW) & (p_b < fv.RELAXED_NEITHER_BELOW)
    return (
        F.when(sure, fv.SOURCE_MODEL).when(kw_a | kw_b, fv.SOURCE_RULES).when(low, fv.SOURCE_NEITHER)
    )


def assign_phase(
    scored: DataFrame,
    scheme: LabelScheme = SCHEME,
    p_a: str = "p_a",
    p_b: str = "p_b",
    kw_a: str = "has_cancer_kw",
    kw_b: str = "has_diabetes_kw",
) -> DataFrame:
    """Set source, flags and label of every row some phase takes; other rows keep NULLs."""
    def flag(probability: str, keyword: str) -> Column:
        return (
            F.when(F.col(SOURCE) == fv.SOURCE_MODEL, (F.col(probability) >= fv.POSITIVE_AT_LEAST).cast("double"))
            .when(F.col(SOURCE) == fv.SOURCE_RULES, F.col(keyword).cast("double"))
            .when(F.col(SOURCE) == fv.SOURCE_NEITHER, F.lit(0.0))
        )

    phased = scored.withColumn(SOURCE, phase_of(F.col(p_a), F.col(p_b), F.col(kw_a), F.col(kw_b)))
    flagged = phased.withColumns({scheme.flag_a: flag(p_a, kw_a), scheme.flag_b: flag(p_b, kw_b)})
    label = combined_label(F.col(scheme.flag_a), F.col(scheme.flag_b), scheme)
    return flagged.withColumn(LABEL, F.when(F.col(SOURCE).isNotNull(), label))


def model_phase(phased: DataFrame) -> DataFrame:
    """Rows labelled by sure model scores."""
    return phased.filter(F.col(SOURCE) == fv.SOURCE_MODEL)


def rule_phase(phased: DataFrame) -> DataFrame:
    """Rows labelled by keywords."""
    return phased.filter(F.col(SOURCE) == fv.SOURCE_RULES)


def neither_phase(phased: DataFrame, n: int = fv.NEITHER_SAMPLE, seed: int = fv.SEED, id_col: str = ID) -> DataFrame:
    """A sample of the rows with two low scores."""
    return sample_n(phased.filter(F.col(SOURCE) == fv.SOURCE_NEITHER), n, seed, id_col)


def expand_training_set(
    labelled: DataFrame,
    phased: DataFrame,
    n: int = fv.NEITHER_SAMPLE,
    seed: int = fv.SEED,
    id_col: str = ID,
    vector: str = EMBEDDING,
) -> DataFrame:
    """The labelled rows with all pseudo-labelled ones, tagged by source."""
    if vector not in labelled.columns:
        raise ValueError(f"column {vector} is missing from the labelled rows")
    taken = phased.filter(F.col(SOURCE).isin(fv.SOURCE_MODEL, fv.SOURCE_RULES))
    return union_phases(tag_source(labelled, fv.SOURCE_LABELED), taken, neither_phase(phased, n, seed, id_col))
