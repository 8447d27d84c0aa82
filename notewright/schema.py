"""Table shapes shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from notewright import fixed_values as fv


@dataclass(frozen=True)
class LabelScheme:
    """Two flag columns and the names of the four labels they combine to."""

    flag_a: str = "has_cancer"
    flag_b: str = "has_diabetes"
    neither: str = fv.LABELS[0]
    only_a: str = fv.LABELS[1]
    only_b: str = fv.LABELS[2]
    both: str = fv.LABELS[3]

    @property
    def labels(self) -> tuple[str, str, str, str]:
        """The labels in canonical order."""
        return (self.neither, self.only_a, self.only_b, self.both)


SCHEME = LabelScheme()

ID = "patient_identifier"
TEXT = "text"
LABEL = "combined_label"
TEST_SET = "test_set"
EMBEDDING = "embedding"
SOURCE = "source"


def notes_schema(scheme: LabelScheme = SCHEME) -> T.StructType:
    """Columns of a note table as it is stored."""
    return T.StructType([
        T.StructField(ID, T.LongType(), False),
        T.StructField(TEXT, T.StringType(), False),
        T.StructField(scheme.flag_a, T.DoubleType()),
        T.StructField(scheme.flag_b, T.DoubleType()),
        T.StructField(TEST_SET, T.IntegerType()),
    ])
