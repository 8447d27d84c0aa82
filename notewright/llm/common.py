"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def original(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named columns alone, whatever characters their names hold."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
