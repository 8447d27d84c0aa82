"""Parsing of ``Name: value`` answers given by an external classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.text import after_colon, lines_of, strip

Field = tuple[str, str, str]

# What a plain decimal literal looks like: digits may be grouped by underscores.
_NUMBER = (
    r"(?i)\A[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
    r"(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)\z"
)


def to_number(value: Column) -> Column:
    """A double, or NULL where the text is no number."""
    plain = F.regexp_replace(value, "_", "")
    return F.when(value.rlike(_NUMBER), plain.try_cast("double"))


def _values(lines: Column, prefix: Column, strict: bool) -> Column:
    """What each line that starts with ``prefix`` says after it."""
    own = F.filter(lines, lambda line: F.startswith(line, prefix))
    if strict:
        return F.transform(own, lambda line: strip(F.replace(line, prefix, F.lit(""))))
    return F.transform(own, after_colon)


def parse_answer(
    response: Column,
    fields: Sequence[Field] = fv.FIRST_ANSWER_FIELDS,
    strict: bool = False,
) -> list[Column]:
    """One column per field, plus ``parse_error``.

    The last line that starts with a field's prefix gives its value. A field
    that never occurs takes its default. A confidence that is no number falls
    back to its default; a flag that is no number, on any of its lines, sets
    ``parse_error``, as does a missing response. With ``strict`` lines are taken
    as they are, missing fields are NULL, and a bad confidence is an error too.
    """
    raw_lines = lines_of(response)
    lines = raw_lines if strict else F.transform(raw_lines, strip)

    columns: list[Column] = []
    error = response.isNull()
    for name, prefix, kind in fields:
        values = _values(lines, F.lit(prefix), strict)
        last = F.try_element_at(values, F.lit(-1))
        if kind == "text":
            value = last
        else:
            value = to_number(last)
            if kind == "flag" or strict:
                error = error | F.exists(values, lambda v: to_number(v).isNull())
        if not strict:
            value = F.coalesce(value, F.lit(fv.ANSWER_DEFAULTS[name]))
        columns.append(value.alias(name))
    columns.append(F.coalesce(error, F.lit(False)).alias("parse_error"))
    return columns


def parse_first_answer(response: Column) -> list[Column]:
    return parse_answer(response, fv.FIRST_ANSWER_FIELDS)


def parse_final_answer(response: Column) -> list[Column]:
    return parse_answer(response, fv.FINAL_ANSWER_FIELDS)


def parse_first_answer_strict(response: Column) -> list[Column]:
    """Strict parse that also keeps the quoted evidence and the raw response."""
    fields = (*fv.FIRST_ANSWER_FIELDS[:-1], fv.KEY_EVIDENCE_FIELD, fv.FIRST_ANSWER_FIELDS[-1])
    return [response.alias("raw_response"), *parse_answer(response, fields, strict=True)]


def parse_final_answer_strict(response: Column) -> list[Column]:
    """Strict parse of a final answer with the raw response."""
    return [response.alias("raw_response"), *parse_answer(response, fv.FINAL_ANSWER_FIELDS, strict=True)]
