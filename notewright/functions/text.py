"""Column expressions on note text: headers, previews, prompts."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright import fixed_values as fv

# White space of all scripts: control characters, the usual and the typographic spaces.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Drop white space of any script from both ends."""
    return F.btrim(text, F.lit(_SPACES))


def lines_of(text: Column) -> Column:
    """The lines of a text; a missing text has none."""
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def after_colon(line: Column) -> Column:
    """What follows the first colon, stripped."""
    return strip(F.substr(line, F.instr(line, ":") + 1))


def header_map(text: Column) -> Column:
    """``header: value`` lines as a map.

    Lines split on their first colon; both sides are stripped and must be
    non-empty; of a repeated header the last line wins. Entries are sorted by
    (header, line) and the last of each run kept, so a note with thousands of
    headers costs n log n and no session setting is needed.
    """
    with_colon = F.filter(lines_of(text), lambda line: F.contains(line, F.lit(":")))
    entries = F.transform(
        with_colon,
        lambda line, place: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("header"),
            place.alias("place"),
            after_colon(line).alias("value"),
        ),
    )
    filled = F.filter(entries, lambda e: (e["header"] != "") & (e["value"] != ""))
    last_of_run = bound(
        F.sort_array(filled),
        lambda rows: F.filter(
            rows,
            lambda e, i: (i == F.size(rows) - 1) | (F.get(rows, i + 1)["header"] != e["header"]),
        ),
    )
    return F.map_from_entries(
        F.transform(last_of_run, lambda e: F.struct(e["header"], e["value"]))
    )


def preview(text: Column, chars: int) -> Column:
    """The first characters followed by an ellipsis."""
    return F.concat(F.substring(text, 1, chars), F.lit("..."))


def prompt_text(text: Column, chars: int = fv.PROMPT_TEXT_CHARS) -> Column:
    """The part of a note that a prompt may carry."""
    return F.substring(text, 1, chars)


def text_length(text: Column) -> Column:
    """Length in characters."""
    return F.length(text)


def retrieval_context(cases: Column) -> Column:
    """Numbered, readable lines for an array of retrieved cases.

    Each case needs ``similarity_score``, ``combined_label``, ``has_cancer``,
    ``has_diabetes`` and ``text``.
    """
    def block(case: Column, place: Column) -> Column:
        return F.format_string(
            fv.CASE_FORMAT,
            place + 1,
            case["similarity_score"],
            case["combined_label"],
            case["has_cancer"].cast("string"),
            case["has_diabetes"].cast("string"),
            preview(case["text"], fv.SNIPPET_CHARS),
        )

    return F.array_join(F.transform(cases, block), "\n")


def render_prompt(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places of a template with columns; NULL prints as ``None``."""
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")
