"""Quality rules: a table of thresholds compiled into one projection.

Null and empty texts have no words and fail the length rule. Repeated rows and
ids are judged row by row; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import let, text_of, words

SYMBOLS = "#*$%&|<>"

# Frequent words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "a", "be", "on", "are", "this",
    "der", "die", "und", "das", "von", "den", "ist", "nicht", "mit", "ein", "eine", "zu", "im", "auf",
    "de", "la", "le", "les", "et", "des", "un", "une", "du", "que", "est", "en", "par", "pour",
    "el", "los", "las", "y", "del", "se", "por", "una", "con", "para", "al", "es", "no",
)


@dataclass(frozen=True)
class Rule:
    """A row fails when ``scale * measure`` is below or above ``bound * per`` (``per`` None: one)."""

    name: str
    measure: str
    side: str
    bound: int
    per: str | None = None
    scale: int = 1
    base: bool = False


RULES = (
    Rule("few words", "n_words", "below", 50, base=True),
    Rule("repeated words", "n_repeat_words", "above", 50, "n_words", 100, base=True),
    Rule("symbols", "n_symbols", "above", 10, "n_words", 100),
    Rule("repeated lines", "n_dup_lines", "above", 30, "n_lines", 100),
    Rule("short words", "word_chars", "below", 2, "n_words"),
    Rule("long words", "word_chars", "above", 15, "n_words"),
    Rule("few stop words", "n_stop_words", "below", 2, "n_words", 100),
)

# The filter of the corpus pipeline weighs repeated lines by their text, so that one short line
# that recurs in a long text does not reject it.
TEXT_RULES = tuple(Rule(r.name, "dup_line_chars", "above", r.bound, "word_chars", r.scale) if r.measure == "n_dup_lines" else r for r in RULES)


def _repeated(w: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in ``w``."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - size),
        lambda i: F.struct(
            F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)]).alias("k"), i.alias("p")
        ),
    )

    def covered(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"])
        )
        places = F.transform(twice, lambda x: F.array(*[x["p"] + j for j in range(size)]))
        return F.size(F.array_distinct(F.flatten(places)))

    return F.when(F.size(w) >= size, let(F.array_sort(windows), covered)).otherwise(0)


def measures(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of every figure ``rules`` may use; words and lines are cut once per row."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    by_text = any(r.measure == "dup_line_chars" for r in rules)

    def chars(t: Column) -> Column:
        return F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long")

    def figures(w: Column) -> Column:
        return let(lines, lambda rows: F.struct(
            F.size(w).cast("long").alias("n_words"),
            chars(text).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            *([(chars(text) - chars(F.concat_ws("", F.array_distinct(rows)))).alias("dup_line_chars")] if by_text else []),
            _repeated(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        ))

    return let(words(text), figures)


def fails(m: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any of ``rules`` fails on the struct ``m``."""
    def one(rule: Rule) -> Column:
        value = m[rule.measure] * rule.scale
        bound = F.lit(rule.bound) if rule.per is None else m[rule.per] * rule.bound
        return value < bound if rule.side == "below" else value > bound

    return reduce(lambda a, b: a | b, [one(r) for r in rules], F.lit(False))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` of the figures and verdicts, replacing one of that name."""
    base = tuple(r for r in rules if r.base)
    verdict = let(measures(text_of(text), rules), lambda m: F.struct(
        m.alias("figures"), fails(m, base).alias("base_failed"), (~fails(m, rules)).alias("kept")
    ))
    return docs.withColumn("quality", verdict)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns."""
    return docs.where(let(measures(text_of(text), rules), lambda m: ~fails(m, rules)))
