"""Rule tables over text: keyword flags and voting rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright import fixed_values as fv

# i: any case; U: word characters and spaces of all scripts; d: only \n ends a line.
_FLAGS = "(?iUd)"


@dataclass(frozen=True)
class Rule:
    """One voting rule: where any pattern matches it votes, elsewhere it abstains."""

    name: str
    vote: int
    patterns: tuple[str, ...]


DIABETES_RULES = tuple(Rule(*row) for row in fv.DIABETES_VOTING_RULES)
CANCER_RULES = tuple(Rule(*row) for row in fv.CANCER_VOTING_RULES)


def one_expression(patterns: Sequence[str]) -> str:
    """All patterns as one alternation; word bounds they share are tested once, outside it."""
    first = all(p.startswith(r"\b") for p in patterns)
    last = all(p.endswith(r"\b") for p in patterns)
    inner = "|".join(p[2 if first else 0:-2 if last else None] for p in patterns)
    return (r"\b" if first else "") + f"(?:{inner})" + (r"\b" if last else "")


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern occurs; a text is read once for all of them."""
    return F.coalesce(text.rlike(_FLAGS + one_expression(patterns)), F.lit(False))


def diabetes_keyword(text: Column) -> Column:
    return matches_any(text, fv.DIABETES_KEYWORDS)


def cancer_keyword(text: Column) -> Column:
    return matches_any(text, fv.CANCER_KEYWORDS)


def diabetes_mention(text: Column) -> Column:
    """The looser, prefix-matching test used to profile a table."""
    return matches_any(text, fv.DIABETES_PREVALENCE)


def cancer_mention(text: Column) -> Column:
    """The looser, prefix-matching test used to profile a table."""
    return matches_any(text, fv.CANCER_PREVALENCE)


def rule_vote(text: Column, rule: Rule) -> Column:
    """One rule's vote as a tinyint."""
    fired = matches_any(text, rule.patterns)
    return F.when(fired, F.lit(rule.vote)).otherwise(F.lit(fv.ABSTAIN)).cast("tinyint")


def rule_votes(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules' votes as one array, in rule order."""
    return F.array(*[rule_vote(text, rule) for rule in rules])
