"""Weak supervision: rule votes combined into a probability per note."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.rules import Rule, rule_votes
from notewright.schema import TEXT
from notewright.session import cut_lineage

# Precision a vote is taken to have at first, and in pseudo-votes ever after.
_FIRST_PRECISION = 0.7
_MOST_EDGE = 0.98
_TOLERANCE = 1e-7
_FLOOR = 1e-9
# Up to this many rules the vote patterns are few (3^rules) and are fitted in memory.
_IN_MEMORY_RULES = 10


def apply_rules(df: DataFrame, rules: Sequence[Rule], name: str = "votes", text: str = TEXT) -> DataFrame:
    """Add the array of rule votes."""
    return df.withColumn(name, rule_votes(F.col(text), rules))


def majority_probability(votes: Column) -> Column:
    """Share of positive votes among those cast; 0.5 when every rule abstains."""
    positive = F.size(F.filter(votes, lambda v: v == fv.POSITIVE))
    cast = F.size(F.filter(votes, lambda v: v != fv.ABSTAIN))
    return F.when(cast > 0, positive / cast).otherwise(F.lit(0.5))


def _posterior(votes: Column, odds: np.ndarray) -> Column:
    """P(positive) of a vote pattern: each vote adds its rule's log odds, an abstention nothing."""
    total = F.lit(0.0)
    for j, (negative, positive) in enumerate(odds):
        total = total + (
            F.when(votes[j] == fv.POSITIVE, F.lit(float(positive)))
            .when(votes[j] == fv.NEGATIVE, F.lit(float(negative)))
            .otherwise(F.lit(0.0))
        )
    return 1.0 / (1.0 + F.exp(-total))


def _log_odds(chances: np.ndarray) -> np.ndarray:
    """Log odds per (rule, vote) from chances per (rule, vote, class)."""
    chances = np.maximum(chances, _FLOOR)
    return np.log(chances[:, :, fv.POSITIVE] / chances[:, :, fv.NEGATIVE])


def _pseudo_votes(seen: np.ndarray, precisions: np.ndarray) -> np.ndarray:
    """Votes per (rule, vote, class) if every vote of a rule had its starting precision."""
    right = precisions[:, None, None]
    return seen[:, :, None] * np.where(np.eye(2, dtype=bool)[None], right, 1.0 - right)


def _chances(votes: np.ndarray, rows: np.ndarray, pseudo: np.ndarray, total: float) -> np.ndarray:
    """Chances per (rule, vote, class) from votes and rows per class, with the pseudo-votes added."""
    return (votes + pseudo) / (rows + total / 2.0)


def _fit_in_memory(patterns: DataFrame, n_rules: int, epochs: int, precisions: np.ndarray) -> np.ndarray:
    rows = patterns.collect()
    votes = np.array([r["votes"] for r in rows], dtype=np.int64).reshape(-1, n_rules)
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    if not len(n):
        return np.zeros((n_rules, 2))
    cast = np.stack([votes == fv.NEGATIVE, votes == fv.POSITIVE], axis=2).astype(np.float64)
    pseudo = _pseudo_votes(np.einsum("i,ijv->jv", n, cast), precisions)
    chances = pseudo / (n.sum() / 2.0)
    for _ in range(epochs):
        odds = _log_odds(chances)
        positive = 1.0 / (1.0 + np.exp(-np.einsum("ijv,jv->i", cast, odds)))
        split = np.stack([n * (1.0 - positive), n * positive], axis=1)
        new = _chances(np.einsum("ic,ijv->jvc", split, cast), split.sum(axis=0), pseudo, n.sum())
        moved = np.abs(new - chances).max()
        chances = new
        if moved < _TOLERANCE:
            break
    return _log_odds(chances)


def _fit_on_table(patterns: DataFrame, n_rules: int, epochs: int, precisions: np.ndarray) -> np.ndarray:
    votes, n = F.col("votes"), F.col("n")

    def sums(positive: Column) -> tuple[np.ndarray, np.ndarray]:
        columns = [F.sum(n * (1.0 - positive)), F.sum(n * positive)]
        for j in range(n_rules):
            for vote in (fv.NEGATIVE, fv.POSITIVE):
                weight = F.when(votes[j] == vote, n).otherwise(F.lit(0))
                columns += [F.sum(weight * (1.0 - positive)), F.sum(weight * positive)]
        row = np.array(patterns.agg(*columns).first(), dtype=np.float64)
        return row[2:].reshape(n_rules, 2, 2), row[:2]

    if patterns.isEmpty():
        return np.zeros((n_rules, 2))
    halves, rows = sums(F.lit(0.5))
    total = float(rows.sum())
    pseudo = _pseudo_votes(halves.sum(axis=2), precisions)
    chances = pseudo / (total / 2.0)
    for _ in range(epochs):
        new = _chances(*sums(_posterior(votes, _log_odds(chances))), pseudo, total)
        moved = np.abs(new - chances).max()
        chances = new
        if moved < _TOLERANCE:
            break
    return _log_odds(chances)


def fit_vote_model(
    df: DataFrame, n_rules: int, votes: str = "votes", epochs: int = fv.VOTE_EPOCHS,
    in_memory_rules: int = _IN_MEMORY_RULES, precisions: Sequence[float] | None = None,
) -> np.ndarray:
    """Log odds that each vote of each rule adds, fitted to the votes alone.

    Each rule has its own chance of each vote in each class; classes are even a
    priori and a rule that abstains says nothing. The chances start from the given
    precisions (0.7 by default; ``moment_precisions`` finds some in closed form)
    and are re-estimated from the posteriors until they settle
    or ``epochs`` are done. As many pseudo-votes of the starting precision as a
    rule has votes keep rules that never meet another from drifting. Notes are read once, to count vote patterns, of
    which there are at most 3^rules: with few rules they are fitted in memory,
    with many every round is one aggregation over the written pattern table.
    """
    patterns = cut_lineage(df.groupBy(F.col(votes).alias("votes")).agg(F.count("*").alias("n")))
    fit = _fit_in_memory if n_rules <= in_memory_rules else _fit_on_table
    start = np.full(n_rules, _FIRST_PRECISION) if precisions is None else np.asarray(precisions, dtype=np.float64)
    return fit(patterns, n_rules, epochs, start)


def agreement_moments(df: DataFrame, n_rules: int, votes: str = "votes") -> DataFrame:
    """Per pair of rules ``first < second`` that ever both vote: rows where both do, and their mean agreement (1 or -1 a row).

    Rows are counted per vote pattern first, so that pairs are made of patterns only.
    """
    patterns = df.groupBy(F.col(votes).alias("v")).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(i).alias("first"), F.lit(j).alias("second")) for i in range(n_rules) for j in range(i + 1, n_rules)])
    each = patterns.select("v", "n", F.explode(pairs).alias("p")).select(
        "n", "p.first", "p.second", F.get("v", F.col("p.first")).alias("a"), F.get("v", F.col("p.second")).alias("b")
    ).filter((F.col("a") != fv.ABSTAIN) & (F.col("b") != fv.ABSTAIN))
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(-F.col("n"))
    return each.groupBy("first", "second").agg(F.sum("n").alias("n"), (F.sum(same) / F.sum("n")).alias("agreement"))


def moment_precisions(df: DataFrame, n_rules: int, votes: str = "votes") -> DataFrame:
    """``rule``, ``n_triples`` and ``precision`` of every rule, in closed form from pairwise agreements.

    If rules err on their own and classes are even, the agreement of two rules is the product of
    their edges (twice the precision less one), so three agreements give the edge of each: the root
    of ``m_ij * m_ik / m_jk``. A rule's edge is the median over its triples, 0.98 at most; a rule
    without a triple has precision 0.7. Rules are taken to be right more often than wrong.
    """
    moments = cut_lineage(agreement_moments(df, n_rules, votes).select("first", "second", "agreement"))
    turned = moments.select(F.col("second").alias("first"), F.col("first").alias("second"), "agreement")
    both = moments.unionByName(turned)
    # A table of at most rules squared rows, met twice.
    one = both.select(F.col("first").alias("rule"), F.col("second").alias("j"), F.col("agreement").alias("ij"))
    two = both.select(F.col("first").alias("rule"), F.col("second").alias("k"), F.col("agreement").alias("ik"))
    three = moments.select(F.col("first").alias("j"), F.col("second").alias("k"), F.col("agreement").alias("jk")).filter("jk <> 0")
    triples = one.join(two, "rule").filter("j < k").join(three, ["j", "k"])
    edge = F.least(F.sqrt(F.abs(F.col("ij") * F.col("ik") / F.col("jk"))), F.lit(_MOST_EDGE))
    edges = triples.groupBy("rule").agg(F.count("*").alias("n_triples"), F.percentile(edge, 0.5).alias("edge"))
    rules = df.sparkSession.range(n_rules).select(F.col("id").cast("int").alias("rule"))
    return rules.join(edges, "rule", "left").select(
        "rule", F.coalesce("n_triples", F.lit(0)).alias("n_triples"),
        F.coalesce((1 + F.col("edge")) / 2, F.lit(_FIRST_PRECISION)).alias("precision"),
    )


def label_model(
    df: DataFrame,
    n_rules: int,
    votes: str = "votes",
    probability: str = "probability",
    epochs: int = fv.VOTE_EPOCHS,
    from_moments: bool = False,
) -> DataFrame:
    """Add the fitted probability of the positive class; 0.5 where every rule abstains.

    ``from_moments`` starts the fit from the precisions in closed form, without a round of its own.
    """
    precisions = None
    if from_moments:
        precisions = [r["precision"] for r in moment_precisions(df, n_rules, votes).orderBy("rule").collect()]
    odds = fit_vote_model(df, n_rules, votes, epochs, precisions=precisions)
    # The posterior is a function of the votes, so rows need no join to get theirs.
    return df.withColumn(probability, _posterior(F.col(votes), odds))


def vote_label(probability: Column, threshold: float = fv.VOTE_LABEL_THRESHOLD) -> Column:
    """1 where the probability reaches the threshold, else 0."""
    return (probability >= threshold).cast("int")


def vote_diagnostics(
    df: DataFrame,
    first: tuple[str, str],
    second: tuple[str, str],
    threshold: float = fv.VOTE_LABEL_THRESHOLD,
) -> DataFrame:
    """No-signal rate, sure rows and accuracy of two vote models.

    ``first`` and ``second`` are (probability, true flag) columns. Accuracy is
    over rows whose flag is known.
    """
    (p1, t1), (p2, t2) = [(F.col(p), F.col(t)) for p, t in (first, second)]
    silent = F.count_if((p1 == 0.5) & (p2 == 0.5))

    def accuracy(p: Column, t: Column) -> Column:
        return F.avg((vote_label(p, threshold) == t).cast("double"))

    return df.agg(
        F.count("*").alias("total"),
        silent.alias("no_signal"),
        F.try_divide(silent * 100.0, F.count("*")).alias("no_signal_pct"),
        F.count_if(p1 > threshold).alias("sure_first"),
        F.count_if(p2 > threshold).alias("sure_second"),
        accuracy(p1, t1).alias("accuracy_first"),
        accuracy(p2, t2).alias("accuracy_second"),
    )
