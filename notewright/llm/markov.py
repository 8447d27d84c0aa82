"""A hidden Markov language model over whole texts.

A text is its words and one end token. Every state emits a word either from its own table or,
with probability SHARE, from the counts of all words, so no word of the corpus is impossible in
a state. States have tables for the WORDS most frequent words (a size of the model, as the
number of states is); all other words have the same probability in every state, by their own
counts over the whole training corpus. The emission of every state sums to one over all known
words and one unknown word.

Training is Baum-Welch: each round, tasks run scaled forward and backward recursions over their
texts and leave one row a word with the expected counts of its states, which are added up by
word. Long texts are trained in pieces of PIECE words, later pieces starting from the states'
shares, so that the recursion of a task is bounded. The likelihood is exact: the scaled forward
recursion runs over the whole text, however long.

Counts of words, the number of tokens and of distinct words cover all training texts; words that
have no table are counted per text and meet their counts in a join, with nothing left out. Words
are compared by 64-bit hashes.

Null and empty texts are one end token. A null id counts as the empty id, which trains. Repeated
rows count as often as they stand. Without training texts every word is unknown. Other columns,
whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from notewright.llm.common import ascii_lower, text_of, words
from notewright.operators.digits import at_ranks
from notewright.session import cut_lineage

STATES = 8
ROUNDS = 8
WORDS = 1 << 16
SHARE = 0.1
PIECE = 256
SEED = 11
FOLDS, HELD_FOLD = 5, 1
# Tokens that a task works on at once, one text at least.
TOKENS = 1 << 19


@dataclass(frozen=True)
class Model:
    """Start and transition probabilities, shares of the states, and emissions: a row a table word, then one for all others.

    Row 0 is the end token. ``emission`` holds whole probabilities; the last row is one, as the
    probability of a word without a table is the same in all states and counted apart.
    """

    start: np.ndarray
    steps: np.ndarray
    shares: np.ndarray
    emission: np.ndarray
    own: np.ndarray


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % FOLDS == HELD_FOLD


def _hashes() -> Column:
    return F.transform(words(ascii_lower(text_of())), lambda w: F.xxhash64(w))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` over the training texts, written to the shared folder."""
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.explode(_hashes()).alias("word"))
    return cut_lineage(rows.groupBy("word").agg(F.count(F.lit(1)).alias("c")))


def table_words(counts: DataFrame, most: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words; of words equally frequent all or none."""
    known = counts.count()
    rows = counts
    if known > most:
        keyed = counts.select(F.lit("").alias("group"), (-F.col("c")).alias("key"))
        rows = counts.where(F.col("c") > -at_ranks(keyed, {"": [most + 1]})["", most + 1].key)
    found = rows.toArrow()  # at most ``most`` rows
    hashes, n = (found.column(name).to_numpy().astype(np.int64) for name in ("word", "c"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``most`` entries of a list column, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _encode(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Table places of the tokens of each text, the end token last, and the hashes of words without one."""
    others = len(table) + 1
    for batch in _slices(batches, 3, TOKENS):
        lists = batch.column(3)
        hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.searchsorted(table, hashes)
        known = table[np.minimum(at, others - 2)] == hashes if len(table) else np.zeros(len(hashes), dtype=bool)
        places = np.full(len(hashes) + len(sizes), 0, dtype=np.int32)
        inner = np.ones(len(places), dtype=bool)
        inner[ends + np.arange(len(sizes))] = False
        places[inner] = np.where(known, at + 1, others)
        # Words without a table once a text, with how often it holds them.
        owner, rare = np.repeat(np.arange(len(sizes)), sizes)[~known], hashes[~known]
        order = np.lexsort((rare, owner))
        owner, rare = owner[order], rare[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])))[: len(rare)])
        bounds = pa.array(np.searchsorted(owner[first], np.arange(len(sizes) + 1)), pa.int32())
        times = np.diff(np.concatenate((first, [len(rare)])))
        yield pa.record_batch(
            [
                *batch.columns[:-1],
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + np.arange(1, len(sizes) + 1))), pa.int32()), pa.array(places)),
                pa.ListArray.from_arrays(bounds, pa.array(rare[first])),
                pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
            ],
            names=[*batch.schema.names[:-1], "places", "rare", "times"],
        )


def encoded(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``row``, ``doc_id``, ``held_out``, token ``places``, and hashes and ``times`` of the ``rare`` words of every text, written to the shared folder."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), _hashes().alias("hashes")
    )
    schema = StructType([
        *rows.schema.fields[:-1], StructField("places", ArrayType(IntegerType())), StructField("rare", ArrayType(LongType())),
        StructField("times", ArrayType(IntegerType())),
    ])
    return cut_lineage(rows.mapInArrow(lambda batches: _encode(batches, table), schema))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _emission(weights: np.ndarray, own: np.ndarray, share: float) -> np.ndarray:
    """Emissions from the states' expected counts of table words and the words' own probabilities."""
    totals = weights.sum(axis=0)
    apart = np.divide(weights, totals, out=np.repeat(own[:, None] / own.sum(), weights.shape[1], axis=1), where=totals > 0)
    return np.vstack([(1 - share) * own.sum() * apart + share * own[:, None], np.ones(weights.shape[1])])


def first_model(table: np.ndarray, counts: np.ndarray, own: np.ndarray, states: int = STATES, share: float = SHARE, seed: int = SEED) -> Model:
    """States that differ by hashes of the words, all steps but staying equally likely."""
    keys = np.concatenate(([np.int64(0)], table)).view(np.uint64)
    noise = np.stack([_mix(keys ^ _mix(np.uint64(seed * 1000 + k) + np.zeros(1, np.uint64))) for k in range(states)], axis=1)
    weights = np.maximum(counts, 0)[:, None] * (0.5 + noise.astype(np.float64) / 2.0 ** 64)
    steps = (np.ones((states, states)) + states * np.eye(states)) / (2 * states)
    even = np.full(states, 1 / states)
    return Model(even, steps, even, _emission(weights, own, share), own)


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    ended = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)
    return order, len(lengths) - np.cumsum(ended)[:-1] if len(lengths) else np.zeros(0, dtype=np.int64)


def log_likelihoods(places: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each sequence by the scaled forward recursion."""
    out = np.zeros(len(starts))
    order, running = _lanes(lengths)
    begin, ones, state = starts[order], np.ones(len(model.start)), None
    for t, n in enumerate(running.tolist()):
        emitted = model.emission.take(places[begin[:n] + t], axis=0)
        state = model.start * emitted if t == 0 else (state[:n] @ model.steps) * emitted
        scale = state @ ones
        state *= (1 / scale)[:, None]
        out[:n] += np.log(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def expected_counts(places: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray, model: Model):
    """Expected counts of one Baum-Welch step: words by state, steps, starts, and the log likelihood.

    ``heads`` marks sequences that begin a text; the others begin inside one.
    """
    states, half = len(model.start), np.float32
    order, running = _lanes(lengths)
    begin, head = starts[order], heads[order]
    emission, forward, ones = model.emission.astype(half), model.steps.astype(half), np.ones(states, half)
    back = np.ascontiguousarray(forward.T)
    # Per step: places, forward probabilities, emissions over scales.
    trail, logs, state = [], 0.0, None
    for t, n in enumerate(running.tolist()):
        at = places[begin[:n] + t]
        emitted = emission.take(at, axis=0)
        if t == 0:
            state = np.where(head[:n, None], model.start.astype(half), model.shares.astype(half)) * emitted
        else:
            state = state[:n] @ forward
            state *= emitted
        scale = state @ ones
        logs += float(np.log(scale).sum(dtype=np.float64))
        over = (1 / scale)[:, None]
        state *= over
        emitted *= over
        trail.append((at, state, emitted))
    words_, steps = np.zeros((len(emission), states)), np.zeros((states, states))
    if not trail:
        return words_, steps, np.zeros(states), 0.0
    weights = np.empty((int(running.sum()), states), half)
    end = len(weights)
    beta = np.ones((len(order), states), half)
    for t in range(len(trail) - 1, -1, -1):
        _, state, ahead = trail[t]
        n = len(state)
        np.multiply(state, beta[:n], out=weights[end - n:end])
        end -= n
        if t:
            ahead *= beta[:n]
            steps += trail[t - 1][1][:n].T @ ahead
            beta[:n] = ahead @ back
    at = np.concatenate([a for a, _, _ in trail])
    for k in range(states):
        words_[:, k] = np.bincount(at, weights=weights[:, k], minlength=len(words_))
    return words_, steps * model.steps, weights[: len(head)][head].sum(axis=0, dtype=np.float64), logs


def _sequences(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their tokens, where they start and how many they are."""
    for part in _slices(batches, column, most):
        sizes = part.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes


def _pieces(starts: np.ndarray, sizes: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of the sequences, and which of them begin a text."""
    n = -(-sizes // piece)
    owner = np.repeat(np.arange(len(sizes)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return starts[owner] + number * piece, np.minimum(piece, sizes[owner] - number * piece), number == 0


def _count_rows(batches: Iterator[pa.RecordBatch], model: Model, piece: int) -> Iterator[pa.RecordBatch]:
    """The expected counts of a task: rows of places, then steps (places from -1 down), starts and the likelihood."""
    states = len(model.start)
    total, steps, heads, likelihood = np.zeros_like(model.emission), np.zeros((states, states)), np.zeros(states), 0.0
    for _, places, starts, sizes in _sequences(batches, 0, TOKENS):
        counts = expected_counts(places, *_pieces(starts, sizes, piece), model)
        total, steps, heads, likelihood = total + counts[0], steps + counts[1], heads + counts[2], likelihood + counts[3]
    held = np.flatnonzero(total.sum(axis=1))
    rows = np.vstack([total[held], steps, heads, np.full(states, likelihood)]).astype(np.float32)
    place = np.concatenate([held, -1 - np.arange(states + 2)]).astype(np.int32)
    yield pa.record_batch([pa.array(place), *[pa.array(rows[:, k]) for k in range(states)]], names=["place", *[f"s{k}" for k in range(states)]])


def train(texts: DataFrame, model: Model, rounds: int = ROUNDS, share: float = SHARE, piece: int = PIECE) -> tuple[Model, list[float]]:
    """The model after ``rounds`` of Baum-Welch over ``places`` of ``texts``, and the log likelihood before each."""
    states, likelihoods = len(model.start), []
    columns = [f"s{k}" for k in range(states)]
    context = texts.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(model)
        rows = texts.select("places").mapInArrow(
            lambda batches, shared=shared: _count_rows(batches, shared.value, piece), "place int, " + ", ".join(f"{c} float" for c in columns)
        )
        found = rows.groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # a row a table word
        shared.unpersist()
        place = found.column("place").to_numpy()
        values = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
        counts = np.zeros((len(model.emission) + states + 2, states))
        counts[place] = values
        if counts[-states - 2:].sum() == 0:
            break
        # Rows from the end: steps of state 0 at -1, and so on.
        steps, heads, likelihood = counts[[-1 - k for k in range(states)]], counts[-1 - states], float(counts[-2 - states][0])
        by_word = counts[: len(model.emission)]
        likelihoods.append(likelihood)
        # The part of a word's count that its state's own table, not the common counts, accounts for.
        part = 1 - share * model.own[:, None] / model.emission[:-1]
        steps = steps + 1 / states
        shares = by_word.sum(axis=0) + 1 / states
        model = Model(
            (heads + 1 / states) / (heads.sum() + 1), steps / steps.sum(axis=1, keepdims=True), shares / shares.sum(),
            _emission(by_word[:-1] * part, model.own, share), model.own,
        )
    return model, likelihoods


def _score_rows(batches: Iterator[pa.RecordBatch], model: Model, logs: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, places, starts, sizes in _sequences(batches, 3, 2 * TOKENS):
        score = log_likelihoods(places, starts, sizes, model) / np.log(10)
        yield pa.record_batch(
            [
                *part.columns[:3], pa.array(sizes), pa.array(np.add.reduceat(known[places], starts).astype(np.int64)),
                pa.array(np.add.reduceat(logs[places], starts)), pa.array(score),
            ],
            names=[*part.schema.names[:3], "n_tokens", "n_known", "base", "hidden"],
        )


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, most: int = WORDS, share: float = SHARE, piece: int = PIECE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every text.

    Scores are log10 probabilities: by the counts of words alone, and by the trained model.
    """
    counts = word_counts(docs)
    texts = docs.where(~held_out(F.col("doc_id"))).count()
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = size["n"] + texts, size["v"] + (texts > 0)
    table, table_counts = table_words(counts, most)
    coded = encoded(docs, table)
    all_counts = np.concatenate(([texts], table_counts)).astype(np.float64)
    below = tokens + 0.5 * (distinct + 1)
    own = (all_counts + 0.5) / below
    first = first_model(table, all_counts, own, states, share, seed)
    model, _ = train(coded.where("not held_out"), first, rounds, share, piece)
    logs = np.concatenate([np.log10(own), [0.0]])
    known = np.concatenate([all_counts > 0, [False]])
    shared = docs.sparkSession.sparkContext.broadcast((model, logs, known))
    schema = StructType([
        *coded.schema.fields[:3], StructField("n_tokens", LongType()), StructField("n_known", LongType()),
        StructField("base", DoubleType()), StructField("hidden", DoubleType()),
    ])
    scored = coded.select("row", "doc_id", "held_out", "places").mapInArrow(lambda batches: _score_rows(batches, *shared.value), schema)
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", "w.times", F.col("w.rare").alias("word"))
    found = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10((F.col("c") + 0.5) / F.lit(below))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * log).alias("rare_log")
    )
    joined = cut_lineage(scored).join(sums, "row", "left").na.fill(0, ["rare_known", "rare_log"])
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_log")).alias("base_score"), (F.col("hidden") + F.col("rare_log")).alias("score"),
    )
