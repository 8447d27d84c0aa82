"""Importance resampling towards a target distribution.

A feature is a run of words, hashed by CRC-32 to one of BUCKETS buckets. The corpus and the
target texts are counted by bucket; the gain of a bucket is the scaled log ratio of its shares
in the two, each count raised by one. A document weighs the floored mean gain of its features
and scores its weight plus Gumbel noise drawn from its id, so that the highest scores are a
sample without replacement in proportion to the exponential weights.

Texts are split by Arrow kernels: lowered, split, flattened and encoded by a dictionary. Runs
of several words are pairs of a shorter run and a shifted word index; CRCs are continued once
per distinct pair, gains are taken by bucket and added up per document. Counts leave a task as
one row a bucket. Only those rows and the gains, BUCKETS numbers each, meet the driver.

The draw is exact: digits of the score give the lowest score drawn, and the rows down to it are
numbered from one distributed sort, in which equal rows may lie in several tasks.

Null and empty texts have no features, weigh 0 and are drawn only if the least number of words
is 0. A null id draws its noise as the empty id and comes after all others among equal scores;
rows equal in id and score are ranked in no particular order. Texts are counted whole however
long; a batch of texts is cut into slices of about SLICE_BYTES, never inside a text. Other
columns, whatever their names, take no part. Without documents the result is empty; without
target texts every bucket's share of them is even.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notewright.llm.common import original
from notewright.operators.digits import at_ranks
from notewright.session import cut_lineage

RUN = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
# Characters between words: all of ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE_BYTES = 16 << 20


def features(texts: pa.Array, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the words per text."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), pattern=BETWEEN)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    whole = pc.not_equal(flat, "")
    coded = flat.filter(whole).dictionary_encode()
    owner = owner.filter(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    crc = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    found, owners = [crc[index] % buckets], [owner]
    ids = index
    for size in range(2, run + 1):
        # A run stands where the run before it does, if its last word is still of the same text.
        ids = ids[: len(index) - size + 1]
        inside = owner[: len(ids)] == owner[size - 1:]
        pairs, back = np.unique(ids * len(words) + index[size - 1:], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + words[p % len(words)], int(crc[p // len(words)])) for p in pairs.tolist()], dtype=np.int64)
        found.append((crc[back] % buckets)[inside])
        owners.append(owner[: len(ids)][inside])
        ids = back
    return np.concatenate(found), np.concatenate(owners), n_words


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text, one text at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _count_rows(batches: Iterator[pa.RecordBatch], run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for part in _slices(batch, 0):
            total += np.bincount(features(part.column(0), run, buckets)[0], minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and how many features of all texts fall into it."""
    rows = texts.select("text").mapInArrow(lambda batches: _count_rows(batches, run, buckets), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``gain`` of every bucket that a document's feature falls into."""
    corpus = bucket_counts(docs, run, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, run, buckets).withColumnRenamed("n", "t")
    sums = cut_lineage(corpus.join(wanted, "bucket", "full").fillna(0, ["s", "t"]))
    all_s, all_t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    above = (F.col("t").cast("double") + 1) * F.lit(float(all_s + buckets))
    below = (F.col("s").cast("double") + 1) * F.lit(float(all_t + buckets))
    return sums.where("s > 0").select("bucket", F.floor(SCALE * F.log(above / below)).cast("long").alias("gain"))


def _weight_rows(batches: Iterator[pa.RecordBatch], run: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, part_text := batch.num_columns - 1):
            found, owner, n_words = features(part.column(part_text), run, len(gain))
            n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
            # Features of one text are added up in runs of equal owners.
            order = np.argsort(owner, kind="stable")
            taken, total = gain[found[order]], np.zeros(part.num_rows, dtype=np.int64)
            if len(taken):
                total[n > 0] = np.add.reduceat(taken, (np.cumsum(n) - n)[n > 0])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.record_batch(
                [*part.columns[:-1], pa.array(n), pa.array(n_words), pa.array(weight)],
                names=[*part.schema.names[:-1], "n_features", "n_words", "weight"],
            )


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, scaled and floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, keep: list[Column], run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The ``keep`` columns with ``id``, ``n_features``, ``n_words``, ``weight`` and ``score`` of every row."""
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(docs, target, run, buckets).collect():  # at most one row a bucket
        gain[row["bucket"]] = row["gain"]
    rows = docs.select(*keep, F.col("doc_id").alias("id"), "text")
    schema = StructType([*rows.schema.fields[:-1], *[StructField(n, LongType()) for n in ("n_features", "n_words", "weight")]])
    weighed = rows.mapInArrow(lambda batches: _weight_rows(batches, run, gain), schema)
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _drawn_number(rows: DataFrame, least_words: int, percent: int) -> int:
    return percent * rows.where(F.col("n_words") >= least_words).count() // 100


def _lowest_score(rows: DataFrame, least_words: int, number: int) -> int:
    """The score of the last row drawn."""
    keyed = rows.where(F.col("n_words") >= least_words).select(F.lit("").alias("group"), (-F.col("score")).alias("key"))
    return -at_ranks(keyed, {"": [number]})["", number].key


def ranked(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
           percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight``, ``score`` and ``rank`` of every row; the rank is null where a row is not drawn."""
    rows = cut_lineage(scored(docs, target, [F.monotonically_increasing_id().alias("row")], run, buckets, seed))
    shown = ["id", "n_features", "n_words", "weight", "score"]
    number = _drawn_number(rows, least_words, percent)
    if not number:
        found = rows.select(*shown, F.lit(None).cast("long").alias("rank"))
        return found.withColumnRenamed("id", "doc_id")
    above = (F.col("n_words") >= least_words) & (F.col("score") >= _lowest_score(rows, least_words, number))
    ordered = rows.where(above).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    placed = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))
    # One count per partition of the sort.
    sizes = {r["slice"]: r["n"] for r in placed.groupBy(F.shiftright("at", 33).alias("slice")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for slice_ in range(max(sizes) + 1):
        starts.append((slice_, before))
        before += sizes.get(slice_, 0)
    offsets = docs.sparkSession.createDataFrame(starts, "slice long, before long")
    place = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    numbered = placed.withColumn("slice", F.shiftright("at", 33)).join(F.broadcast(offsets), "slice")
    numbered = numbered.select(*shown, F.when(place <= number, place).alias("rank"))
    rest = rows.where(~above).select(*shown, F.lit(None).cast("long").alias("rank"))
    return numbered.unionByName(rest).withColumnRenamed("id", "doc_id")


def draw(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
         percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns; all rows equal to the last one drawn in id and score stay."""
    ranks = cut_lineage(ranked(docs, target, run, buckets, least_words, percent, seed).where("rank is not null"))
    last = ranks.orderBy(F.desc("rank")).select("score", "doc_id").first()
    rows = scored(docs, target, [F.struct("*").alias("whole")], run, buckets, seed).where(F.col("n_words") >= least_words)
    if last is None:
        kept = rows.where(F.lit(False))
    else:
        id_ = F.lit(last["doc_id"])
        tied = F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("id") <= id_, F.lit(False))
        kept = rows.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied))
    return original(kept.select("whole.*"), docs.columns)
