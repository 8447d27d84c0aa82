"""Substring dedup by factors of whole texts against the indexed blocks of all texts.

Of each run of WINDOW words the block of BLOCK words with the least hash is its anchor, and
consecutive runs with one and the same block as anchor form a piece, so a piece has few runs and
each of them once. Equal runs have equal anchors, so the
index is that of the anchors: a first pass over the texts counts them, a second one looks
up every piece whose anchor occurs again. A piece found whole elsewhere lengthens the factor it
stands in; where a factor ends inside a piece, that is at its boundary, the runs of the
piece are looked up one by one. The words of a factor, which is always WINDOW words or more, are a
duplicate span. A factor may go on in another text than it began in, and the parsing of a text needs no
other text whole, so texts are shuffled once, to meet their spans.

The filter of the second pass is a bit table of at most FILTER_BITS bits. It lets
anchors through that occur once when it is full; those change no result.

Null and empty texts have no words. Equal texts are parsed alike; each run of a text with
copies occurs elsewhere. Nothing is judged on what is left after a removal. Pieces are
compared by anchor and a second hash, 64 bits each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import WORD, text_of, words
from notewright.session import cut_lineage

WINDOW = 35
BLOCK = 12
FILTER_BITS = 1 << 27
SLICE_WORDS = 1 << 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_WORD = re.compile(WORD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Runs:
    """Hashes of runs of words, by prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray, which: int):
        power = np.full(len(hashes) + 1, _BASES[which], dtype=np.uint64)
        self.back = np.full(len(hashes) + 1, _INVERSES[which], dtype=np.uint64)
        power[0] = self.back[0] = 1
        power = np.multiply.accumulate(power)
        self.back = np.multiply.accumulate(self.back)
        self.prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * power[:-1], out=self.prefix[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[first]) * self.back[first] + (end - first).astype(np.uint64))


def _least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` consecutive entries and the first place it stands at."""
    have, at = 1, np.arange(len(x), dtype=np.int32)
    while have < width:
        step = min(have, width - have)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return x, at


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a batch, a bounded number of words at a time: first row, word hashes, bounds."""
    column = batch.column("hashes")
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row = 0
    while row < len(bounds) - 1:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_WORDS, "right")) - 1)
        yield row, values[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def _pieces(hashes: np.ndarray, bounds: np.ndarray, window: int, block: int):
    """Text, first run, number of runs and anchor of every piece, and all runs in order."""
    if len(hashes) < window:
        return None
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    runs = np.flatnonzero(np.arange(len(hashes)) + window <= bounds[1:][text])
    if not len(runs):
        return None
    at = np.arange(len(hashes) - block + 1)
    least, place = _least(_Runs(hashes, 0)(at, at + block), window - block + 1)
    # A place lies in one text, so a piece does.
    place = place[runs]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return text[runs[first]], runs[first], np.diff(np.append(first, len(runs))), least[runs[first]].view(np.int64), runs


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, hashes, bounds in _slices(batch):
            found = _pieces(hashes, bounds, window, block)
            if found is not None:
                yield pa.record_batch({"anchor": found[3]})


def _piece_rows(
    batches: Iterator[pa.RecordBatch], window: int, block: int, table: np.ndarray
) -> Iterator[pa.RecordBatch]:
    mask = np.int64(len(table) * 64 - 1)
    for batch in batches:
        for row, hashes, bounds in _slices(batch):
            found = _pieces(hashes, bounds, window, block)
            if found is None:
                continue
            text, first, length, anchor, runs = found
            bit = anchor & mask
            known = (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
            runs = runs[np.repeat(known, length)]
            text, first, length, anchor = text[known], first[known], length[known], anchor[known]
            hash_of = _Runs(_mix(hashes), 1)
            lists = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            yield pa.record_batch({
                "key": batch.column("key").take(pa.array(text + row)),
                "start": (first - bounds[text]).astype(np.int32),
                "anchor": anchor,
                "whole": hash_of(first, first + length + window - 1).view(np.int64),
                "runs": pa.ListArray.from_arrays(pa.array(lists), pa.array(hash_of(runs, runs + window).view(np.int64))),
            })


def _kept_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for md5, text, factors in zip(part["md5"], part["text"], part["factors"]):
            found = _WORD.findall(text)
            gone = np.zeros(len(found) + 1, dtype=np.int64)
            if factors is not None:
                ends = np.asarray([(f["first"], f["end"]) for f in factors], dtype=np.int64)
                np.add.at(gone, ends[:, 0], 1)
                np.add.at(gone, ends[:, 1], -1)
            covered = np.cumsum(gone[:-1]) > 0
            kept = " ".join(w for w, c in zip(found, covered.tolist()) if not c)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
            spans = [{"first": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            out.append((md5, len(found), int(covered.sum()), kept, spans))
        yield pd.DataFrame(out, columns=["md5", "n_words", "n_removed", "kept", "spans"])


def _bit_table(repeated: DataFrame, most: int) -> np.ndarray:
    """A table of bits with those of the given anchors set, eight bits an anchor or ``most`` in all."""
    size = 64
    while size < min(most, 8 * repeated.count()):
        size *= 2
    bit = F.col("anchor").bitwiseAND(F.lit(size - 1))
    entries = repeated.groupBy(F.shiftright(bit, 6).alias("place")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).toPandas()
    table = np.zeros(size // 64, dtype=np.int64)
    table[entries["place"].to_numpy(dtype=np.int64)] = entries["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("first"), end.cast("int").alias("end"))


def _factors(pieces: DataFrame, window: int) -> DataFrame:
    """The factors of each text that has some: ``key`` and ``factors``, which may overlap."""
    kinds = cut_lineage(pieces.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.first("runs").alias("runs")))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    edges = cut_lineage(kinds.join(several, "anchor", "left_semi").select(
        "anchor", "whole", "n", F.posexplode("runs").alias("place", "run")
    ))
    twice = edges.groupBy("anchor", "run").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "run")
    parts = edges.where("n = 1").join(twice, ["anchor", "run"], "left_semi").groupBy("anchor", "whole").agg(
        F.collect_list("place").alias("places")
    )
    whole = kinds.where("n > 1").select("anchor", "whole", F.lit(None).cast("array<int>").alias("places"))
    found = pieces.select("key", "start", "anchor", "whole", F.size("runs").alias("length")).join(
        whole.unionByName(parts), ["anchor", "whole"]
    )
    start = F.col("start")
    spans = F.when(F.col("places").isNull(), F.array(_span(start, start + F.col("length") + (window - 1)))).otherwise(
        F.transform("places", lambda p: _span(start + p, start + p + window))
    )
    return found.select("key", F.explode(spans).alias("span")).groupBy("key").agg(F.collect_set("span").alias("factors"))


def parse(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per distinct text: ``md5``, ``n_words``, ``n_removed``, ``kept`` text and word ``spans`` of its repeated runs."""
    texts = docs.select(F.md5(text_of()).alias("md5"), text_of().alias("text"))
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    anchors = texts.select(hashes).mapInArrow(lambda rows: _anchor_rows(rows, window, block), "anchor long")
    repeated = cut_lineage(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(repeated, filter_bits))
    pieces = cut_lineage(texts.select(F.unhex("md5").alias("key"), hashes).mapInArrow(
        lambda rows: _piece_rows(rows, window, block, table.value),
        "key binary, start int, anchor long, whole long, runs array<long>",
    ))
    factors = cut_lineage(_factors(pieces, window)).select(F.lower(F.hex("key")).alias("md5"), "factors")
    distinct = texts.groupBy("md5").agg(F.first("text").alias("text"))
    return distinct.join(factors, "md5", "left").select("md5", "text", "factors").mapInPandas(
        _kept_rows, "md5 string, n_words long, n_removed long, kept string, spans array<struct<first: long, end: long>>"
    )


def digest(docs: DataFrame) -> DataFrame:
    """The report per document: words, words removed, and a digest of the words kept."""
    parsed = parse(docs).select("md5", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", F.md5(text_of()).alias("md5")).join(cut_lineage(parsed), "md5").drop("md5")


def removed_digest(text: str, covered: list[bool]) -> str:
    """The digest of one text, for tests."""
    kept = " ".join(w for w, c in zip(_WORD.findall(text), covered) if not c)
    return hashlib.sha256(kept.encode()).hexdigest()
