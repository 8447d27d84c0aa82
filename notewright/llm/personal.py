"""Personal data by patterns, widened by bootstrapped contexts.

The matches of the fixed patterns are the seeds; mentions are the seeds and every other
identifier-like token. The lexical patterns of a mention are the word before it, the two words
before it, the word after it and the shape of the token. In each of ROUNDS rounds the patterns
are scored anew from the seeds and from what earlier rounds found: a pattern's score for a kind
is the share of its distinct values known to be of that kind. A value is judged without its own
share: it is found when, among the other values of one of its patterns, at least SEEDS and at
least CONFIDENCE of them are known. Tokens with a found value become spans of that kind, unless
the kind's own check refutes them (an address part over 255, a card number's check digit).
Patterns are counted over the whole table.

Null texts are empty. Rows are judged one by one; equal ids do not mix, as spans travel by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import text_of
from notewright.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.9
SEEDS = 5
ROUNDS = 3
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = ".,;:!?()[]<>\"'"
_REACH = 200


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, found from each ``@`` outward so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            out.append((begin, match.end()))
            last = match.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the fixed patterns' matches, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for kind, pattern, low, high in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def _word(word: str) -> str:
    """A word of a pattern: lower case, digits as one zero, no punctuation at its ends."""
    return re.sub("[0-9]+", "0", word.lower()).strip(_ENDS)


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns a mention stands in."""
    before = [w for w in map(_word, _WORD.findall(text[max(0, start - _REACH):start])) if w]
    after = next((w for w in map(_word, _WORD.findall(text[end:end + _REACH])) if w), None)
    out = ["shape " + re.sub("[0-9]+", "0", _LETTERS.sub("a", text[start:end]))]
    out += ["before " + " ".join(before[-n:]) for n in (1, 2) if len(before) >= n]
    return out if after is None else [*out, "after " + after]


def _refuted(value: str) -> str | None:
    """The kind whose form a token has and whose check it fails."""
    if _IP.search(value):
        return "ip"
    if any(16 <= len(re.sub("[^0-9]", "", m.group())) <= 19 for m in _CARD.finditer(value)):
        return "card"
    return None


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["row", "doc_id", "base", "mentions"]
    for part in parts:
        out = []
        for row, doc, text in part.itertuples(index=False):
            base = base_spans(text)
            mentions = [
                {"kind": k, "refuted": None, "first": a, "end": b, "patterns": _patterns(text, a, b), "value": text[a:b]} for k, a, b in base
            ]
            taken = sorted((a, b) for _, a, b in base)
            at = 0
            for m in _TOKEN.finditer(text):
                while at < len(taken) and taken[at][1] <= m.start():
                    at += 1
                if m.end() - m.start() >= 6 and not any(a < m.end() for a, _ in taken[at:at + 1]):
                    mentions.append({
                        "kind": None, "refuted": _refuted(m.group()), "first": m.start(), "end": m.end(),
                        "patterns": _patterns(text, m.start(), m.end()), "value": m.group(),
                    })
            out.append((row, doc, [{"kind": k, "first": a, "end": b} for k, a, b in base], mentions))
        yield pd.DataFrame(out, columns=columns)


def _found(mentions: DataFrame) -> DataFrame:
    """``value`` and ``kind`` of the values found in the last round; ``mentions`` has hashed values and patterns."""
    edges = cut_lineage(
        mentions.select("value", "kind", "refuted", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("kind").alias("seed"), F.max("refuted").alias("refuted"))
    )
    seeds = mentions.where("kind is not null").groupBy("value").agg(F.max("kind").alias("known"))
    found = None
    for _ in range(ROUNDS):
        known = seeds if found is None else seeds.unionByName(found.select("value", F.col("kind").alias("known")))
        marked = edges.join(known, "value", "left")
        counted = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("known") == k).alias(k) for k in KINDS])
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("sure")) for k in KINDS]))
        # No value can be found by a pattern that is not sure of the values beside a new one.
        able = counted.select("pattern", "n", each.alias("s")).select("pattern", "n", "s.*").where(
            (F.col("sure") >= SEEDS) & (F.col("sure") >= CONFIDENCE * (F.col("n") - 1))
        )
        own = F.when(F.col("known") == F.col("kind"), 1).otherwise(0)
        others = marked.where("seed is null").join(able, "pattern").where("refuted is null or refuted != kind").select(
            "value", "kind", (F.col("sure") - own).alias("sure"), (F.col("n") - 1).alias("others")
        ).where((F.col("sure") >= SEEDS) & (F.col("sure") >= CONFIDENCE * F.col("others")))
        best = F.max_by("kind", F.struct(F.col("sure") / F.col("others"), "kind"))
        found = cut_lineage(others.groupBy("value").agg(best.alias("kind")).join(seeds, "value", "left_anti"))
    return found


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (kind, first, end) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"))
    span = "array<struct<kind: string, first: long, end: long>>"
    mention = "struct<kind: string, refuted: string, first: long, end: long, patterns: array<string>, value: string>"
    found = cut_lineage(rows.mapInPandas(_scan, f"row long, doc_id string, base {span}, mentions array<{mention}>"))
    mentions = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*").withColumn("value", F.xxhash64("value"))
    sure = _found(mentions).select("value", F.col("kind").alias("found"))
    added = mentions.where("kind is null").join(sure, "value").groupBy("row").agg(
        F.collect_list(F.struct(F.col("found").alias("kind"), "first", "end")).alias("added")
    )
    return found.join(added, "row", "left").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "base", F.coalesce("added", F.array().cast(span)).alias("added")
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests per row; spans go by kind as listed, then start."""
    def spelled(spans):
        order = F.transform(spans, lambda s: F.struct(
            F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["first"].alias("a"), s["end"].alias("b"), s["kind"].alias("n")
        ))
        return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["n"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.concat("base", "added")).alias("spans")
    )


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of one text's spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
