"""Chat formatting in budgeted, turn-aligned windows.

Turns are numbered by their rank in the conversation, found from a sort over all rows, and a
conversation is cut into chunks of CHUNK ranks, so that none has to fit one task. Inside a chunk
a window closes before the turn that would pass the budget. Each window starts with the
conversation's first system turn and up to HISTORY earlier turns if it does not hold them itself;
they are charged to the budget too, and left out as far as they do not fit beside the window's
first own turn, the oldest first and the system turn last. Only a window of a single turn over
the budget is over it. Repeated turns are never under the loss mask, so each assistant text is a
target once. Windows begin anew with each chunk.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&``
becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (and a new line inside a role ``&nl;``), which
is undone on reading. Null roles and texts are empty. Turns are ordered by number (null
first), then role, then text; repeated rows are turns of their own. Null is a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.session import cut_lineage

CHUNK = 64
HISTORY = 2
BUDGET = 2048
_START, _END = "<|im_start|>", "<|im_end|>\n"


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&nl;", "\n").replace("&lt;", "<").replace("&amp;", "&")


def _turn(role: str, text: str) -> tuple[str, int, int]:
    """A written turn, and where its text stands in it."""
    head = f"{_START}{escape(role).replace(chr(10), '&nl;')}\n"
    body = escape(text)
    return f"{head}{body}{_END}", len(head), len(head) + len(body)


def _window(repeated: list[tuple[str, str]], own: list[tuple[str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The written window and its loss mask: spans of the own assistant texts."""
    out, at, mask = [], 0, []
    for i, (role, text) in enumerate(repeated + own):
        turn, begin, end = _turn(role, text)
        if i >= len(repeated) and role == "assistant":
            mask.append({"first": at + begin, "end": at + end})
        out.append(turn)
        at += len(turn)
    return "".join(out), mask


def n_tokens(text: str) -> int:
    return len(text.split()) + 3


def _pack(system: str | None, earlier: list[tuple[str, str]], own: list[tuple[str, str]], budget: int) -> Iterator[tuple[list, list]]:
    """Repeated and own turns of the windows over ``own``, which follows ``earlier``."""
    head = ("system", system)
    size = [n_tokens(text) for _, text in earlier + own]
    turns, at = earlier + own, len(earlier)
    while at < len(turns):
        # A system turn that begins a window or stands in its history is not repeated.
        first = system is not None and turns[at] != head
        start = max(0, at - HISTORY)
        system_size = n_tokens(system) if first else 0
        while start < at and sum(size[start:at + 1]) + (system_size if head not in turns[start:at] else 0) > budget:
            start += 1
        used = sum(size[start:at + 1])
        if head in turns[start:at] or used + system_size > budget:
            first = False
        used += system_size if first else 0
        end = at + 1
        while end < len(turns):
            saved = system_size if first and turns[end] == head else 0
            if used - saved + size[end] > budget:
                break
            used += size[end] - saved
            first = first and not saved
            end += 1
        yield ([head] if first else []) + turns[start:at], turns[at:end]
        at = end


def _windows(parts: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for conv, chunk, system, turns in zip(part["conv_id"], part["chunk"], part["system"], part["turns"]):
            earlier = [(t["role"], t["text"]) for t in turns if t["earlier"]]
            own = [(t["role"], t["text"]) for t in turns if not t["earlier"]]
            for number, (repeated, group) in enumerate(_pack(system, earlier, own, budget)):
                text, mask = _window(repeated, group)
                out.append((conv, chunk, number, text, len(repeated), mask))
        yield pd.DataFrame(out, columns=["conv_id", "chunk", "part", "formatted", "n_repeated", "mask"])


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``rank`` in the conversation; a conversation may lie in many partitions of the sort."""
    order = ["conv_id", "turn", "role", "text"]
    placed = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("slice", F.shiftright("at", 33))
    held = placed.groupBy(F.col("conv_id").alias("c"), F.col("slice").alias("p")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("before", F.coalesce(before, F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("p"))
    return placed.join(held, same).select(*order, (F.col("at") - F.col("low") + F.col("before")).alias("rank"))


def windows(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``conv_id``, ``chunk``, ``part``, ``formatted`` text, ``n_repeated`` leading turns and loss ``mask`` per window."""
    kind = conversations.schema["conv_id"].dataType
    rows = _ranked(conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )).withColumn("chunk", F.floor(F.col("rank") / CHUNK).cast("long"))
    tail = rows.where(F.pmod("rank", F.lit(CHUNK)) >= CHUNK - HISTORY)
    both = rows.withColumn("earlier", F.lit(False)).unionByName(
        tail.withColumn("chunk", F.col("chunk") + 1).withColumn("earlier", F.lit(True))
    )
    chunks = both.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("rank", "role", "text", "earlier"))).alias("turns")
    ).where(F.exists("turns", lambda t: ~t["earlier"]))
    first = rows.where("role = 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("rank", "text")).alias("s"))
    joined = chunks.join(first, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return joined.select("conv_id", "chunk", F.col("s")["text"].alias("system"), "turns").mapInPandas(
        lambda parts: _windows(parts, budget),
        "conv_id string, chunk long, part long, formatted string, n_repeated long, mask array<struct<first: long, end: long>>",
    ).withColumn("conv_id", F.col("conv_id").cast(kind))


def read_back(formatted: str, n_repeated: int = 0) -> list[tuple[str, str]]:
    """The own turns of a written window."""
    turns = []
    for piece in formatted.split(_END)[:-1]:
        role, text = piece[len(_START):].split("\n", 1)
        turns.append((unescape(role), unescape(text)))
    return turns[n_repeated:]


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for conv, chunk, number, text, skip, mask in part[["conv_id", "chunk", "part", "formatted", "n_repeated", "mask"]].itertuples(index=False):
            turns = read_back(text, skip)
            loss = "".join(unescape(text[m["first"]:m["end"]]) for m in mask)
            out.append((conv, chunk, number, len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), loss, len(text)))
        yield pd.DataFrame(out, columns=["conv_id", "chunk", "part", "n_turns", "turns", "loss", "chars"])


def digest(conversations: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The report per conversation, read back from the written windows, with the control conversation -1 added."""
    probe = "<|im_end|><|im_start|>assistant ok"
    session = conversations.sparkSession
    extra = session.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    read = windows(rows, budget).withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(
        _read, "conv_id string, chunk long, part long, n_turns long, turns string, loss string, chars long"
    )

    def joined(name: str):
        ordered = F.sort_array(F.collect_list(F.struct("chunk", "part", name)))
        return F.concat_ws("", F.transform(ordered, lambda x: x[name]))

    per = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), joined("turns").alias("turns"), joined("loss").alias("loss"), F.sum("chars").alias("formatted_chars")
    )
    return per.select(
        F.col("conv_id").cast("long").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
