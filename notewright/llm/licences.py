"""Licence scan: postings of rare licence words, intersected by relative position.

The document frequencies of the licence words are counted over the whole table. Each
template is looked up by its rarest word; at each posting of that word its key phrase must be
there whole, and the other words of the template must stand at their relative places. Where
the key phrase names the licence, a word of licensing near it does as well.

A key phrase that goes on to name another licence, or has a negated word of licensing before it,
gives no label; base phrases always do.

Null and empty texts have no words and no labels; rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import ascii_lower, let, text_of, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEAR = 0.8
# Words of licensing, and how many words before or after a key phrase they may stand.
LICENSING = ("covered", "distributed", "governed", "licensed", "redistribute", "released", "under")
REACH = 6


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    key: str
    base: bool = False
    named: bool = False
    # Words that, standing right behind the key phrase, name another licence.
    unless: tuple[str, ...] = ()


# How the names of further licences go on.
_FURTHER = ("noncommercial", "non", "noderivatives", "noderivs", "no", "sharealike", "share")
# Identifiers of licences as they stand behind "SPDX-License-Identifier:", in words.
SPDX = (
    ("agpl", "agpl"), ("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa"),
    ("gpl", "gpl"), ("isc", "isc"), ("lgpl", "lgpl"), ("mit", "mit"), ("mpl-2", "mpl 2 0"), ("unlicense", "unlicense"),
)
# Words that turn a notice round if they stand just before its licensing word.
NEGATIONS = ("not", "never", "cannot")
_TURNED = ("be", "been", "under", "covered", "subject", "distributed")

# The phrases that decide the base labels come first.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("gpl", "licensed under the gnu general public license version", "gnu general public license", named=True),
    Template("gpl", "subject to the terms of the gnu general public license", "gnu general public license"),
    Template("gpl", "under the terms of the gnu general public license as published by", "gnu general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license", "mozilla public license", named=True),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution", "creative commons attribution", named=True, unless=_FURTHER),
    Template("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial", unless=_FURTHER),
    Template("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("cc-by-nd", "creative commons attribution noderivatives", "creative commons attribution noderivatives"),
    Template("cc-by-nc-sa", "attribution noncommercial sharealike", "attribution noncommercial sharealike"),
    Template("cc-by-nc-nd", "attribution noncommercial noderivatives", "attribution noncommercial noderivatives"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license", named=True),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license", named=True),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("apache-2", "licensed under the apache license 2 0", "apache license 2 0", named=True),
    Template("mit", "licensed under the mit license", "mit license", named=True),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies", "this permission notice shall be included"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors", "nor the names of its contributors"),
    Template("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain"),
    *[Template(label, f"spdx license identifier {name}", f"spdx license identifier {name}") for label, name in SPDX],
)


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Documents that hold each licence word: at most one number per word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.phrase.split()})
    found = F.array_intersect(words(ascii_lower(text_of(text)), WORD), F.array(*[F.lit(w) for w in vocabulary]))
    counted = docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in counted}


def _rarest(template: Template, counts: dict[str, int]) -> int:
    """Place of the template's word of highest IDF among those of its key phrase; the first one of equals."""
    parts, key = template.phrase.split(), template.key.split()
    begin = next(i for i in range(len(parts)) if parts[i:i + len(key)] == key)
    return min(range(begin, begin + len(key)), key=lambda i: (counts[parts[i]], i))


def _matches(w: Column, postings: Column, template: Template, rare: int) -> Column:
    """Start and matched share of the template at each posting of its rarest word."""
    parts, key = template.phrase.split(), template.key.split()
    begin = next(i for i in range(len(parts)) if parts[i:i + len(key)] == key)

    def at(p: Column, i: int) -> Column:
        return F.coalesce(F.get(w, p - rare + i) == parts[i], F.lit(False))

    def near(p: Column) -> Column:
        first = p - rare + begin
        low = F.greatest(first - REACH, F.lit(0))
        return F.exists(F.slice(w, low + 1, first + len(key) + REACH - low), lambda x: x.isin(*LICENSING))

    def turned(p: Column) -> Column:
        """Whether a negation with a licensing word behind it stands just before or in the phrase."""
        low = F.greatest(p - rare + min(-4, begin - REACH - 2), F.lit(0))
        before = F.slice(w, low + 1, p - rare + begin - low + 1)
        pairs = F.transform(before, lambda x, i: x.isin(*NEGATIONS) & F.coalesce(F.get(before, i + 1).isin(*LICENSING, *_TURNED), F.lit(False)))
        return F.exists(pairs, lambda x: x)

    whole = F.filter(postings, lambda p: reduce(
        lambda a, b: a & b, [F.get(w, p) == parts[rare], *[at(p, i) for i in range(begin, begin + len(key))]]
    ))
    if template.unless:
        whole = F.filter(whole, lambda p: ~F.coalesce(F.get(w, p - rare + begin + len(key)).isin(*template.unless), F.lit(False)))
    if not template.base:
        whole = F.filter(whole, lambda p: ~turned(p))
    share = F.transform(whole, lambda p: F.struct(
        (p - rare).cast("long").alias("start"),
        (reduce(lambda a, b: a + b, [at(p, i).cast("int") for i in range(len(parts))]) / F.lit(len(parts))).alias("share"),
        (near(p) if template.named else F.lit(False)).alias("named"),
    ))
    return F.filter(share, lambda m: (m["share"] >= (1.0 if template.base else NEAR)) | m["named"])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``licence``: words, matches (label, base, start, share) and score.

    An existing column of that name is replaced.
    """
    counts = frequencies(docs, templates, text)
    rare = [_rarest(t, counts) for t in templates]
    anchors = sorted({t.phrase.split()[r] for t, r in zip(templates, rare)})

    def look(w: Column) -> Column:
        # Places of the rare words; sequence() counts down when it ends before its start.
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        postings = F.filter(places, lambda i: F.get(w, i).isin(*anchors))

        def matched(p: Column) -> Column:
            def named(t: Template, r: int) -> Column:
                return F.transform(_matches(w, p, t, r), lambda m: F.struct(
                    F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), m["start"].alias("start"), m["share"].alias("share")
                ))

            found = [named(t, r) for t, r in zip(templates, rare)]
            return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*found).alias("matches"))

        return let(postings, matched)

    return docs.withColumn("licence", let(words(ascii_lower(text_of(text)), WORD), look))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the licence report from ``scan``."""
    matches = F.col("licence")["matches"]
    base = F.filter(matches, lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def labels(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", F.col("licence")["n_words"].alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(matches).alias("labels"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
