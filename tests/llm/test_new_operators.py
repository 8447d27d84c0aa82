"""Language model, whitening and resampling against plain Python, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import html_text, licences, markov, resample, spectrum, whitening
from tests.llm.test_corpus import DOCS, ODD

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, 5, 5) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# Language model


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def _held(id_):
    return zlib.crc32(str("" if id_ is None else id_).encode()) % 5 == 1


def _plain_base(rows):
    train = Counter(t for id_, text in rows if not _held(id_) for t in _tokens(text))
    n, v = sum(train.values()), len(train)
    out = []
    for id_, text in rows:
        tokens = _tokens(text)
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((id_, _held(id_), len(tokens), sum(train[t] > 0 for t in tokens), n, base))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("most", [40, 1 << 16])
def test_base_scores(which, most, request):
    df = request.getfixturevalue(which)
    expected = _sorted(_plain_base([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))
    got = _sorted([tuple(r) for r in markov.score(df, states=3, rounds=2, most=most).collect()])
    assert len(got) == len(expected)
    for a, e in zip(got, expected):
        assert a[:5] == e[:5]
        assert a[5] == pytest.approx(e[5], rel=1e-9)
        assert math.isfinite(a[6]) and a[6] < 0


def test_states_that_only_emit_common_counts_give_the_base(docs):
    for r in markov.score(docs, states=3, rounds=2, most=100, share=1.0).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=1e-9)


def _plain_step(sequences, heads, model):
    """One step of Baum-Welch by sums over all states, without scaling."""
    k = len(model.start)
    words, steps, starts, total = np.zeros_like(model.emission), np.zeros((k, k)), np.zeros(k), 0.0
    for seq, head in zip(sequences, heads):
        alpha = [(model.start if head else model.shares) * model.emission[seq[0]]]
        for w in seq[1:]:
            alpha.append(alpha[-1] @ model.steps * model.emission[w])
        beta = [np.ones(k)]
        for w in seq[:0:-1]:
            beta.insert(0, model.steps @ (model.emission[w] * beta[0]))
        p = alpha[-1].sum()
        for t, w in enumerate(seq):
            gamma = alpha[t] * beta[t] / p
            words[w] += gamma
            if t == 0 and head:
                starts += gamma
            if t:
                steps += np.outer(alpha[t - 1], model.emission[w] * beta[t]) * model.steps / p
        total += math.log(p)
    return words, steps, starts, total


def test_expected_counts_and_likelihoods():
    rng = np.random.default_rng(5)
    model = markov.first_model(np.sort(rng.integers(-99, 99, 9)), np.arange(10.0), np.full(10, 0.09), states=4)
    sequences = [rng.integers(0, 11, n).tolist() for n in (1, 7, 3, 7, 12, 1)]
    heads = np.array([True, False, True, True, False, True])
    sizes = np.array([len(s) for s in sequences])
    places, starts = np.concatenate(sequences), np.cumsum(sizes) - sizes
    for got, expected in zip(markov.expected_counts(places, starts, sizes, heads, model), _plain_step(sequences, heads, model)):
        assert np.allclose(got, expected, rtol=1e-4, atol=1e-5)
    every = np.ones(len(sequences), bool)
    alone = [_plain_step([s], every[:1], model)[3] for s in sequences]
    assert np.allclose(markov.log_likelihoods(places, starts, sizes, model), alone)


def test_pieces_cover_each_sequence():
    starts, lengths, heads = markov._pieces(np.array([0, 5, 6]), np.array([5, 1, 4]), 2)
    assert list(zip(starts.tolist(), lengths.tolist(), heads.tolist())) == [
        (0, 2, True), (2, 2, False), (4, 1, False), (5, 1, True), (6, 2, True), (8, 2, False)
    ]


def test_emissions_of_a_state_sum_to_one():
    counts = np.array([3.0, 5.0, 2.0])
    own = (counts + 0.5) / 20
    model = markov.first_model(np.array([-4, 9]), counts, own, states=5)
    assert np.allclose(model.emission[:-1].sum(axis=0), own.sum())


def test_training_raises_the_likelihood_and_helps_held_out_texts(spark):
    rng = np.random.default_rng(1)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = markov.word_counts(df)
    table, n = markov.table_words(counts)
    own = np.concatenate(([320.5], n + 0.5)) / (n.sum() + 320 + 0.5 * (len(n) + 2))
    coded = markov.encoded(df, table).where("not held_out")
    _, likelihoods = markov.train(coded, markov.first_model(table, np.concatenate(([320], n)), own, states=4), rounds=8)
    assert all(b > a - 1e-4 * abs(a) for a, b in zip(likelihoods, likelihoods[1:]))
    held = markov.score(df, states=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] + 1000


def test_language_model_of_empty_tables(none, spark):
    assert markov.score(none).collect() == []
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if _held(i)], "doc_id long, text string")
    for r in markov.score(only_held).collect():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
        assert r["base_score"] == 0


# Whitening


def test_pivots_count_positive_eigenvalues():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 17, 40):
        a = rng.standard_normal((size, size))
        for matrix in (a + a.T, a @ a.T, -(a @ a.T), np.zeros((size, size)), np.diag(np.arange(size) - 1.0)):
            values = np.linalg.eigvalsh(matrix)
            clear = values[np.abs(values) > 1e-9]
            found = spectrum.positive_pivots(matrix)
            assert (clear > 0).sum() <= found <= (values > -1e-9).sum()


def test_leading_pairs():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for values in (np.arange(30.0), np.ones(30), np.repeat([3.0, 2.0, 1.0], 10), 1 + 1e-11 * np.arange(30), np.exp(-np.arange(30.0)), np.zeros(30)):
        matrix = (q * values) @ q.T
        found, vectors = spectrum.leading(matrix, 12)
        assert np.allclose(found, np.sort(values)[::-1][:12], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-10)
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-11)


def _plain_whitening(rows, components):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [i for i, _ in kept], deviations, centred @ vectors / np.sqrt(values), values / (centred ** 2).sum() * n


def test_whitening_of_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    extra = [(None, [0.5] * 64), (None, [0.5] * 64), (9001, None), (9002, [None] + [0.1] * 63), (9003, [math.nan] * 64),
             (9004, [math.inf] + [0.0] * 63), (9005, [1.0, 2.0])]
    both = df.unionByName(spark.createDataFrame(extra, df.schema)).withColumn("x", F.lit(3)).withColumn("v", F.lit("x")).withColumn("deviation", F.lit(0))
    rows = [(r["vec_id"], r["embedding"]) for r in both.collect() if r["vec_id"] != 9005]
    ids, deviations, expected, explained = _plain_whitening(rows, 32)
    got = whitening.report(both).collect()
    assert len(got) == 32 * len(ids)
    found = {}
    for r in got:
        assert r["n"] == len(ids) and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        found.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({k: 32 * n for k, n in Counter(zip(ids, deviations)).items()})
    matrix = np.array([[found[i, d][c] for c in range(1, 33)] for i, d in zip(ids, deviations)])
    signs = np.sign((matrix * expected).sum(axis=0))
    assert np.allclose(matrix, expected * signs, atol=1e-8)


def test_whitening_without_spread(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whitening.report(spark.createDataFrame(rows, kind))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert df.collect() == []
    # One direction of spread gives one component; entries too large for a long are cut off.
    rows = [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0])]
    got = whitening.report(spark.createDataFrame(rows, kind)).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and [r["explained"] for r in got] == [1.0] * 3
    assert sorted(abs(round(r["whitened"], 9)) for r in got) == [0.0, 1.224744871, 1.224744871]
    wild = whitening.report(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], kind)).collect()
    assert {r["deviation"] for r in wild} == {None} and {r["component"] for r in wild} <= {1, 2}


# Resampling


def _features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def _bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def _plain_scores(rows, target, run, buckets, seed=2024):
    s = Counter(_bucket(f, buckets) for _, text in rows for f in _features(text, run)[1])
    t = Counter(_bucket(f, buckets) for text in target for f in _features(text, run)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for id_, text in rows:
        n_words, found = _features(text, run)
        weight = sum(gain[_bucket(f, buckets)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        out.append((id_, len(found), n_words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("run,buckets,least,percent", [(1, 10_000, 20, 10), (3, 50, 1, 45), (2, 997, 0, 100)])
def test_resampling(which, run, buckets, least, percent, request, spark):
    df = request.getfixturevalue(which)
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = _plain_scores(rows, [r["text"] for r in target.collect()], run, buckets)
    got = resample.ranked(df, target, run, buckets, least, percent).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    able = sorted((r for r in expected if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranks] == [(r[0], r[4]) for r in drawn]
    kept = resample.draw(df, target, run, buckets, least, percent)
    assert kept.columns == df.columns
    ids = Counter((r[0], r[4]) for r in drawn)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in ids}


def test_resampling_of_empty_tables(none, docs, spark):
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert resample.ranked(none, target).collect() == []
    assert resample.draw(none, target).collect() == []
    assert resample.ranked(docs, target).where("rank is not null").count() == sum(
        _features(r["text"], 1)[0] >= 20 for r in docs.collect()) * 10 // 100


def test_texts_are_sliced_between_them(monkeypatch, docs, spark):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, resample.ranked(docs, target).collect()), key=repr)
    table = docs.select("text").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(resample, "SLICE_BYTES", 5000)
    parts = list(resample._slices(table, 0))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == table.num_rows
    assert len(whole) == docs.count()


# Main text of ordinary HTML


@pytest.mark.parametrize("page,expected", [
    ("<p>One</p><!-- old <script src=x> --><p>Two</p>", ["One", "Two"]),
    ("<p>One</p><script>if (a < b) x = '<!--';</script><p>Two</p>", ["One", "Two"]),
    ("<p>One <svg/> two</p><p>Three</p>", ["One two", "Three"]),
    ("<p>One <svg viewBox='0 0'><text>no</text></svg> two</p>", ["One two"]),
    ("<p>One <img src=a> two</p>", ["One two"]),
    ("<p><label>One</label> <nobr>two</nobr> <x-mark>three</x-mark></p>", ["One two three"]),
    ("<p>One <span class='ad'>buy</span> two</p>", ["One two"]),
    ("<p>One</p><div class='ad'>buy</div><p>two</p>", ["One", "two"]),
    ("<div>One<nav><li>Menu</li></nav>two</div>", ["One", "two"]),
    ("<article>Post</article><article class='comment'>Reader</article><article class='ad'>Buy</article>", ["Post"]),
    ("<div class='entry'><p>Post.</p></div><section id='comments'><article class='comment'>A much longer comment of a reader.</article></section>", ["Post."]),
    ("<main><p>Post</p><script>x</script><p>end</p></main><p>other</p>", ["Post", "end"]),
    ("<p>a<br>b</p>", ["a", "b"]),
    ("", []), ("<!--", []), ("<script>x", []), ("a <b>c", ["a c"]),
])
def test_main_text_of_ordinary_html(page, expected):
    found = html_text.blocks(page)
    main = [t for _, t, inside in found if inside]
    assert (main or [t for _, t, _ in found]) == expected


def test_generated_pages_give_back_their_article():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]

    def sentence():
        return " ".join(rng.choice(words, rng.integers(1, 9)))

    inline = ["{}", "<b>{}</b>", "<a href='/x?a=1&amp;b=2'>{}</a>", "<x-y>{}</x-y>", "<label>{}</label>", "{} <img src=i>", "<!-- <p>no</p> -->{}",
              "<span class=\"ad\">no</span> {}", "{} <svg/>", "<script>no</script> {}"]
    furniture = ["<nav><ul><li>no<li>no</ul></nav>", "<aside>no</aside>", "<div class='share'>no</div>", "<footer>no</footer>", "<style>no</style>",
                 "<form><input value=no>no</form>", "<article class='comment'><p>no</p></article>", "<template><p>no</p></template>"]
    for _ in range(300):
        blocks, page = [], ["<html><head><title>no</title></head><body>"]
        page.append(str(rng.choice(furniture)))
        page.append("<article class='post'>")
        for _ in range(rng.integers(1, 6)):
            parts = [sentence() for _ in range(rng.integers(1, 4))]
            blocks.append(" ".join(parts))
            name, closed = rng.choice(["p", "div", "h2", "li", "blockquote"]), rng.random() < 0.7
            body = " \n ".join(str(rng.choice(inline)).format(t) for t in parts)
            page.append(f"<{name}>{body}" + (f"</{name}>" if closed or name not in ("p", "li") else ""))
            if rng.random() < 0.3:
                page.append(str(rng.choice(furniture[:6])))
        page.append("</article>" + str(rng.choice(furniture)) + "</body></html>")
        found = html_text.blocks("".join(page))
        assert [t for _, t, inside in found if inside] == blocks, "".join(page)


# Licences


LICENCE_TEXTS = [
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd"),
    ("Licensed under a Creative Commons Attribution ShareAlike licence", "cc-by-sa"),
    ("Licensed under a Creative Commons Attribution 4.0 licence", "cc-by"),
    ("Licensed under Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
    ("This code is not licensed under the GNU General Public License", ""),
    ("It may not be distributed under the terms of the GNU General Public License as published by", ""),
    ("This is not advice. Licensed under the GNU General Public License version 3", "gpl"),
    ("you can redistribute it under the terms of the GNU Lesser General Public License as published by", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by", "agpl"),
    ("under the terms of the GNU General Public License as published by", "gpl"),
    ("# SPDX-License-Identifier: Apache-2.0", "apache-2"), ("# SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("not under the MIT License", "mit"),
    ("the share of the gnu in the commons", ""), ("", ""), (None, ""),
]


def test_licence_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENCE_TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licences.digest(licences.scan(df)).collect()}
    assert {LICENCE_TEXTS[i][0]: label for i, label in got.items()} == dict(LICENCE_TEXTS)
