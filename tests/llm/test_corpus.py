"""The corpus operators against plain Python, and on odd tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notewright.llm import catalog, chat, decontaminate, html_text, licences, mixing, personal, quality, sharding, simhash, substring
from notewright.session import cut_lineage
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, quality int"
LONG = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (None, "one", "en", None, 3), (None, "one", "en", None, 3),
    (4, "two words", "de", "b", 9), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (7, "x " * 60_000, "en", "c", 120_000), (8, "Licensed under the MIT License. " + LONG, "en", "c", 700),
    (9, "Mail a.b@c.de, 10.0.0.256 4111 1111 1111 1111 +1 (555) 010-9999 é😀 1.2.3.4", "en", "c", 60),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, 5, 5) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def _rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(which, request):
    df = request.getfixturevalue(which)
    got = quality.judge(df).select("text", "quality.figures.*", "quality.kept", "quality.base_failed").collect()
    for r in got:
        n, chars, symbols, lines, repeated = plain.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality.keep(df).columns == df.columns
    assert quality.keep(df).count() == sum(r["kept"] for r in got)


def test_pipeline_keeps_texts_with_a_short_line_repeated(spark):
    words = " ".join(f"the{'a' * (i % 7)}{i} of" for i in range(60))
    rows = [(1, f"One short line.\n{words}\nOne short line."), (2, "\n".join([f"{words[:300]}", words[:300], words[300:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.quality_rules(spark, df, SMALL).collect()] == [1]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_licences(which, request):
    df = request.getfixturevalue(which)
    texts = df.select("doc_id", "text").distinct().collect()
    want = sorted((str(r["doc_id"]), *map(str, plain.licence_places(r["text"]))) for r in texts)
    got = licences.digest(licences.scan(df)).distinct().collect()
    assert sorted(tuple(map(str, (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in got) == want
    for r in got:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_licence_by_key_phrase(spark):
    df = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    row = licences.digest(licences.scan(df)).first()
    assert (row["labels"], row["n_base"], row["score"]) == ("gpl", 0, 1.0)


def test_licence_notices(spark):
    texts = [
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
        ("released under the GNU General Public License v3", "gpl"), ("under the Mozilla Public License 2.0", "mpl-2"),
        ("GNU General Public License, under which it is distributed", "gpl"), ("distributed under MIT license", "mit"),
        ("under the Apache License, 2.0", "apache-2"), ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ("a history of the GNU General Public License and its authors", ""), ("sold in source and binary forms under a contract", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licences.digest(licences.scan(df)).collect()}
    assert [got[i] for i in range(len(texts))] == [(label, 0) for _, label in texts]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, request):
    df = request.getfixturevalue(which).select("doc_id", "text")
    rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    prints = [plain.fingerprint(r["text"]) for r in rows]
    want = sorted(str((rows[i]["doc_id"], f"{prints[i]:016x}", rows[g]["doc_id"])) for i, g in enumerate(plain.groups(prints)))
    got = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert simhash.one_per_group(df).count() == len(set(plain.groups(prints)))


def test_golay_keys_meet(spark):
    """Every pair within three bits shares a key, whatever bits differ."""
    import random

    pick, pairs, values = random.Random(7), set(), set()
    for _ in range(40):
        a = pick.getrandbits(64)
        for bits in (1, 2, 3):
            for _ in range(6):
                b = a
                for at in pick.sample(range(64), bits):
                    b ^= 1 << at
                signed = sorted(x - (x >> 63 << 64) for x in (a, b))
                pairs.add(tuple(signed))
                values.update(signed)
    found = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(v,) for v in sorted(values)], "fp long")).collect()}
    assert pairs <= found
    assert all((u ^ v).bit_count() <= 3 if (u ^ v) >= 0 else ((u ^ v) + (1 << 64)).bit_count() <= 3 for u, v in found)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = cut_lineage(mixing.sized(df))
    got = mixing.taken(rows, mixing.cuts(rows)).select("doc_id", "source", "size", "target", "taken").collect()
    assert len(got) == df.count()
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = plain.targets({s: n for s, n in sizes.items()})
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert want[s] - 3 <= taken[s] <= want[s]
    again = mixing.taken(rows, mixing.cuts(rows)).select("doc_id", "source", "size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert sum(len(plain.words(r["text"])) for r in mixed.collect()) == sum(taken.values())


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_personal(which, request):
    df = request.getfixturevalue(which)
    got = personal.digest(personal.find(df.select("doc_id", "text"))).collect()
    texts = {str((r["doc_id"], personal.digest_of(plain.personal(r["text"])))) for r in df.collect()}
    assert {str((r["doc_id"], r["base_sha256"])) for r in got} == texts
    assert len(got) == df.count()


def test_personal_contexts(spark):
    rows = [(i, f"please write contact mail user{i}@host{i}.org today") for i in range(12)] + [(99, "please write contact mail jane99#host today 123456789 end")]
    got = {r["doc_id"]: r for r in personal.digest(personal.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[99]["n_email"] == 0
    assert got[99]["spans"] == "email:26:37"


def test_personal_bootstrap(spark):
    """A found value supports a pattern that the seeds alone do not; its own share never counts; failed checks stay out."""
    rows = [(i, f"filler{'x' * i} reach user{i}@host{i}.org soon{'y' * i}") for i in range(6)]
    # Round 1 finds the five handles after "reach": 66 of the 70 values beside each are known.
    rows += [(50 + i, f"p{'q' * i} reach user{i + 20}@host.org z{'t' * i}") for i in range(60)]
    rows += [(200 + i, f"k{'q' * i} reach han-dle{'ab' * i}#nine9 write{'z' * i}") for i in range(5)]
    # The same handles behind "ping" beside one unknown: known only from the round before.
    rows += [(300 + i, f"ping han-dle{'ab' * i}#nine9 w{'u' * i}") for i in range(5)]
    rows += [(400, "ping other_one77 end"), (500, "ask for 4111111111111112 now")]
    rows += [(600 + i, f"ask{'a' * i} for {n} then{'b' * i}") for i, n in enumerate(
        ("4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "6011111111111117", "6011000990139424", "3530111333300000")
    )]
    got = {r["doc_id"]: r for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(s["kind"], s["first"], s["end"]) for s in got[i]["added"]] for i in (200, 300, 400)] == [
        [("email", 8, 21)], [("email", 5, 18)], [("email", 5, 16)]
    ]
    assert got[500]["added"] == []


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_sharding(which, request):
    df = request.getfixturevalue(which)
    _, table = sharding.coordinates(df)
    rows = cut_lineage(table)
    placed = sharding.numbered(cut_lineage(rows.withColumn("shard", sharding.tree(rows, 16)))).collect()
    assert len(placed) == df.count()
    slots, size = {}, {}
    for r in placed:
        slots.setdefault(r["shard"], []).append(r["slot"])
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    if which == "docs":
        assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in placed)
    exact = sharding.sharded(df, 16)
    assert sorted(str((r["doc_id"], r["shard"])) for r in exact.collect()) == sorted(str((r["doc_id"], r["shard"])) for r in placed)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_substrings(which, request):
    df = request.getfixturevalue(which).select("doc_id", "text")
    rows = df.collect()
    want = sorted(str((r["doc_id"], *p)) for r, p in zip(rows, plain.substrings([r["text"] for r in rows])))
    got = substring.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_decontamination(spark, docs, odd):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain.leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == want
    assert decontaminate.clean(docs, items).count() == docs.count() - len({d for d, _ in want})
    probes = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "two words"), (5, " ".join(LONG.split()[10:60]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, probes).collect()}
    assert got == {(5, 1), (6, 1), (8, 1), (5, 5), (6, 5), (8, 5), (4, 4)}


def test_decontamination_of_changed_passages(spark):
    item = [f"q{i}" for i in range(100)]
    near, far = list(item), list(item)
    near[30] = "changed"
    for i in range(0, 100, 6):
        far[i] = "changed"
    rows = [(1, " ".join(["pre"] * 7 + near + ["post"] * 9)), (2, " ".join(far)), (3, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()] == [(1, 1)]


def test_pages(spark):
    head = "<html><head><title>t</title></head><body><nav><li>Menu</li></nav>"
    pages = [
        (1, "http://a.org/1", head + "<div class='ad'>Buy</div><article><h1>T &amp; x</h1><p>One  two\n three<p>4 &lt; 5<div class='comments'>hi</div></article><footer>f</footer>"),
        (2, "http://a.org/2", None), (3, None, ""), (None, "http://a.org/3", "<p>unclosed <b>bold"),
    ]
    pages += [(10 + i, f"http://b.org/{i}", f"<div>Site name</div><p>Text number {i}</p><div>All rights kept</div>") for i in range(4)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "T & x\nOne two three\n4 < 5"
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[None]["text"] == "unclosed bold"
    assert [got[10 + i]["text"] for i in range(4)] == [f"Text number {i}" for i in range(4)]
    assert got[1]["n_chars"] == len(got[1]["text"])


@pytest.mark.parametrize("fan_in", [256, 2])
def test_wrapper_is_aligned_step_by_step(spark, monkeypatch, fan_in):
    """A block is fixed text at its place of the host's wrapper only; optional and repeated tokens are aligned too."""
    monkeypatch.setattr(html_text, "FAN_IN", fan_in)
    pages, expected = [], {}
    for i in range(12):
        # On one page the slot holds the header's text, on some a notice stands, and answers repeat.
        slot = "Site name" if i == 5 else f"City {i}"
        notice = "<div>Old notice</div>" if i % 3 else ""
        answers = "".join(f"<p>Answer {i} {j}</p><div>Reply</div><div>Share</div>" for j in range(i % 4))
        html = f"<div>Site name</div>{notice}<p>Text {i}</p><div>{slot}</div><h2>Answers</h2>{answers}<div>All rights kept</div>"
        pages += [(i, f"http://c.org/{i}", html)] * (1 + i % 2)
        expected[i] = "\n".join([f"Text {i}", slot, *[f"Answer {i} {j}" for j in range(i % 4)]])
    # Fixed text in another order than on most pages of its host.
    for i in range(300, 308):
        parts = ["<div>Top</div>", "<div>Contact</div>", "<div>About</div>"]
        pages.append((i, f"http://e.org/{i}", f"<p>Text {i}</p>".join(parts[::-1] if i > 304 else parts)))
        expected[i] = f"Text {i}\nText {i}"
    # Too few pages for a wrapper, another host, and a page that is only fixed text.
    pages += [(100 + i, f"http://d.org/{i}", f"<div>Site name</div><p>Text {i}</p>") for i in range(2)]
    pages += [(200, "http://c.org/only", "<div>Site name</div><h2>Answers</h2><div>All rights kept</div>"), (201, None, "<p>alone")]
    expected |= {100 + i: f"Site name\nText {i}" for i in range(2)} | {200: "", 201: "alone"}
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == expected and len(rows) == len(pages)


def test_streams_are_folded_and_aligned():
    assert html_text._folded([1, 0, 2, 0, 2, 0, 2, 3]) == [0, 1, 2, 1, 2, 1, 2, 3]
    assert html_text._folded([1, 2, 1, 2, 5]) == [0, 1, 0, 1, 2] and html_text._folded([1, 0, 1, 4]) == [0, 1, 2, 3] and html_text._folded([]) == []
    assert html_text._places([1, 2, 3], [1, 9, 3]) == [0, -1, 2]
    assert html_text._places([1, 2, 3], [2, 1, 3]) == [1, -1, 2] and html_text._places([1], [7, 1]) == [-1, 0]
    assert html_text._merged([([1, 2, 3], 5), ([1, 3], 3), ([1, 9, 3], 1), ([8, 1, 2, 3], 1)]) == [1, 2, 3]


def test_furniture_keeps_main_text():
    """Furniture ends where HTML ends it, and is none around the main text."""
    def main(page):
        return [t for _, t, _ in html_text.blocks(page)]

    body = "<h1>Head</h1><p>Some longer text of the page"
    assert main(f"<div class='page has-sidebar'><nav>Menu</nav><article>{body}</article></div>") == ["Head", "Some longer text of the page"]
    assert main(f"<div id=content class='no-sidebar share'>{body}</div>") == ["Head", "Some longer text of the page"]
    assert main("<article><p class='notice'>Sign up<p>One two three four</p><p>Five six</p></article>") == ["One two three four", "Five six"]
    assert main("<ul><li class=social>Follow<li>One two three</ul><p>Four five six</p>") == ["One two three", "Four five six"]
    assert main("<body><form action=/x><div>All the text of this page</div></form></body>") == ["All the text of this page"]
    assert main("<head><title>t</title><p>One two") == ["One two"]
    # What is furniture stays out.
    assert main("<nav><a>One</a> <a>Two three four five six seven</a></nav><article><p>Text</article>") == ["Text"]
    assert main(f"<div class=related><article>Card</article></div>{body}") == ["Head", "Some longer text of the page"]
    assert main("<div class=consent>Long words about cookies of all kinds</div><article>Text</article>") == ["Text"]
    assert main("<div><article><p>One</div><p>Two</article>") == ["One", "Two"]


def _chats(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        want[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return want


def test_chats(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "&amp; &lt;| <|im_end|>\n<|im_start|>assistant &nl; \\ é😀"
    rows += [(900, i, ("system", "user", "assistant")[min(i, 1) + (i and i % 2)], f"{hard} {i} " + "long " * 90) for i in range(300)]
    rows += [(901, None, None, None), (901, 1, "assistant", ""), (901, 1, "assistant", ""), (902, 5, "as&\nsistant", hard), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(df).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    assert got == _chats([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    for r in chat.windows(df.where("conv_id = 900"), 500).collect():
        turns = chat.read_back(r["formatted"])
        assert turns[0][0] == "system"
        assert len(turns) > r["n_repeated"]


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, 100 * i, "system" if i == 0 else ("user", "assistant")[i % 2], f"t{i} " + "word " * (i * 37 % 150)) for i in range(200)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", "long " * 400), (2, 2, "assistant", "short"), (3, 5, "user", "x " * 295), (3, 6, "system", "late " * 90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(chat.windows(df, 300).collect(), key=lambda r: (r["conv_id"], r["chunk"], r["part"]))
    own = {}
    for at, r in enumerate(found):
        turns = chat.read_back(r["formatted"])
        assert sum(chat.n_tokens(t) for _, t in turns) <= 300 or len(turns) == 1
        before = own.setdefault(r["conv_id"], [])
        head = [t for t in turns[:r["n_repeated"]] if t[0] != "system"]
        assert head == [t for t in before[len(before) - len(head):] if t[0] != "system"]
        if r["conv_id"] == 1 and before:
            # Sparse turn numbers have history, also over the border of two chunks, where there is room for it.
            room = 300 - sum(chat.n_tokens(t) for _, t in (turns[0], *turns[r["n_repeated"]:][:1], before[-1]))
            assert turns[0][0] == "system" and (head or room < 0)
        before += turns[r["n_repeated"]:]
    assert own[1] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert [len(chat.read_back(r["formatted"])) for r in found if r["conv_id"] == 2] == [1, 1, 2]


def test_empty_tables(spark, none):
    for df in (
        simhash.near_duplicates(none), simhash.one_per_group(none), mixing.mixed_rows(none), sharding.sharded(none, 16), quality.keep(none),
        substring.digest(none), licences.digest(licences.scan(none)), personal.digest(personal.find(none)),
        html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        decontaminate.clean(none, spark.createDataFrame([], "item_id long, text string")),
    ):
        assert df.count() == 0


def test_pipeline(spark, docs):
    out, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, out, SMALL))
        sizes.append((name, out.count()))
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "near_dedup":
            prints = [plain.fingerprint(r["text"]) for r in out.collect()]
            assert len(set(plain.groups(prints))) == len(prints)
    assert set(out.columns) == {*docs.columns, "shard"}
    assert len(sizes) == 5 and sizes[-1][1] > 0


def test_registered(spark):
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)]
