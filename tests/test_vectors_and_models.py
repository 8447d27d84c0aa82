"""Neighbours, geometry, training, votes, phases, routing and scoring."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.rules import DIABETES_RULES
from notewright.operators import embed, expand, fuse, neighbours, pivots, route, score, space, spread, tfidf, train, weak
from notewright.operators import newton as newton_module
from notewright.operators.select import with_label

N, C, D, B = fv.LABELS
FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def vectors(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, "patient_identifier long, embedding array<float>")


def brute_force(queries, store, k):
    out = {}
    for i, q in queries.items():
        scored = [(-round(float(q @ s / np.linalg.norm(q) / np.linalg.norm(s)), 9), j) for j, s in store.items()]
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0, "block_bytes": 8 * 6 * 7}])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_neighbours_match_brute_force_with_copies(spark, limits, k):
    rng = np.random.default_rng(1)
    store = rng.integers(-2, 3, (120, 6)).astype(np.float32) + np.float32(0.5)
    store[40:90] = store[3]
    queries = np.vstack([rng.normal(size=(30, 6)).astype(np.float32), np.repeat(store[3:4], 15, axis=0)])
    asked = vectors(spark, queries, range(1000, 1045)).repartition(5)
    known = vectors(spark, store).repartition(3)
    found = neighbours.top_k_cosine(asked, known, k, **limits)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbour_id)
    q = {1000 + i: v.astype(float) for i, v in enumerate(queries)}
    s = {i: v.astype(float) for i, v in enumerate(store)}
    assert got == brute_force(q, s, k)


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("slice_size", [1, 7, 64, 500])
def test_slices_change_nothing(monkeypatch, k, slice_size):
    rng = np.random.default_rng(9)
    store = rng.integers(-1, 2, (300, 4)) + 0.25
    store[100:200] = store[7]
    queries = np.vstack([rng.normal(size=(20, 4)), store[7:8]])
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (queries, store)]
    monkeypatch.setattr(neighbours, "_COLUMNS", slice_size)
    monkeypatch.setattr(neighbours, "_ROWS", 6)
    keys = neighbours._best(*unit, k)
    places = neighbours._LAST_PLACE - (keys & neighbours._LAST_PLACE)
    expected = brute_force(dict(enumerate(queries)), dict(enumerate(store)), k)
    assert [list(p) for p in places] == [expected[i] for i in range(21)]


def _index(known, k, most=1024):
    rows = known.selectExpr("patient_identifier AS neighbour_id", "embedding AS v")
    return pivots.build(rows, rows.count(), len(rows.first()["v"]), k, 50, most)


@pytest.mark.parametrize("k", [1, 4, 300])
@pytest.mark.parametrize("block_bytes", [1, 8 * 3 * 11, 1 << 20])
def test_pivot_search_with_zeros_copies_repeated_ids_and_ties(spark, k, block_bytes):
    rng = np.random.default_rng(8)
    store = np.vstack([rng.normal(size=(60, 3)), np.zeros((5, 3)), np.repeat([[1.0, 2.0, 3.0]], 40, axis=0), [[-1, -2, -3]], rng.normal(size=(30, 3))])
    ids = np.concatenate([np.arange(len(store) - 10), np.arange(10)])
    queries = np.vstack([rng.normal(size=(12, 3)), np.zeros((2, 3)), [[1.0, 2.0, 3.0]] * 3, [[-2.0, -4.0, -6.0]]])
    asked, known = vectors(spark, queries, [7] * len(queries)).repartition(3), vectors(spark, store, ids).repartition(4)
    scan, indexed = (
        sorted((r["query_id"], r["neighbour_id"], round(r["cosine"], 9), r["rank"]) for r in
               neighbours.top_k_cosine(asked, known, k, **limits).collect())
        for limits in ({}, {"broadcast_bytes": 0, "block_bytes": block_bytes})
    )
    assert scan == indexed and len(scan) == len(queries) * min(k, len(store))


def test_pivot_search_skips_far_clusters(spark):
    rng = np.random.default_rng(6)
    centres = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    store = np.repeat(centres, 50, axis=0) + rng.normal(size=(1200, 24)) * 0.01
    queries = centres + rng.normal(size=(24, 24)) * 0.01
    asked = vectors(spark, queries).selectExpr("patient_identifier AS query_id", "embedding AS v")
    known = vectors(spark, store).selectExpr("patient_identifier AS neighbour_id", "embedding AS v")
    schema = neighbours.top_k_cosine(vectors(spark, queries), vectors(spark, store), 5).schema
    found, probes = neighbours._indexed_search(asked, known, 1200, 24, 5, 400, schema)
    index = pivots.build(known, 1200, 24, 5, 400)
    every = 24 * int((index.sizes > 0).sum())
    met = probes.select(F.explode("clusters").alias("cluster")).collect()
    assert len(met) < every / 3
    # A query goes to a block once in each of the two rounds.
    assert probes.groupBy("row", "block").count().agg(F.max("count")).first()[0] <= 2
    compared = sum(int(index.sizes[r["cluster"]]) for r in met)
    assert compared < 24 * 1200 / 4
    best = {r["query_id"]: r["m"] for r in found.groupBy("query_id").agg(F.max("cosine").alias("m")).collect()}
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (queries.astype(np.float32).astype(float), store.astype(np.float32).astype(float))]
    assert np.allclose([best[i] for i in range(24)], (unit[0] @ unit[1].T).max(axis=1), atol=1e-9)


def test_small_blocks_travel_in_bundles(spark):
    """With blocks of four rows a query neither travels to every block nor brings k hits from each."""
    rng = np.random.default_rng(11)
    store, queries = rng.normal(size=(1200, 16)).astype(np.float32), rng.normal(size=(40, 16)).astype(np.float32)
    asked = vectors(spark, queries).selectExpr("patient_identifier AS query_id", "embedding AS v")
    known = vectors(spark, store).selectExpr("patient_identifier AS neighbour_id", "embedding AS v")
    schema = neighbours.top_k_cosine(vectors(spark, queries), vectors(spark, store), 5).schema
    found, probes = neighbours._indexed_search(asked, known, 1200, 16, 5, 4, schema)
    assert probes.groupBy("row").count().agg(F.max("count")).first()[0] <= 60
    rows = found.collect()
    assert len(rows) <= 40 * 5 * 60
    best = {}
    for r in sorted(rows, key=lambda r: (-r["cosine"], r["neighbour_id"])):
        best.setdefault(r["query_id"], []).append(r["neighbour_id"])
    expected = brute_force(dict(enumerate(queries.astype(float))), dict(enumerate(store.astype(float))), 5)
    assert {i: ids[:5] for i, ids in best.items()} == expected


def test_clusters_are_packed_into_blocks():
    block, parts = pivots._packed(np.array([3, 0, 4, 9, 25, 1, 2, 0]), 10)
    assert block.tolist() == [0, 0, 0, 1, 2, 3, 3, 3] and parts.tolist() == [1, 1, 3, 1]


def test_no_member_beats_its_bound(spark):
    rng = np.random.default_rng(3)
    store = np.vstack([rng.normal(size=(200, 5)), np.zeros((3, 5)), np.eye(5), -np.eye(5)])
    index = _index(vectors(spark, store), 2, most=9)
    queries = np.vstack([rng.normal(size=(40, 5)), np.zeros((1, 5)), np.eye(5), store[:20]])
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    units = np.divide(queries, norms, out=np.zeros_like(queries), where=norms > 0)
    limit = pivots.bounds(units, index.pivots, index.least, index.widest)
    assert int(index.sizes.sum()) == 210 + 2
    for row in index.rows.collect():
        v = np.array(row["v"], dtype=float)
        v = v / np.linalg.norm(v) if np.linalg.norm(v) else v
        assert (units @ v <= limit[:, row["cluster"]] + pivots.MARGIN).all()


def test_rows_without_vector_and_empty_store(spark):
    asked = vectors(spark, [[1, 0], None])
    assert neighbours.top_k_cosine(asked, vectors(spark, [None]), 3).count() == 0
    got = neighbours.top_k_cosine(asked, vectors(spark, [[1, 0], None]), 3).collect()
    assert [(r.query_id, r.neighbour_id, r.rank) for r in got] == [(0, 0, 1)]


def test_vectors_of_different_length_are_refused(spark):
    with pytest.raises(ValueError):
        neighbours.top_k_cosine(vectors(spark, [[1, 0]]), vectors(spark, [[1, 0], [1, 0, 0]]), 1)


def test_query_rows_of_one_id_keep_their_neighbours(spark):
    asked, known = vectors(spark, [[1, 0], [0, 1]], [7, 7]), vectors(spark, [[1, 0], [0, 1], [1, 1]], [1, 2, 3])
    both = [
        sorted((r["query_id"], r["neighbour_id"], r["rank"]) for r in neighbours.top_k_cosine(asked, known, 2, **limits).collect())
        for limits in ({}, {"broadcast_bytes": 0, "block_bytes": 32})
    ]
    assert both[0] == both[1] == [(7, 1, 1), (7, 2, 1), (7, 3, 2), (7, 3, 2)]


def test_search_contract(spark):
    store = vectors(spark, np.eye(6)).withColumns({
        "text": F.lit("t"), "has_cancer": F.lit(None).cast("double"), "has_diabetes": F.lit(1.0),
        "combined_label": F.lit(None).cast("string"),
    })
    hits = neighbours.similarity_search(vectors(spark, [[1, .5, .4, .3, .2, .1]], [77]), store).orderBy("rank").collect()
    scores = [h.similarity_score for h in hits]
    assert len(hits) == 5 and scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    assert all((h.has_cancer, h.combined_label, h.text) == (0.0, N, "t") for h in hits)


def test_projection_matches_singular_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 1, 1] + 10
    df = vectors(spark, x).withColumn("combined_label", F.lit(N))
    projected, variance = space.project_2d(df)
    centred = x.astype(np.float32).astype(float) - x.astype(np.float32).astype(float).mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert variance == pytest.approx((s**2 / (s**2).sum())[:2], rel=1e-5)
    axes = np.array([v if v[np.abs(v).argmax()] > 0 else -v for v in vt[:2]])
    got = np.array([(r.pc1, r.pc2) for r in projected.orderBy("patient_identifier").collect()])
    assert np.allclose(got, centred @ axes.T, atol=1e-4)


def test_spread_equals_mean_distance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).astype(np.float32).astype(float)
    centre = x.mean(axis=0)
    expected = np.mean([1 - v @ centre / np.linalg.norm(v) / np.linalg.norm(centre) for v in x])
    df = vectors(spark, x).withColumn("combined_label", F.lit(N))
    assert space.class_spread(df).first().mean_distance == pytest.approx(expected, rel=1e-6)


def training_table(spark, n=120, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).astype(np.float32)
    y = ((x @ [1.5, -1, 0.5] + rng.normal(size=n)) > 0.8).astype(float)
    df = spark.createDataFrame(
        [(i, [float(v) for v in x[i]], float(y[i]), float(x[i, 1] > 0.3)) for i in range(n)],
        "patient_identifier long, embedding array<float>, has_cancer double, has_diabetes double",
    )
    return with_label(df), x.astype(float), y


def newton(x, y, w):
    """Minimum of the weighted logistic loss plus half the squared norm, intercept free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - y)) + penalty @ b)
    return b


@pytest.mark.parametrize("balanced", [True, False])
def test_binary_model_reaches_the_optimum(spark, balanced):
    df, x, y = training_table(spark)
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    expected = newton(x, y, share if balanced else np.ones(len(y)))
    fitted = train.fit_logistic(df, "has_cancer", (0.0, 1.0), balanced=balanced)
    got = np.append(fitted.model.coefficients.toArray(), fitted.model.intercept)
    assert np.allclose(got, expected, atol=1e-4)


def test_label_model_gradient_vanishes(spark):
    df, x, _ = training_table(spark, 200)
    fitted = train.fit_label_model(df)
    rows = train.score_labels(df, fitted, "lr").orderBy("patient_identifier").collect()
    probs = np.array([r.lr_probs for r in rows])
    assert np.allclose(probs.sum(axis=1), 1)
    assert [r.lr_pred for r in rows] == [fv.LABELS[i] for i in probs.argmax(axis=1)]
    truth = np.array([fv.LABELS.index(r.combined_label) for r in rows])
    weight = np.array([len(truth) / (len(set(truth)) * (truth == t).sum()) for t in truth])
    error = (probs - np.eye(4)[truth]) * weight[:, None]
    present = [fv.LABELS.index(c) for c in fitted.classes]
    gradient = error.T @ x
    gradient[present] += fitted.model.coefficientMatrix.toArray()
    assert np.abs(gradient[present]).max() < 1e-2


def test_absent_class_has_probability_zero(spark):
    df, _, _ = training_table(spark)
    fitted = train.fit_label_model(df.filter(~F.col("combined_label").isin(B)))
    assert train.score_labels(df, fitted, "lr").agg(F.max(F.col("lr_probs")[3])).first()[0] == 0.0
    with pytest.raises(ValueError):
        train.fit_label_model(df.filter(F.col("combined_label") == N))


def test_forest_probabilities(spark):
    df, _, _ = training_table(spark)
    rows = train.score_labels(df, train.fit_forest(df, trees=5, depth=4), "rf").collect()
    assert all(sum(r.rf_probs) == pytest.approx(1) for r in rows)


def vote_table(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, n)
    votes = []
    for t in truth:
        row = []
        for accuracy, cover in ((0.9, 0.7), (0.8, 0.6), (0.6, 0.8), (0.85, 0.3)):
            said = t if rng.random() < accuracy else 1 - t
            row.append(int(said) if rng.random() < cover else -1)
        votes.append(row)
    votes.append([-1] * 4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "id int, votes array<tinyint>")
    return df, truth


def test_both_ways_of_fitting_votes_agree(spark):
    df, truth = vote_table(spark)
    one = weak.fit_vote_model(df, 4, epochs=15)
    two = weak.fit_vote_model(df, 4, epochs=15, in_memory_rules=0)
    assert np.allclose(one, two, atol=1e-6)
    rows = weak.label_model(df, 4).orderBy("id").collect()
    probs = np.array([r.probability for r in rows])
    assert probs[-1] == 0.5 and ((probs >= 0) & (probs <= 1)).all()
    assert ((probs[:-1] > 0.5) == truth)[np.abs(probs[:-1] - 0.5) > 0.1].mean() > 0.8


def test_votes_of_no_rows(spark):
    df, _ = vote_table(spark)
    none = df.filter("id < 0")
    assert (weak.fit_vote_model(none, 4) == 0).all()
    assert (weak.fit_vote_model(none, 4, in_memory_rules=0) == 0).all()


def test_majority(spark):
    df = spark.createDataFrame([([1, 1, 0],), ([-1, -1, -1],), ([0, -1, -1],)], "v array<tinyint>")
    assert [r[0] for r in df.select(weak.majority_probability(F.col("v"))).collect()] == [pytest.approx(2 / 3), 0.5, 0.0]
    assert len(weak.apply_rules(spark.createDataFrame([("IDDM",)], "text string"), DIABETES_RULES).first().votes) == 5


@pytest.mark.parametrize("p_a, p_b, kw, source, label", [
    (0.6, 0.0, False, "ml_synthetic", C), (0.59, 0.5, False, None, None), (0.19, 0.19, True, "ml_synthetic", N),
    (0.2, 0.1, True, "regex", C), (0.2, 0.1, False, "ml_neither", N), (0.3, 0.1, False, None, None),
    (0.6, 0.6, True, "ml_synthetic", B), (0.29, 0.29, False, "ml_neither", N), (0.5, 0.6, False, "ml_synthetic", D),
])
def test_phases(spark, p_a, p_b, kw, source, label):
    df = spark.createDataFrame(
        [(1, p_a, p_b, kw, False, None, None)],
        "patient_identifier long, p_a double, p_b double, has_cancer_kw boolean, has_diabetes_kw boolean,"
        "has_cancer double, has_diabetes double",
    )
    row = expand.assign_phase(df).first()
    assert (row.source, row.combined_label) == (source, label)


def test_expansion_needs_vectors_and_samples_exactly(spark):
    phased = spark.range(500).select(
        F.col("id").alias("patient_identifier"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"),
        F.when(F.col("id") < 10, "regex").otherwise("ml_neither").alias("source"), F.lit(N).alias("combined_label"),
    )
    labelled = phased.filter("patient_identifier < 3").drop("source")
    grown = expand.expand_training_set(labelled, phased)
    assert {r.source: r["count"] for r in grown.groupBy("source").count().collect()} == {
        "labeled": 3, "regex": 10, "ml_neither": 200}
    with pytest.raises(ValueError):
        expand.expand_training_set(labelled.drop("embedding"), phased)


def python_route(ka, kb, pb, ps):
    b, s = fv.LABELS[int(np.argmax(pb))], fv.LABELS[int(np.argmax(ps))]
    if ka or kb:
        return (B if ka and kb else D if kb else C), 1.0, "REGEX"
    if b == s:
        return b, (max(pb) + max(ps)) / 2, "AGREEMENT"
    if b == N:
        return N, pb[0], "BASELINE"
    if s != N:
        return s, max(ps), "SEMI-SUP"
    return (b, max(pb) / 2, "WEIGHTED") if max(pb) >= max(ps) else (N, max(ps) / 2, "WEIGHTED")


SCORES = st.lists(st.sampled_from([0.1, 0.2, 0.3, 0.4]), min_size=4, max_size=4)


@FEW
@given(st.lists(st.tuples(st.booleans(), st.booleans(), SCORES, SCORES), min_size=30, max_size=60))
def test_routing(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "id int, has_cancer_kw boolean, has_diabetes_kw boolean, baseline_probs array<double>, semisup_probs array<double>",
    )
    for got, row in zip(route.route(df).orderBy("id").collect(), rows):
        label, confidence, reason = python_route(*row)
        assert (got.predicted_label, got.confidence) == (label, pytest.approx(confidence))
        assert got.decision_reason.startswith(reason)


def test_failing_prompts_lose_only_themselves(spark):
    def make():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]
        return model

    df = spark.createDataFrame([(i, "bad" if i % 5 == 0 else f"p{i}") for i in range(20)], "id int, prompt string").coalesce(1)
    rows = score.score_batches(df, make, batch=6).collect()
    assert len(rows) == 20
    assert {r.id for r in rows if r.error} == {0, 5, 10, 15}
    assert all(r.response == f"P{r.id}" for r in rows if not r.error)


def test_answers_of_the_wrong_number_are_an_error(spark):
    df = spark.createDataFrame([("a",)], "prompt string")
    assert "2 answers" in score.score_batches(df, lambda: lambda prompts: ["x", "y"]).first().error


def test_plugin_embedder_is_checked(spark):
    df = spark.createDataFrame([("a",), (None,), ("ccc",)], "text string")
    rows = embed.embed_text(df, lambda: lambda texts: [[len(t), 1.0] for t in texts], dim=2, batch=2).collect()
    assert [r.embedding for r in rows] == [[1.0, 1.0], [0.0, 1.0], [3.0, 1.0]]
    with pytest.raises(Exception):
        embed.embed_text(df, lambda: lambda texts: [[float("nan"), 1.0] for _ in texts], dim=2).collect()


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(i, f"note {i} about x{i % 3}") for i in range(20)], "id int, text string")
    out = embed.embed_hashed(df, embed.hashed_embedder(df, dim=64))
    assert tuple(embed.check_embeddings(out, 64).first()) == (20, 20, 0)


def test_fusing_evidence(spark):
    rows = [
        (1, C, 0.4, False, False, C, 0.6, False), (2, C, 0.5, False, False, D, 0.8, False),
        (3, C, 0.5, False, True, N, 0.4, True), (4, C, 0.9, False, False, D, 0.8, False),
        (5, C, 0.6, True, True, D, 1.0, False),
    ]
    df = spark.createDataFrame(rows, "query_id int, initial_classification string, initial_confidence double, has_cancer_kw boolean,"
                                     "has_diabetes_kw boolean, neighbour_label string, neighbour_share double, mixed boolean")
    got = [(r.final_classification, r.final_confidence, r.evidence) for r in fuse.fuse_evidence(df).orderBy("query_id").collect()]
    assert got == [(C, 0.6, "agreement"), (D, 0.8, "retrieval"), (D, 1.0, "text"), (C, 0.9, "first answer"), (B, 1.0, "text")]


def test_terms_and_idf(spark):
    df = spark.createDataFrame([("A bb cc bb",), ("bb été",), ("x",), (None,)], "text string")
    rows = {r.term: (r.n_notes, r.n_uses) for r in tfidf.term_statistics(df).collect()}
    assert rows == {"bb": (2, 3), "cc": (1, 1), "été": (1, 1), "bb cc": (1, 1), "cc bb": (1, 1), "bb été": (1, 1)}
    kept = tfidf.vocabulary(df, 4).collect()
    assert [(r.term, r.idf) for r in kept] == [("bb", pytest.approx(np.log(5 / 3) + 1))]


@pytest.mark.parametrize("size", [3, 10, 25, 10_000])
@pytest.mark.parametrize("max_broadcast", [0, 10_000])
def test_vocabulary_equals_the_top_of_all_terms(spark, size, max_broadcast):
    rng = np.random.default_rng(6)
    names = np.array(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"])
    notes = [" ".join(rng.choice(names, rng.integers(1, 30), p=[.3, .2, .15, .1, .1, .05, .05, .05])) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in notes], "text string")
    expected = {}
    for note in notes:
        w = note.split()
        for t in w + [f"{x} {y}" for x, y in zip(w, w[1:])]:
            expected.setdefault(t, [0, set()])
            expected[t][0] += 1
            expected[t][1].add(note)
    limits = [(-n, t) for t, (n, own) in expected.items() if 2 <= len(own) <= 0.95 * 60]
    got = tfidf.vocabulary(df, 60, max_features=size, max_broadcast=max_broadcast).collect()
    assert sorted((-r.n_uses, r.term) for r in got) == sorted(limits)[:size]


def test_labels_spread_to_copies(spark):
    x = [[1, 0], [0.99, 0.01], [0.98, 0.02], [0, 1], [0.01, 0.99], [0.02, 0.98]]
    df = vectors(spark, x).withColumn(
        "combined_label", F.when(F.col("patient_identifier") == 0, C).when(F.col("patient_identifier") == 3, D))
    got = {r.patient_identifier: r.spread_label for r in spread.spread_labels(df, k=2, rounds=6).collect()}
    assert got == {0: C, 1: C, 2: C, 3: D, 4: D, 5: D}


@pytest.mark.parametrize("classes", [2, 4])
def test_newton_sums_are_derivatives(classes):
    rng = np.random.default_rng(11)
    rows, label, share = rng.normal(size=(30, 3)), rng.integers(0, classes, 30), rng.random(30) + 0.5
    weights = rng.normal(size=(1 if classes == 2 else classes, 3))

    def at(w):
        return newton_module._penalised(newton_module._sums(rows, label, share, w), w, 0.7)

    _, gradient, hessian = at(weights)
    for i in range(weights.size):
        step = np.zeros(weights.size)
        step[i] = 1e-6
        up, down = at(weights + step.reshape(weights.shape)), at(weights - step.reshape(weights.shape))
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(gradient[i], abs=1e-5)
        assert np.allclose((up[1] - down[1]) / 2e-6, hessian[i], atol=1e-5)


def test_newton_reaches_the_solver_beyond_its_bound(spark, monkeypatch):
    df, _, _ = training_table(spark, 200)
    near = train.fit_label_model(df)
    monkeypatch.setattr(newton_module, "CELLS", 10)
    far = train.fit_label_model(df)
    assert isinstance(near.model, newton_module.LinearModel) and not isinstance(far.model, newton_module.LinearModel)
    a, b = (np.array([r.lr_probs for r in train.score_labels(df, m, "lr").orderBy("patient_identifier").collect()]) for m in (near, far))
    assert np.allclose(a, b, atol=1e-3)


def test_separable_rows_settle_and_steps_are_bounded(spark):
    df = spark.createDataFrame([(i, [float(i - 10)], float(i >= 10)) for i in range(20)], "id int, embedding array<float>, y double")
    fitted = train.fit_logistic(df, "y", (0.0, 1.0))
    assert fitted.model.steps < 30
    with pytest.raises(ValueError):
        train.fit_logistic(df, "y", (0.0, 1.0), max_iter=2)
    scored = fitted.transform(df.withColumn("embedding", F.when(F.col("id") != 3, F.col("embedding"))), (1.0, 0.0), "p")
    rows = {r["id"]: r["p"] for r in scored.collect()}
    assert rows[3] == [None, None] and rows[19][0] > 0.9 and rows[0][1] > 0.9


def test_precisions_in_closed_form(spark):
    df, truth = vote_table(spark, n=4000)
    votes = np.array([r["votes"] for r in df.collect()])
    signed = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))

    def agreement(i, j):
        both = (votes[:, i] != -1) & (votes[:, j] != -1)
        return (signed[both, i] * signed[both, j]).mean()

    got = {r["rule"]: r for r in weak.moment_precisions(df, 4).collect()}
    for i, right in enumerate((0.9, 0.8, 0.6, 0.85)):
        rest = [j for j in range(4) if j != i]
        edges = [min(0.98, abs(agreement(i, j) * agreement(i, k) / agreement(j, k)) ** 0.5) for j in rest for k in rest if j < k]
        assert got[i]["n_triples"] == 3
        assert got[i]["precision"] == pytest.approx((1 + np.median(edges)) / 2, abs=1e-6)
        assert abs(got[i]["precision"] - right) < 0.08
    started = weak.label_model(df, 4, from_moments=True).orderBy("id").collect()
    probs = np.array([r.probability for r in started])[:-1]
    assert ((probs > 0.5) == truth)[np.abs(probs - 0.5) > 0.1].mean() > 0.8


def test_rules_that_never_meet_keep_the_first_precision(spark):
    df = spark.createDataFrame([([1, -1, -1],), ([-1, 0, -1],), ([-1, -1, 1],)], "votes array<tinyint>")
    assert {(r["n_triples"], r["precision"]) for r in weak.moment_precisions(df, 3).collect()} == {(0, 0.7)}
    assert weak.agreement_moments(df.limit(0), 3).count() == 0


def test_a_spread_round_moves_no_edges(spark):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 50) for i in range(50) for j in range(1, 4)], "query_id long, neighbour_id long")
    start = spark.createDataFrame([(i, float(i % 5 == 0)) for i in range(50)], "id long, f0 double")
    names = [spread._bucketed(df, key, 4) for df, key in ((edges, "neighbour_id"), (start, "id"))]
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        table = spark.table(names[1])
        plan = spread.spread_round(spark.table(names[0]), table, table, ["f0"])
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(query_id" in text
        two = spread.spread_round(spark.table(names[0]), table, plan, ["f0"])._jdf.queryExecution().executedPlan().toString()
        assert two.count("Exchange hashpartitioning") == 2
        means = {i: [] for i in range(50)}
        for r in edges.collect():
            means[r["query_id"]].append(float(r["neighbour_id"] % 5 == 0))
        for r in plan.collect():
            assert r["f0"] == pytest.approx(0.2 * np.mean(means[r["id"]]) + 0.8 * (r["id"] % 5 == 0))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def test_spreading_stops_when_nothing_changes(spark):
    rng = np.random.default_rng(4)
    df = vectors(spark, rng.normal(size=(40, 3))).withColumn("combined_label", F.when(F.col("patient_identifier") < 9, F.lit(N)))
    few, many = (
        {r["patient_identifier"]: r["probabilities"] for r in spread.spread_labels(df, rounds=30, tolerance=t).collect()} for t in (1e-9, None)
    )
    assert few.keys() == many.keys()
    assert all((few[i] is None) == (many[i] is None) and (few[i] is None or np.allclose(few[i], many[i], atol=1e-6)) for i in few)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("spread_")]
