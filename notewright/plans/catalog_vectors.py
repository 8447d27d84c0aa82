"""Registered queries on embeddings, retrieval and label spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.text import retrieval_context
from notewright.functions.vectors import cosine, similarity_score
from notewright.operators import embed, neighbours, select, space
from notewright.operators.spread import NEIGHBOUR_SHARE, neighbour_edges, spread_labels
from notewright.plans.driver_tables import documents, notes, table
from notewright.plans.fixtures import QUESTIONS, cases_and_questions
from notewright.plans.oracle import LABELLED_NOTES, neighbours as neighbours_sql
from notewright.plans.registry import register, rounded
from notewright.schema import EMBEDDING, ID, LABEL, TEXT
from notewright.session import cut_lineage, scratch_path
from notewright.sources import vector_store

_HITS = f"{QUESTIONS}, {neighbours_sql('asked', 'store', fv.TOP_K)}"
_HIT_ROWS = "CAST(rank AS INTEGER) AS rank"


@register("SELECT count(*) AS n_rows, count(*) AS n_right_length, CAST(0 AS BIGINT) AS n_not_a_number FROM documents")
def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), TEXT)
    vectors = embed.embed_hashed(docs, embed.hashed_embedder(docs))
    return embed.check_embeddings(vectors.drop(TEXT), fv.EMBEDDING_DIM)


def _length_embedder():
    """A toy embedder: text length, line count and number of the letter e."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count("\n"), t.count("e")] for t in texts], dtype=np.float32)


@register("""SELECT doc_id AS patient_identifier, CAST(length(text) AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS n_breaks,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e FROM documents""")
def texts_embedded_by_plugin(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), TEXT)
    vector = F.col(EMBEDDING)
    out = embed.embed_text(docs, _length_embedder, dim=3)
    return rounded(out.select(ID, vector[0].alias("n_chars"), vector[1].alias("n_breaks"), vector[2].alias("n_e")))


@register("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)
  SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cosine,
  round((1 + list_cosine_similarity(a.embedding, b.embedding)) / 2, 6) AS score
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    value = cosine(F.col("embedding"), F.col("next"))
    return rounded(vectors.join(after, "vec_id").select(
        "vec_id", value.alias("cosine"), similarity_score(value).alias("score")
    ))


@register("""SELECT doc_id AS patient_identifier, CAST(length(coalesce(text, '')) AS DOUBLE) AS n_chars,
  CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS DOUBLE) AS n_e,
  (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS n_kept FROM documents""")
def texts_embedded_once(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents embedded first, then all: what the first run kept is not embedded again."""
    docs = documents(spark, folder).select(F.col("doc_id").alias(ID), TEXT)
    path = scratch_path(spark, "kept-vectors")
    embed.embed_once(docs.filter(F.col(ID) % 2 == 0), _length_embedder, path, "lengths", dim=3)
    out = embed.embed_once(docs, _length_embedder, path, "lengths", dim=3, waves=2)
    vector, n_kept = F.col(EMBEDDING), spark.read.parquet(f"{path}/model=lengths").count()
    return rounded(out.select(ID, vector[0].alias("n_chars"), vector[2].alias("n_e"), F.lit(n_kept).cast("long").alias("n_kept")))


_LENGTHS = """[length({0}), length({0}) - length(replace({0}, chr(10), '')), length({0}) - length(replace({0}, 'e', ''))]::DOUBLE[]"""
_REVISED = "CASE WHEN patient_identifier % 7 = 0 THEN text || chr(10) || 'revised eeee' ELSE text END"


@register(f"""WITH {LABELLED_NOTES}, revised AS (SELECT patient_identifier, {_REVISED} AS text, combined_label FROM labelled
    UNION ALL SELECT patient_identifier + 1000000000, 'new case ' || text, combined_label FROM labelled WHERE patient_identifier % 5 = 0),
  store AS (SELECT patient_identifier, combined_label, {_LENGTHS.format('text')} AS embedding FROM revised),
  asked AS (SELECT item_id AS patient_identifier, {_LENGTHS.format("coalesce(text, '')")} AS embedding FROM benchmark), {neighbours_sql('asked', 'store', fv.TOP_K)}
  SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, s.combined_label, round(cosine, 6) AS cosine
  FROM hits JOIN store s ON s.patient_identifier = neighbour_id""")
def stored_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """A store of cases is built, some cases are replaced and some added, and embedded questions search what is stored."""
    path = scratch_path(spark, "case-store")
    texts = cut_lineage(_labelled_texts(spark, folder))
    first = embed.embed_text(texts, _length_embedder, dim=3)
    vector_store.build_case_store(vector_store.case_columns(first), path)
    revised = texts.filter(F.col(ID) % 7 == 0).withColumn(TEXT, F.concat(TEXT, F.lit("\nrevised eeee")))
    added = texts.filter(F.col(ID) % 5 == 0).withColumns({ID: F.col(ID) + 1_000_000_000, TEXT: F.concat(F.lit("new case "), TEXT)})
    changed = embed.embed_text(revised.unionByName(added), _length_embedder, dim=3)
    vector_store.merge_cases(vector_store.case_columns(changed), path)
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias(ID), TEXT)
    hits = neighbours.top_k_cosine(embed.embed_text(questions, _length_embedder, dim=3), vector_store.load_case_store(spark, path))
    cases = vector_store.load_case_store(spark, path).select(F.col(ID).alias("neighbour_id"), LABEL)
    return rounded(hits.join(cases, "neighbour_id").select("query_id", "rank", "neighbour_id", LABEL, "cosine"))


def _labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(select.labelled(notes(spark, folder)))


@register(f"""WITH {_HITS} SELECT query_id, {_HIT_ROWS}, CAST(neighbour_id AS VARCHAR) AS patient_id, md5(s.text) AS text_md5,
  s.has_cancer, s.has_diabetes, s.combined_label, round((1 + cosine) / 2, 6) AS similarity_score
  FROM hits JOIN store s ON s.patient_identifier = neighbour_id""")
def similarity_search(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = cases_and_questions(spark, folder, with_text=True)
    hits = neighbours.similarity_search(asked, store)
    return rounded(hits.withColumn("text_md5", F.md5(TEXT)).drop(TEXT))


@register(f"WITH {_HITS} SELECT query_id, neighbour_id, {_HIT_ROWS}, round(cosine, 6) AS cosine FROM hits")
def nearest_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same search by the pivot index, with small blocks that travel and meet in bundles."""
    store, asked = cases_and_questions(spark, folder)
    return rounded(neighbours.top_k_cosine(asked, store, broadcast_bytes=0, block_bytes=64 * 1024))


@register(f"""WITH {_HITS} SELECT query_id, count(*) FILTER (s.has_cancer = 1) AS n_flag_a,
  count(*) FILTER (s.has_diabetes = 1) AS n_flag_b, count(*) AS n_cases
  FROM hits JOIN store s ON s.patient_identifier = neighbour_id GROUP BY query_id""")
def retrieved_label_tally(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = cases_and_questions(spark, folder)
    return neighbours.retrieved_label_tally(neighbours.similarity_search(asked, store))


@register(f"""WITH {_HITS}, blocks AS (SELECT query_id, rank, 'Similar Case ' || rank || ' (Similarity: ' ||
  printf('%.3f', (1 + cosine) / 2) || '):' || chr(10) || '  Label: ' || s.combined_label || chr(10) ||
  '  Has Cancer: ' || printf('%.1f', s.has_cancer) || chr(10) || '  Has Diabetes: ' || printf('%.1f', s.has_diabetes) || chr(10) ||
  '  Text snippet: ' || substring(s.text, 1, {fv.SNIPPET_CHARS}) || '...' || chr(10) AS block
  FROM hits JOIN store s ON s.patient_identifier = neighbour_id)
  SELECT query_id, md5(string_agg(block, chr(10) ORDER BY rank)) AS context_md5 FROM blocks GROUP BY query_id""")
def retrieval_contexts(spark: SparkSession, folder: str) -> DataFrame:
    store, asked = cases_and_questions(spark, folder, with_text=True)
    cases = neighbours.gather_cases(neighbours.similarity_search(asked, store))
    return cases.select("query_id", F.md5(retrieval_context(F.col("cases"))).alias("context_md5"))


def _labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return select.with_label(select.labelled(notes(spark, folder, features={}, vectors=True)))


_CENTROIDS = f"""{LABELLED_NOTES}, entries AS (SELECT combined_label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS value
  FROM labelled WHERE embedding IS NOT NULL),
  means AS (SELECT combined_label, pos, avg(value) AS value FROM entries GROUP BY combined_label, pos),
  centroids AS (SELECT combined_label, list(value ORDER BY pos) AS centroid FROM means GROUP BY combined_label)"""


@register(f"WITH {_CENTROIDS} SELECT combined_label, CAST(pos AS INTEGER) AS pos, round(value, 5) AS value FROM means")
def class_centroids(spark: SparkSession, folder: str) -> DataFrame:
    centroids = space.class_centroids(_labelled_vectors(spark, folder))
    return rounded(centroids.select(LABEL, F.posexplode("centroid").alias("pos", "value")), 5)


_ORDER = "list_position(['Neither', 'Cancer Only', 'Diabetes Only', 'Both'], {0}.combined_label)"


@register(f"""WITH {_CENTROIDS} SELECT a.combined_label AS label_a, b.combined_label AS label_b,
  round(list_cosine_similarity(a.centroid, b.centroid), 5) AS similarity FROM centroids a, centroids b
  WHERE {_ORDER.format('a')} < {_ORDER.format('b')}""")
def centroid_similarity(spark: SparkSession, folder: str) -> DataFrame:
    centroids = space.class_centroids(_labelled_vectors(spark, folder))
    return rounded(space.centroid_similarity(centroids, fv.LABELS), 5)


@register(f"""WITH {_CENTROIDS} SELECT combined_label, round(avg(1 - list_cosine_similarity(embedding, centroid)), 5) AS mean_distance
  FROM labelled JOIN centroids USING (combined_label) WHERE embedding IS NOT NULL GROUP BY combined_label""")
def class_spread(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(space.class_spread(_labelled_vectors(spark, folder)), 5)


@register()
def projection_2d(spark: SparkSession, folder: str) -> DataFrame:
    projected, _ = space.project_2d(_labelled_vectors(spark, folder))
    return rounded(projected)


_TWO_AXES = f"""WITH {LABELLED_NOTES}, seen AS (SELECT patient_identifier, combined_label, embedding[1] AS x, embedding[2] AS y FROM labelled WHERE embedding IS NOT NULL),
  moments AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM seen),
  eigen AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM moments),
  turned AS (SELECT *, atan2(l1 - a, b) AS t FROM eigen),
  axes AS (SELECT *, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS s1,
    CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sign(sin(t)) ELSE sign(cos(t)) END AS s2 FROM turned)"""


def _two_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    return space.project_2d(_labelled_vectors(spark, folder).withColumn(EMBEDDING, F.slice(EMBEDDING, 1, 2)))


@register(_TWO_AXES + """ SELECT patient_identifier, combined_label, round(((x - mx) * cos(t) + (y - my) * sin(t)) * s1, 5) AS pc1,
  round((-(x - mx) * sin(t) + (y - my) * cos(t)) * s2, 5) AS pc2 FROM seen, axes""")
def projection_of_two_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The main axes of the first two entries, next to the eigenvectors of a matrix of two in closed form."""
    return rounded(_two_entries(spark, folder)[0], 5)


@register(_TWO_AXES + """ SELECT 1 AS axis, round(l1 / (l1 + l2), 6) AS share FROM eigen UNION ALL SELECT 2, round(l2 / (l1 + l2), 6) FROM eigen""")
def projection_variance_of_two_entries(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(space.variance_table(spark, _two_entries(spark, folder)[1]))


@register(f"""WITH {LABELLED_NOTES}, entries AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM labelled WHERE embedding IS NOT NULL)
  SELECT sum(s) > 0 AS varies, 2 AS n_axes FROM (SELECT var_samp(v) AS s FROM entries GROUP BY pos)""")
def projection_variance_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the shares of the two main axes of whole vectors are ordered parts of one."""
    shares = space.variance_table(spark, space.project_2d(_labelled_vectors(spark, folder))[1])
    first, second = (F.max(F.when(F.col("axis") == i, F.col("share"))) for i in (1, 2))
    return rounded(shares.agg(((first >= second) & (second > 0) & (first + second <= 1)).alias("varies"), F.count("*").cast("int").alias("n_axes")))


_EDGES = f"""{LABELLED_NOTES}, nodes AS (SELECT n.*, l.combined_label FROM notes n LEFT JOIN labelled l
    ON l.patient_identifier = n.patient_identifier WHERE n.embedding IS NOT NULL),
  ranked AS (SELECT query_id, neighbour_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS place
    FROM (SELECT a.patient_identifier AS query_id, b.patient_identifier AS neighbour_id,
      round(list_cosine_similarity(a.embedding, b.embedding), 9) AS cosine
      FROM nodes a, nodes b WHERE a.patient_identifier <> b.patient_identifier)),
  edges AS MATERIALIZED (SELECT query_id, neighbour_id FROM ranked WHERE place <= {fv.SPREADING['neighbours']})"""


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    df = notes(spark, folder, features={}, vectors=True).filter(F.col(EMBEDDING).isNotNull())
    known = F.coalesce(select.is_labelled(), F.lit(False))
    return select.with_label(df).withColumn(LABEL, F.when(known, F.col(LABEL)))


@register(f"WITH {_EDGES} SELECT * FROM edges")
def neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_edges(_nodes(spark, folder))


def _spread_sql(rounds: int) -> str:
    start = ", ".join(f"CASE WHEN combined_label = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS f{i}" for i, x in enumerate(fv.LABELS))
    parts = [f"start AS MATERIALIZED (SELECT patient_identifier AS id, {start} FROM nodes)",
             "round0 AS (SELECT * FROM start)"]
    for r in range(1, rounds + 1):
        means = ", ".join(f"avg(f{i}) AS m{i}" for i in range(4))
        mixed = ", ".join(
            f"coalesce(m{i}, 0) * {NEIGHBOUR_SHARE}::DOUBLE + f{i} * (1 - {NEIGHBOUR_SHARE}::DOUBLE) AS f{i}" for i in range(4))
        parts.append(f"""round{r} AS MATERIALIZED (SELECT id, {mixed} FROM start LEFT JOIN (SELECT query_id AS id, {means}
          FROM edges JOIN round{r - 1} p ON p.id = neighbour_id GROUP BY query_id) USING (id))""")
    total = "(f0 + f1 + f2 + f3)"
    shares = ", ".join(f"CASE WHEN {total} > 0 THEN round(f{i} / {total}, 5) END AS p{i}" for i in range(4))
    return f"WITH {_EDGES}, {', '.join(parts)} SELECT id AS patient_identifier, {shares} FROM round{rounds}"


@register(_spread_sql(fv.SPREADING["rounds"]))
def spread_labels_over_graph(spark: SparkSession, folder: str) -> DataFrame:
    spread = spread_labels(_nodes(spark, folder))
    return rounded(spread.select(ID, *[F.col("probabilities")[i].alias(f"p{i}") for i in range(4)]), 5)
