"""Weighted word features of one- and two-word terms."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.text import bound
from notewright.schema import TEXT
from notewright.session import cut_lineage

# Words sent to every task to sort out pairs.
_MAX_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Lower-case words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def _pairs(own: Column) -> Column:
    """Each two adjacent words, joined by a space."""
    places = F.sequence(F.lit(0), F.greatest(F.size(own) - 2, F.lit(0)))
    pairs = F.transform(places, lambda i: F.concat_ws(" ", own[i], own[i + 1]))
    return F.when(F.size(own) > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """The words of a note, then its pairs of adjacent words."""
    return bound(words(text), lambda own: F.concat(own, _pairs(own)))


def _marked(own: Column) -> Column:
    """Sorted terms, the first of each kind marked."""
    return F.transform(
        own, lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(own, i - 1) != t)).alias("first"))
    )


def _statistics(uses: DataFrame) -> DataFrame:
    return uses.groupBy("term").agg(F.count_if("first").alias("n_notes"), F.count("*").alias("n_uses"))


def term_statistics(df: DataFrame, text: str = TEXT) -> DataFrame:
    """Notes and occurrences per term.

    Terms are sorted inside each note to mark the first of each kind, so both
    numbers come from one shuffle of counts combined before it.
    """
    return _statistics(df.select(F.inline(bound(F.sort_array(terms(F.col(text))), _marked))))


def vocabulary(
    df: DataFrame,
    n_notes: int,
    max_features: int = fv.TFIDF["max_features"],
    min_df: int = fv.TFIDF["min_df"],
    max_df: float = fv.TFIDF["max_df"],
    text: str = TEXT,
    max_broadcast: int = _MAX_BROADCAST,
) -> DataFrame:
    """The most used terms that are neither too rare nor too common, with their smoothed idf.

    Single words are counted first. Once enough of them qualify, a pair can only
    be among the most used if both its words are used as often as the last of
    them, so all other pairs are dropped on the scan, before any shuffle. Those
    words are broadcast if they are few; else every pair is counted.
    """
    def qualify(statistics: DataFrame) -> DataFrame:
        return statistics.filter(
            (F.col("n_notes") >= min_df) & (F.col("n_notes") <= F.lit(float(max_df * n_notes)))
        )

    def top(statistics: DataFrame) -> DataFrame:
        return statistics.orderBy(F.desc("n_uses"), "term").limit(max_features)

    single = cut_lineage(_statistics(df.select(F.inline(bound(F.sort_array(words(F.col(text))), _marked)))))
    last = top(qualify(single)).agg(F.count("*").alias("n"), F.min("n_uses").alias("uses")).first()
    pairs = df.select(F.inline(bound(F.sort_array(bound(words(F.col(text)), _pairs)), _marked)))
    if last.n == max_features:
        often = single.filter(F.col("n_uses") >= last.uses).select("term")
        if often.count() <= max_broadcast:
            for place in (1, 2):
                word = F.broadcast(often.withColumnRenamed("term", "word"))
                pairs = pairs.join(word, F.split_part("term", F.lit(" "), F.lit(place)) == F.col("word"), "left_semi")
    idf = F.log(F.lit(1.0 + n_notes) / (F.col("n_notes") + 1.0)) + 1.0
    return top(qualify(single.unionByName(_statistics(pairs)))).withColumn("idf", idf)


def tfidf_features(df: DataFrame, text: str = TEXT, output: str = "tfidf", **options) -> DataFrame:
    """Add unit-length tf-idf vectors over the table's own vocabulary.

    The vocabulary is bounded by ``max_features``, so it travels to every task;
    notes are vectorised where they are.
    """
    n_notes = df.count()
    listed = vocabulary(df, n_notes, text=text, **options).select("term", "idf").collect()
    listed.sort(key=lambda row: row["term"])
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in listed], inputCol="_terms", outputCol="_counts"
    )
    weigher = ElementwiseProduct(
        scalingVec=Vectors.dense([row["idf"] for row in listed]), inputCol="_counts", outputCol="_weighted"
    )
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output)
    with_terms = df.withColumn("_terms", terms(F.col(text)))
    return unit.transform(weigher.transform(counter.transform(with_terms))).drop("_terms", "_counts", "_weighted")
