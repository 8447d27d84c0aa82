"""Class-weighted linear models and a random forest on embeddings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import fixed_values as fv
from notewright.functions.labels import label_at
from notewright.operators import newton
from notewright.operators.newton import LinearModel
from notewright.schema import EMBEDDING, LABEL, SCHEME, LabelScheme
from notewright.session import cut_lineage

_ROWS_PER_PARTITION = 10_000


def class_weights(df: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Balanced weight per class present: rows / (classes * rows of the class)."""
    everything = Window.partitionBy(F.lit(1))
    counts = df.groupBy(label_col).agg(F.count("*").alias("n"))
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    )


@dataclass(frozen=True)
class FittedClassifier:
    """A fitted model with the values its classes stand for, in class order."""

    model: Model | LinearModel
    classes: tuple

    def probabilities(self, order: Sequence) -> Column:
        """The model's probabilities as an array in the given order, 0 for a class it never saw."""
        own = vector_to_array("probability")
        return F.array(*[
            own[self.classes.index(value)] if value in self.classes else F.lit(0.0) for value in order
        ])

    def transform(self, df: DataFrame, order: Sequence, name: str, vector: str = EMBEDDING) -> DataFrame:
        """Add the probability array as column ``name``."""
        kept = df.columns
        if isinstance(self.model, LinearModel):
            scored = df.withColumn("probability", self.model.probability(F.col(vector).cast("array<double>")))
            own = F.col("probability")
            listed = F.array(*[own[self.classes.index(v)] if v in self.classes else F.lit(0.0) for v in order])
            return scored.select(*[F.col(c) for c in kept if c != name], listed.alias(name))
        scored = self.model.transform(_with_features(df, vector))
        return scored.select(*[F.col(c) for c in kept if c != name], self.probabilities(order).alias(name))


def _with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def _training_rows(
    df: DataFrame, target: str, order: Sequence, vector: str, balanced: bool, written: bool
) -> tuple[DataFrame, tuple, float]:
    """Features, class numbers and weights, the classes present, and the sum of weights.

    Fitting reads its rows again and again, so unless they come from a written
    table already, the two columns it needs are written down first.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(target).isin(*order)).select(target, vector)
    if not written:
        rows = cut_lineage(rows)
    # At most one row per listed class.
    counts = {r[target]: r["n"] for r in rows.groupBy(target).agg(F.count("*").alias("n")).collect()}
    classes = tuple(value for value in order if value in counts)
    if len(classes) < 2:
        raise ValueError("training needs at least two classes")
    total = sum(counts.values())
    number = F.coalesce(*[F.when(F.col(target) == value, F.lit(float(i))) for i, value in enumerate(classes)])
    share = F.coalesce(*[
        F.when(F.col(target) == value, F.lit(total / (len(classes) * counts[value]) if balanced else 1.0))
        for value in classes
    ])
    prepared = _with_features(rows, vector).select("features", number.alias("label"), share.alias("weight"))
    # Few rows in many partitions would make every pass wait for scheduling.
    enough = math.ceil(total / _ROWS_PER_PARTITION)
    return prepared.coalesce(enough), classes, float(total)


def fit_logistic(
    df: DataFrame,
    target: str,
    order: Sequence,
    vector: str = EMBEDDING,
    balanced: bool = True,
    c: float = fv.LOGISTIC["C"],
    max_iter: int = fv.LOGISTIC["max_iter"],
    written: bool = False,
) -> FittedClassifier:
    """L2-regularised logistic regression with loss weight ``c`` against half the squared norm.

    Fitted by Newton steps (``newton.py``) as long as the Hessian is within its bound, else by
    Spark ML's solver, which reaches the same optimum less exactly. Weights sum to the row count,
    balanced or not, which sets the scale between the solver's mean loss and the penalty.
    ``written`` says that the rows come from a written table.
    """
    rows, classes, total = _training_rows(df, target, order, vector, balanced, written)
    entries = rows.select(F.size(vector_to_array("features"))).first()[0]
    if newton.cells(len(classes), entries) <= newton.CELLS:
        table = rows.select(vector_to_array("features").alias("features"), F.col("label").cast("int").alias("label"), "weight")
        return FittedClassifier(newton.fit(table, len(classes), entries, 1.0 / c, max_iter), classes)
    estimator = LogisticRegression(
        family="binomial" if len(classes) == 2 else "multinomial",
        featuresCol="features", labelCol="label", weightCol="weight",
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-9,
    )
    return FittedClassifier(estimator.fit(rows), classes)


def fit_flag_models(
    df: DataFrame, scheme: LabelScheme = SCHEME, vector: str = EMBEDDING, written: bool = False
) -> tuple[FittedClassifier, FittedClassifier]:
    """One balanced binary model per flag, A first; the rows are written down once for both."""
    rows = df if written else cut_lineage(df.select(scheme.flag_a, scheme.flag_b, vector))
    return (
        fit_logistic(rows, scheme.flag_a, (0.0, 1.0), vector, written=True),
        fit_logistic(rows, scheme.flag_b, (0.0, 1.0), vector, written=True),
    )


def fit_label_model(
    df: DataFrame, scheme: LabelScheme = SCHEME, vector: str = EMBEDDING, balanced: bool = True,
    written: bool = False,
) -> FittedClassifier:
    """A model of the four labels; class order is the canonical one."""
    return fit_logistic(df, LABEL, scheme.labels, vector, balanced, written=written)


def fit_forest(
    df: DataFrame,
    scheme: LabelScheme = SCHEME,
    vector: str = EMBEDDING,
    trees: int = fv.FOREST["trees"],
    depth: int = fv.FOREST["depth"],
    seed: int = fv.SEED,
) -> FittedClassifier:
    """A random forest over the four labels."""
    rows, classes, _ = _training_rows(df, LABEL, scheme.labels, vector, balanced=False, written=False)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed
    )
    return FittedClassifier(forest.fit(rows), classes)


def score_flags(
    df: DataFrame, models: tuple[FittedClassifier, FittedClassifier], vector: str = EMBEDDING
) -> DataFrame:
    """Add ``p_a`` and ``p_b``, the probability of each flag."""
    for model, name in zip(models, ("p_a", "p_b")):
        df = model.transform(df, (0.0, 1.0), name, vector).withColumn(name, F.col(name)[1])
    return df


def score_labels(
    df: DataFrame, model: FittedClassifier, name: str, scheme: LabelScheme = SCHEME, vector: str = EMBEDDING
) -> DataFrame:
    """Add ``<name>_probs`` in canonical label order and ``<name>_pred``."""
    scored = model.transform(df, scheme.labels, f"{name}_probs", vector)
    return scored.withColumn(f"{name}_pred", label_at(F.col(f"{name}_probs"), scheme))
