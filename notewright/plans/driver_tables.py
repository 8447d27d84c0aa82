"""The given tables seen as note tables.

Columns computed from text are computed on the scan, so that only their small
results travel through the joins that add flags and vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.schema import EMBEDDING, ID, SCHEME, TEST_SET, TEXT, LabelScheme

# Sources that stand for the official test set, whose flags are hidden.
TEST_SOURCES = ("src0", "src5", "src10", "src15")

# Words of the given texts and the clinical phrases put in their place.
CLINICAL_PHRASES = (
    ("thble", "type 2 diabetes"),
    ("ertion", "carcinoma"),
    ("nicht", "no history of diabetes"),
    ("license", "insulin-dependent diabetes"),
    ("apache", "Langerhans"),
    ("erhe", "metastatic"),
    ("thwh", "diabetic neuropathy"),
    ("onnd", "history of breast cancer"),
    ("pour", "benign"),
    ("sich", "diabetes insipidus"),
    ("erwh", "metformin"),
    ("auf", "no evidence of malignancy"),
)

# First words of lines that are renamed to known headers.
HEADER_WORDS = (
    ("The", "Diagnosis"),
    ("And", "Gender"),
    ("Of", "Sex"),
    ("De", "Age"),
    ("In", "Treatment"),
    ("To", "Hospital Course"),
    ("Was", "Discharge Medications"),
    ("Der", "Follow-up"),
    ("Is", "Chief Complaint"),
    ("It", "Final Diagnosis"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cores when a scan has fewer splits than there are cores.

    Text work is the costly part of most queries, and a small table comes as one
    split. A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, spread for text work."""
    return spread(table(spark, folder, "documents"), "doc_id")


def clinical(text: Column) -> Column:
    """A given text with clinical phrases in place of some of its letter groups."""
    for word, phrase in CLINICAL_PHRASES:
        text = F.replace(text, F.lit(word), F.lit(phrase))
    return text


def notes(
    spark: SparkSession,
    folder: str,
    features: dict[str, Column] | None = None,
    vectors: bool = False,
    scheme: LabelScheme = SCHEME,
    truth: bool = False,
) -> DataFrame:
    """Documents as notes, with flags and, on request, vectors and the hidden flags.

    ``features`` replaces the text column by columns computed from it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    needs_text = features is None or len(features) > 0
    docs = documents(spark, folder) if needs_text else table(spark, folder, "documents")
    docs = docs.withColumn("text", text)
    in_test = F.col("source").isin(*TEST_SOURCES)
    columns = {TEXT: F.col("text")} if features is None else features
    base = docs.select(
        F.col("doc_id").alias(ID),
        in_test.cast("int").alias(TEST_SET),
        *[c.alias(name) for name, c in columns.items()],
    )
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias(ID), F.col("quality").cast("double").alias("_a"), F.col("toxic").cast("double").alias("_b")
    )
    open_rows = F.col(TEST_SET) == 0
    flags = {scheme.flag_a: F.when(open_rows, F.col("_a")), scheme.flag_b: F.when(open_rows, F.col("_b"))}
    if truth:
        flags |= {"true_a": F.col("_a"), "true_b": F.col("_b")}
    df = base.join(labels, ID, "left").withColumns(flags).drop("_a", "_b")
    if vectors:
        stored = table(spark, folder, "embeddings").select(F.col("vec_id").alias(ID), F.col("embedding").alias(EMBEDDING))
        df = df.join(stored, ID, "left")
    return df


def headed(text: Column) -> Column:
    """A given text whose lines start with ``header: ``, made from each line's first word."""
    text = F.regexp_replace(text, r"(?md)^([\p{L}\p{N}_]+) ", "$1: ")
    for word, header in HEADER_WORDS:
        text = F.regexp_replace(text, f"(?md)^{word}: ", f"{header}: ")
    return text


def answer_text(names: tuple[str, str, str, str, str]) -> Column:
    """An answer about a document: its source picks one of the shapes an answer may take.

    ``names`` are the five line prefixes in order.
    """
    label, flag_a, flag_b, confidence, reason = (F.lit(n) for n in names)
    nl = F.lit("\n")
    first_line = F.element_at(F.split("text", "\n"), 1)
    usual = F.concat(
        label, F.lit(" "), F.when(F.col("lang") == "en", "Both").otherwise("Cancer Only"), nl,
        flag_a, F.lit(" 1.0"), nl, flag_b, F.when(F.col("lang") == "en", " 1.0").otherwise(" 0.0"), nl,
        confidence, F.lit(" 0.9"), nl, reason, F.lit(" "), first_line,
    )
    shapes = {
        "src1": F.concat(label, F.lit(" Both")),
        "src2": F.concat(usual, nl, label, F.lit(" Neither")),
        "src3": F.regexp_replace(usual, r"(?md)^", "  "),
        "src4": F.concat(usual, nl, confidence, F.lit(" high")),
        "src5": F.concat(usual, nl, flag_a, F.lit(" yes")),
        "src6": F.concat(usual, nl, reason, F.lit(" because: so")),
        "src7": F.concat(usual, nl, reason),
        "src8": F.concat(label, F.lit(" Unsure"), nl, confidence, F.lit(" .5e0")),
        "src9": F.lit(None).cast("string"),
    }
    chosen = None
    for source, shape in shapes.items():
        is_source = F.col("source") == source
        chosen = F.when(is_source, shape) if chosen is None else chosen.when(is_source, shape)
    return chosen.otherwise(usual)


def softmax_scores(vector: Column, first: int) -> Column:
    """Class scores from four entries of a vector: fixture input, not a trained model."""
    parts = [F.exp(vector[first + i].cast("double") * 8.0) for i in range(4)]
    return F.array(*[p / (parts[0] + parts[1] + parts[2] + parts[3]) for p in parts])


def logistic_score(vector: Column, entry: int) -> Column:
    """A 0-1 score from one entry of a vector: fixture input, not a trained model."""
    return 1.0 / (1.0 + F.exp(vector[entry].cast("double") * -8.0))
