"""Column names, closed domains and the stand-in ``messages`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The closed domains of the data model, labels in class-index order.
LABELS = ["ham", "phishing", "spam"]
CHANNELS = ["email", "sms"]
SOURCES = ["uci_sms", "mishra_sms", "nazario", "spamassassin"]

# Seed, length band and vocabulary limits of the pipeline.
SEED = 42
MIN_CHARS, MAX_CHARS = 10, 10_000
MIN_BODY = 10
SHORT_TEXT = 5
TEST_SHARE = 0.2
FOLDS = 5
MAX_FEATURES = 5_000
MIN_DF = 2
MAX_DF = 0.95

LABELLED_TEXT = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]
)
FLAGGED_TEXT = T.StructType(
    [
        T.StructField("LABEL", T.StringType()),
        T.StructField("TEXT", T.StringType()),
        T.StructField("URL", T.StringType()),
        T.StructField("EMAIL", T.StringType()),
        T.StructField("PHONE", T.StringType()),
    ]
)
PARSED_MAIL = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled messages from ``documents`` and ``labels``.

    The join carries no hint: the label table grows with the data, so Catalyst broadcasts it
    only while its measured size is under the threshold and sort-merges it beyond.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return labelled.select(
        F.col("doc_id").alias("row_id"),
        "text",
        "source",
        F.regexp_extract("source", r"([0-9]+)$", 1).cast("int").alias("source_rank"),
        F.when(F.col("n_chars") < 1000, "sms").otherwise("email").alias("channel"),
        F.when(F.col("toxic") == 1, "phishing")
        .when(F.col("quality") == 0, "spam")
        .otherwise("ham")
        .alias("label"),
    )
