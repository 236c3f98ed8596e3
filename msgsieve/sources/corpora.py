"""Scans of the four labelled corpora into the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from msgsieve.operators.clean import conform, fold_subject, normalise_label
from msgsieve.operators.quality import union_sources
from msgsieve.schema import FLAGGED_TEXT, LABELLED_TEXT

def position() -> Column:
    """Where a row stands in its source: file, offset of the file's block, place in the task.

    Constant for the same files and settings, which keep-first deduplication relies on.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def scan_tsv(spark: SparkSession, path: str, source="uci_sms", channel="sms") -> DataFrame:
    """Headerless ``label<TAB>text`` lines, split at the first tab: all that follows it is text.

    A line without a tab has no text. Blank lines are skipped.
    """
    lines = spark.read.text(path).withColumn("position", position()).where(F.length("value") > 0)
    tab = F.instr("value", "\t")
    text = F.when(tab > 0, F.nullif(F.col("value").substr(tab + 1, F.length("value")), F.lit("")))
    label = F.nullif(F.substring_index("value", "\t", 1), F.lit(""))
    raw = lines.select(label.alias("label"), text.alias("text"), "position")
    return conform(raw, source, channel, "position")


def scan_flagged_csv(spark: SparkSession, path: str, source="mishra_sms", channel="sms") -> DataFrame:
    """``LABEL,TEXT,URL,EMAIL,PHONE`` with a header; the three flags are dropped."""
    raw = spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', schema=FLAGGED_TEXT,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    rows = raw.select(
        position().alias("position"), normalise_label(F.col("LABEL")).alias("label"), F.col("TEXT").alias("text")
    )
    return conform(rows, source, channel, "position")


def conform_mail(parsed: DataFrame, source: str, *keep: str) -> DataFrame:
    """Parsed mail rows (text, subject, label) to the common schema."""
    return conform(fold_subject(parsed), source, "email", *keep)


def combine(
    spark: SparkSession, tsv: str, flagged_csv: str, phishing_mail: str, ham_spam_mail: str
) -> DataFrame:
    """All four corpora in their fixed order; ``source_rank`` and ``position`` order the rows."""
    parsed = lambda path: spark.read.parquet(path).withColumn("position", position())
    return union_sources(
        [
            scan_tsv(spark, tsv),
            scan_flagged_csv(spark, flagged_csv),
            conform_mail(parsed(phishing_mail), "nazario", "position"),
            conform_mail(parsed(ham_spam_mail), "spamassassin", "position"),
        ]
    )
