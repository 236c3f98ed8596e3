"""Union of sources, validation, overlap, counts and the numeric profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from msgsieve.functions.text import text_digest
from msgsieve.operators.ranks import exact_quantiles
from msgsieve.schema import CHANNELS, LABELS, SHORT_TEXT


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Union all; ``source_rank`` records the order that decides which duplicate survives."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def validate(df: DataFrame) -> DataFrame:
    """Tidy rows ``(check, value, n)``: missing values per column, short texts, unknown labels and
    channels. Every row is read once for the counts and once, two columns wide, for the domains."""
    checks = [(f"missing_{c}", F.col(c).isNull()) for c in ("text", "label", "source", "channel")]
    checks.append(("short_text", F.length("text") < SHORT_TEXT))
    counted = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks])
    counts = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("check"), F.lit("").alias("value"), F.col(n).alias("n"))
                    for n, _ in checks
                ]
            )
        )
    )
    pairs = df.groupBy("label", "channel").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession

    def unknown(col, domain):
        known = spark.createDataFrame([(v,) for v in domain], f"{col} string")
        return (
            pairs.where(F.col(col).isNotNull())
            .join(known, col, "left_anti")
            .groupBy(F.lit(f"unknown_{col}").alias("check"), F.col(col).alias("value"))
            .agg(F.sum("n").alias("n"))
        )

    return counts.unionByName(unknown("label", LABELS)).unionByName(unknown("channel", CHANNELS))


def source_overlap(df: DataFrame) -> DataFrame:
    """Distinct texts that two sources share, per pair of sources.

    Each text is reduced to the set of sources that hold it, the sets are counted, and pairs are
    formed from the distinct sets only. No pair of messages is ever produced, whatever a text's
    number of copies; a set is bounded by the number of sources.
    """
    held = (
        df.where(F.col("text").isNotNull())
        .groupBy(text_digest(F.col("text")).alias("_key"), "source")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list("source")).alias("_held"))
        .where(F.size("_held") > 1)
    )
    sets = held.groupBy("_held").agg(F.count(F.lit(1)).alias("n"))
    return (
        sets.select("_held", "n", F.posexplode("_held").alias("_pos", "source_a"))
        .select(
            "source_a",
            "n",
            F.explode(F.slice("_held", F.col("_pos") + 2, F.size("_held"))).alias("source_b"),
        )
        .groupBy("source_a", "source_b")
        .agg(F.sum("n").alias("shared_texts"))
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def crosstab(df: DataFrame, row: str = "channel", col: str = "label", domain=LABELS) -> DataFrame:
    """Zero-filled counts; the closed domain spares the pivot its extra pass."""
    return df.groupBy(row).pivot(col, domain).count().na.fill(0)


def labels_per_source(df: DataFrame) -> DataFrame:
    pairs = df.groupBy("source", "label").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("source").agg(
        F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels")
    )


def describe(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles as ``(statistic, value)``."""
    moments = df.agg(
        F.count(col).cast("double").alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        F.max(col).cast("double").alias("max"),
    )
    names = ["count", "mean", "std", "min", "max"]
    rows = moments.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names]))
    )
    quartiles = exact_quantiles(df, col, (0.25, 0.5, 0.75), low, high).select(
        F.concat(F.format_number(F.col("prob") * 100, 0), F.lit("%")).alias("statistic"), "value"
    )
    return rows.unionByName(quartiles)


def first_per_label(df: DataFrame, order=("row_id",)) -> DataFrame:
    """The first message of each label, in the order phishing, spam, ham."""
    row = F.struct(*[c for c in df.columns if c != "label"])
    first = df.groupBy("label").agg(F.min_by(row, F.struct(*order)).alias("_row"))
    place = F.array_position(F.array(*[F.lit(v) for v in ("phishing", "spam", "ham")]), F.col("label"))
    return first.select("label", "_row.*").orderBy(place)


def cell(df: DataFrame, channel: str = "sms", label: str = "phishing") -> DataFrame:
    return df.where((F.col("channel") == channel) & (F.col("label") == label))


def head_of_cell(df: DataFrame, n: int = 3, channel: str = "sms", label: str = "phishing") -> DataFrame:
    return cell(df, channel, label).orderBy("row_id").limit(n)
