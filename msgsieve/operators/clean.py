"""Row-wise cleaning and keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.functions import text as X
from msgsieve.schema import MAX_CHARS, MIN_BODY, MIN_CHARS

ORDER = ("source_rank", "row_id")


def conform(
    df: DataFrame, source: str | Column, channel: str | Column, *keep: str
) -> DataFrame:
    """The common schema: text, label, source, channel (and any ``keep`` columns)."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        *keep, "text", "label", as_column(source).alias("source"), as_column(channel).alias("channel")
    )


def normalise_label(col: Column) -> Column:
    """Lower-case; the second SMS corpus says smishing for phishing."""
    lowered = F.lower(col)
    return F.when(lowered == "smishing", "phishing").otherwise(lowered)


def fold_subject(df: DataFrame) -> DataFrame:
    """Subject, a space, then the text; a missing text stays missing."""
    return df.withColumn(
        "text", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), "text")
    ).drop("subject")


def min_body(df: DataFrame, body: str = "text") -> DataFrame:
    """Keep mails whose stripped body has at least ten characters, stripped."""
    stripped = X.computed_once(df, **{body: X.strip_spaces(F.col(body))})
    return stripped.where(F.length(body) >= MIN_BODY).select(*df.columns)


def length_band(df: DataFrame) -> DataFrame:
    return df.where(F.length("text").between(MIN_CHARS, MAX_CHARS))


def for_scoring(df: DataFrame) -> DataFrame:
    """The text as ``clean_text`` leaves it, with its capital ratio, for every row: a message to be scored is
    never dropped. A missing text counts as an empty one."""
    collapsed = X.computed_once(df, text=X.collapse_spaces(F.coalesce("text", F.lit(""))))
    rest = [c for c in df.columns if c not in ("text", "capital_ratio")]
    ratio = X.capital_ratio(F.col("text")).alias("capital_ratio")
    return collapsed.select(*rest, F.lower("text").alias("text"), ratio)


def clean_text(df: DataFrame) -> DataFrame:
    """Drop missing texts, collapse whitespace, drop emptied texts, apply the length band,
    save the capital ratio, lower-case. One narrow stage, no shuffle."""
    present = df.where(F.col("text").isNotNull())
    collapsed = X.computed_once(present, text=X.collapse_spaces(F.col("text")))
    kept = length_band(collapsed.where(F.length("text") > 0))
    return kept.select(
        *[c for c in df.columns if c != "text"],
        F.lower("text").alias("text"),
        X.capital_ratio(F.col("text")).alias("capital_ratio"),
    )


def keep_first(df: DataFrame, key: Column, order=ORDER, conflicts: bool = False) -> DataFrame:
    """One row per key: the first in ``order``.

    The key is a digest, so neither the sort nor the exchange compares whole texts, and ``min_by``
    combines on the map side: a text that makes up a third of the input leaves each task as a
    single row. ``conflicts`` adds how many copies there were and how many labels they carried
    (one flag per label of the closed domain, no set is collected).
    """
    extra = []
    if conflicts:
        extra = [
            F.count(F.lit(1)).alias("copies"),
            (F.min("label") != F.max("label")).cast("int").alias("label_conflict"),
        ]
    row = F.struct(*df.columns)
    survivors = df.groupBy(X.text_digest(key).alias("_key")).agg(
        F.min_by(row, F.struct(*order)).alias("_row"), *extra
    )
    return survivors.select("_row.*", *[c for c in survivors.columns if not c.startswith("_")])


def dedup_exact(df: DataFrame, **kwargs) -> DataFrame:
    return keep_first(df, F.col("text"), **kwargs)


def dedup_template(df: DataFrame, **kwargs) -> DataFrame:
    return keep_first(df, X.template_key(F.col("text")), **kwargs)


def repair(df: DataFrame) -> DataFrame:
    return df.withColumn("text", X.fix_encoding(F.col("text")))


def prepare(df: DataFrame) -> DataFrame:
    """Raw combined messages to the final training table, in one shuffle.

    The exact duplicates of a text share its template key, so the first row of a template group is
    also the first of its exact group: template dedup alone gives what exact dedup followed by
    template dedup gives.
    """
    return dedup_template(repair(clean_text(df)))


def attrition(df: DataFrame) -> DataFrame:
    """Rows left after each cleaning stage, as ``(step, stage, rows, lost)``.

    Row-wise stages are counted where the rows are. The distinct counts go through two groupings on
    digests, the second on the output of the first, so no row is expanded per distinct column.
    """
    flags = (
        X.computed_once(df.select("text"), clean=X.collapse_spaces(F.col("text")))
        .select(
            F.col("text").isNotNull().alias("present"),
            (F.length("clean") > 0).alias("filled"),
            F.length("clean").between(MIN_CHARS, MAX_CHARS).alias("banded"),
            F.lower("clean").alias("low"),
        )
        .select(
            "present",
            "filled",
            "banded",
            F.when(F.col("banded"), X.text_digest(F.col("low"))).alias("exact"),
            F.when(
                F.col("banded"), X.text_digest(X.template_key(X.fix_encoding(F.col("low"))))
            ).alias("template"),
        )
    )
    per_text = flags.groupBy("template", "exact").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if("present").alias("present"),
        F.count_if("filled").alias("filled"),
        F.count_if("banded").alias("banded"),
    )
    per_template = per_text.groupBy("template").agg(
        *[F.sum(c).alias(c) for c in ("raw", "present", "filled", "banded")],
        F.count("exact").alias("exact"),
    )
    totals = per_template.agg(
        *[F.sum(c).alias(c) for c in ("raw", "present", "filled", "banded", "exact")],
        F.count("template").alias("template"),
    )
    stages = [
        ("raw", "raw", "raw"),
        ("text_present", "present", "raw"),
        ("text_not_empty", "filled", "present"),
        ("length_band", "banded", "filled"),
        ("exact_dedup", "exact", "banded"),
        ("template_dedup", "template", "exact"),
    ]
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step"),
                        F.lit(name).alias("stage"),
                        F.coalesce(F.col(now), F.lit(0)).cast("long").alias("rows"),
                        F.coalesce(F.col(before) - F.col(now), F.lit(0)).cast("long").alias("lost"),
                    )
                    for i, (name, now, before) in enumerate(stages)
                ]
            )
        )
    )
