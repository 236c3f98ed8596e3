"""Evaluation from one small table of counts per (model, channel, label, prediction)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from msgsieve.schema import LABELS

ALL = "all"


def counts(predictions: DataFrame, *by: str) -> DataFrame:
    """The only pass over the predictions; everything below works on its few rows."""
    return predictions.groupBy(*by, "channel", "label", "prediction").agg(
        F.count(F.lit(1)).alias("n")
    )


def with_slices(cells: DataFrame) -> DataFrame:
    """Each cell once for the overall slice and once for its channel."""
    return cells.withColumn("slice", F.explode(F.array(F.lit(ALL), F.col("channel"))))


def confusion_matrix(cells: DataFrame, *by: str) -> DataFrame:
    """Rows true, columns predicted, every label of the domain present."""
    pivoted = cells.groupBy(*by, "label").pivot("prediction", LABELS).agg(F.sum("n"))
    return pivoted.na.fill(0, LABELS).orderBy(*by, "label")


def marginals(cells: DataFrame, *by: str) -> DataFrame:
    """``(by..., slice, label, hit, support, predicted)`` over labels seen in truth or prediction.

    Each cell gives one row to its true label and one to its predicted label; summing them is the
    full outer join of the two marginals without a join.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = with_slices(cells).select(
        *by,
        "slice",
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("label"),
                    hit.cast("long").alias("hit"),
                    F.col("n").alias("support"),
                    zero.alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    zero.alias("hit"),
                    zero.alias("support"),
                    F.col("n").alias("predicted"),
                ),
            )
        ),
    )
    return sides.groupBy(*by, "slice", "label").agg(
        *[F.sum(c).alias(c) for c in ("hit", "support", "predicted")]
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class(cells: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per slice and label; a zero division counts as 0."""
    return marginals(cells, *by).select(
        *by,
        "slice",
        "label",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hit",
    )


def summary(cells: DataFrame, *by: str) -> DataFrame:
    """``(by..., slice, macro_f1, weighted_f1, accuracy, n)``."""
    return (
        per_class(cells, *by)
        .groupBy(*by, "slice")
        .agg(
            F.avg("f1").alias("macro_f1"),
            (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
            (F.sum("hit") / F.sum("support")).alias("accuracy"),
            F.sum("support").alias("n"),
        )
    )


def class_report(cells: DataFrame, *by: str) -> DataFrame:
    """Overall precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    classes = per_class(cells, *by).where(F.col("slice") == ALL)
    rows = classes.select(*by, F.col("label").alias("row"), "precision", "recall", "f1", "support")
    share = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    means = classes.groupBy(*by).agg(
        F.struct(
            F.lit("macro avg").alias("row"),
            *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("row"),
            *[share(c).alias(c) for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        ).alias("weighted"),
        F.struct(
            F.lit("accuracy").alias("row"),
            *[(F.sum("hit") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        ).alias("accuracy"),
    )
    return rows.unionByName(means.select(*by, F.inline(F.array("macro", "weighted", "accuracy"))))


def class_scores(cells: DataFrame, *by: str, label: str = "phishing") -> DataFrame:
    return (
        per_class(cells, *by)
        .where((F.col("slice") == ALL) & (F.col("label") == label))
        .select(*by, "precision", "recall")
    )


def cell_recall(cells: DataFrame, *by: str, channel: str = "sms", label: str = "phishing"):
    """Recall and size of one (channel, label) cell; no row where the cell is empty."""
    inside = cells.where((F.col("channel") == channel) & (F.col("label") == label))
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return inside.groupBy(*by).agg((right / F.sum("n")).alias("recall"), F.sum("n").alias("n"))


def metric_rows(cells: DataFrame, *by: str) -> DataFrame:
    """Tidy ``(by..., slice, metric, value)``: what a run reports for each model."""
    overall = summary(cells, *by)
    long = overall.select(
        *by,
        "slice",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in ("macro_f1", "weighted_f1")
                ]
            )
        ),
    ).where((F.col("slice") == ALL) | (F.col("metric") == "macro_f1"))
    phishing = class_scores(cells, *by).select(
        *by,
        F.lit(ALL).alias("slice"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f"phishing_{m}").alias("metric"), F.col(m).alias("value"))
                    for m in ("precision", "recall")
                ]
            )
        ),
    )
    cell = cell_recall(cells, *by).select(
        *by,
        F.lit("sms").alias("slice"),
        F.inline(
            F.array(
                F.struct(F.lit("phishing_recall").alias("metric"), F.col("recall").alias("value")),
                F.struct(F.lit("phishing_n").alias("metric"), F.col("n").cast("double").alias("value")),
            )
        ),
    )
    return reduce(lambda a, b: a.unionByName(b), [long, phishing, cell])


def leaderboard(cells: DataFrame) -> DataFrame:
    """Models by overall macro F1, best first, with both channels beside it."""
    return (
        summary(cells, "model")
        .groupBy("model")
        .pivot("slice", [ALL, "email", "sms"])
        .agg(F.max("macro_f1"))
        .withColumnsRenamed({ALL: "macro_f1", "email": "email_macro_f1", "sms": "sms_macro_f1"})
        .orderBy(F.desc("macro_f1"), "model")
    )


def best_model(cells: DataFrame) -> DataFrame:
    return leaderboard(cells).limit(1)


def side_by_side(metrics: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """``(by..., slice, metric, <a>, <b>, difference)`` of two variants."""
    return (
        metrics.groupBy(*by, "slice", "metric")
        .pivot("experiment", [a, b])
        .agg(F.max("value"))
        .withColumn("difference", F.col(b) - F.col(a))
    )


def error_triage(predictions: DataFrame, *by: str, channel="sms", label="phishing", preview=200):
    """Rows of one cell, worst mistakes first: phishing taken for ham, then for spam, then right."""
    severity = (
        F.when(F.col("prediction") == label, 2).when(F.col("prediction") == "ham", 0).otherwise(1)
    )
    return (
        predictions.where((F.col("channel") == channel) & (F.col("label") == label))
        .select(
            *by,
            "row_id",
            "prediction",
            severity.alias("severity"),
            F.substring("text", 1, preview).alias("preview"),
        )
        .orderBy(*by, "severity", "row_id")
    )


def top_per_class(weights: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` largest weights of each class, as ``(class, rank, feature, weight)``."""
    order = W.partitionBy("class").orderBy(F.desc("weight"), "feature")
    return (
        weights.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("class", "rank", "feature", "weight")
    )
