"""Multinomial and complement naive Bayes as sums over TF-IDF rows.

These are closed-form models, so they need no solver: one aggregate over (row, term, weight) rows
gives the model, one broadcast join and one aggregate gives the scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from msgsieve.schema import LABELS


def class_weights(df: DataFrame) -> DataFrame:
    """``(label, n, weight)`` with weight = rows / (classes x rows of the class)."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_all", whole).select(
        "label", "n", (F.col("_all.n") / (F.col("_all.k") * F.col("n"))).alias("weight")
    )


def term_weights(train_rows: DataFrame, vocab: DataFrame, complement: bool, alpha: float = 1.0):
    """``(term, <label>...)``: what one unit of the term's weight adds to each class score.

    ``train_rows`` has (label, term, tfidf). One aggregate keyed on the term; the result is bounded
    by the vocabulary, which the left join keeps whole.
    """
    sums = train_rows.groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == c, F.col("tfidf"))).alias(c) for c in LABELS]
    )
    dense = vocab.select("term").join(sums, "term", "left").na.fill(0.0, LABELS)
    if complement:
        everything = reduce(lambda a, b: a + b, [F.col(c) for c in LABELS])
        mass = dense.select("term", *[(everything - F.col(c) + alpha).alias(c) for c in LABELS])
    else:
        mass = dense.select("term", *[(F.col(c) + alpha).alias(c) for c in LABELS])
    totals = mass.agg(F.struct(*[F.sum(c).alias(c) for c in LABELS])).scalar()
    sign = -1.0 if complement else 1.0
    return mass.withColumn("_total", totals).select(
        "term", *[(F.lit(sign) * F.log(F.col(c) / F.col(f"_total.{c}"))).alias(c) for c in LABELS]
    )


def log_priors(train: DataFrame) -> DataFrame:
    """One row with the log share of each class; a class without rows gets -infinity."""
    n = F.count(F.lit(1))
    return train.agg(
        *[
            F.coalesce(
                F.log(F.nullif(F.count_if(F.col("label") == c), F.lit(0)) / n),
                F.lit(float("-inf")),
            ).alias(c)
            for c in LABELS
        ]
    )


def scores(rows: DataFrame, tfidf: DataFrame, weights: DataFrame, priors: DataFrame | None):
    """``(row_id, keep..., <label>_score..., prediction)`` for every row, ties to the first label.

    ``rows`` keeps messages none of whose terms are in the vocabulary; they get the priors alone.
    """
    added = (
        tfidf.join(F.broadcast(weights), "term")
        .groupBy("row_id")
        .agg(*[F.sum(F.col("tfidf") * F.col(c)).alias(f"_{c}") for c in LABELS])
    )
    scored = rows.join(added, "row_id", "left")
    if priors is not None:
        scored = scored.withColumn("_prior", priors.agg(F.first(F.struct(*LABELS))).scalar())
    base = {c: F.col(f"_prior.{c}") if priors is not None else F.lit(0.0) for c in LABELS}
    scored = scored.select(
        *rows.columns,
        *[
            (F.round(F.coalesce(f"_{c}", F.lit(0.0)) + base[c], 6) + F.lit(0.0)).alias(f"{c}_score")
            for c in LABELS
        ],
    )
    best = F.greatest(*[f"{c}_score" for c in LABELS])
    prediction = F.coalesce(*[F.when(F.col(f"{c}_score") == best, c) for c in LABELS])
    return scored.withColumn("prediction", prediction)
