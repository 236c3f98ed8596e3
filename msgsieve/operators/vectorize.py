"""Vocabulary, TF-IDF (long form and vectors), scaled signals and the full feature pipeline."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.functions import tokens as K
from msgsieve.functions.grams import GramCounter, gram_counts, gram_rows, token_counts
from msgsieve.functions.signals import SIGNALS_8, SIGNALS_13, signal_transformer
from msgsieve.functions.sqltext import regex
from msgsieve.functions.text import SOURCE_PATTERN, YEAR_PATTERN
from msgsieve.operators.solver import Weighing
from msgsieve.schema import MAX_DF, MAX_FEATURES, MIN_DF
from msgsieve.session import scratch_path
from msgsieve.sources.sinks import feature_rows

TOKENIZERS = {"word": K.word_ngrams, "char": K.char_ngrams}
#: Stages that count the terms of a vocabulary.
COUNTERS = (CountVectorizerModel, GramCounter)
# Only the word vocabulary drops terms that almost every message has.
MAX_DF_OF = {"word": MAX_DF, "char": 1.0}


def token_rows(df: DataFrame, kind: str, *keep: str) -> DataFrame:
    """Rows ``(keep..., term, tf)`` of the word or character n-grams of ``text``."""
    if kind == "char":
        return gram_rows(df, *keep)
    tokens = TOKENIZERS[kind](out="_tokens").transform(df.select(*keep, "text"))
    return K.explode_terms(tokens, "_tokens", *keep)


def vocabulary(
    train: DataFrame, kind: str, max_features: int = MAX_FEATURES, min_df: int = MIN_DF
) -> DataFrame:
    """``(term, df, tf, n_docs)``: the most frequent terms of the training rows, ties by term.

    One shuffle, on the term alone: the repeats of many rows are already folded into ``df`` and ``tf``, and partial
    aggregation folds frequent terms on the map side. The result has at most ``max_features`` rows.
    """
    n_docs = train.agg(F.count(F.lit(1))).scalar()
    if kind == "char":
        counts = gram_counts(train)
    else:
        counts = token_counts(TOKENIZERS[kind](out="_tokens").transform(train.select("text")), "_tokens")
    return (
        counts.groupBy("term")
        .agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"))
        .withColumn("n_docs", n_docs)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.col("n_docs") * MAX_DF_OF[kind]))
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )


def idf() -> Column:
    """Smoothed inverse document frequency of a vocabulary row."""
    return F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1


def tfidf_model(kind: str, fitted: DataFrame, text: str, out: str) -> PipelineModel:
    """Stages from text to the normalised vector over the vocabulary ``fitted(term, idf)``: stock ones but for the counts of
    character n-grams."""
    # At most max_features rows; alphabetical, so that the order of ties cannot show.
    terms = sorted(fitted.select("term", "idf").collect(), key=lambda r: r.term)
    if not terms:
        raise ValueError(f"no {kind} term is frequent enough for a vocabulary")
    tokens, counts, weighted = (f"_{kind}_{s}" for s in ("tokens", "counts", "weighted"))
    names = [r.term for r in terms]
    if kind == "char":
        counters = [GramCounter(names, inputCol=text, outputCol=counts)]
    else:
        counters = [TOKENIZERS[kind](text, tokens), CountVectorizerModel.from_vocabulary(names, inputCol=tokens, outputCol=counts)]
    weight = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in terms]), inputCol=counts, outputCol=weighted)
    unit = Normalizer(p=2.0, inputCol=weighted, outputCol=out)
    return PipelineModel([*counters, weight, unit])


def _counter(model: PipelineModel):
    return next(s for s in model.stages if isinstance(s, COUNTERS))


def tfidf_rows(df: DataFrame, vocab: DataFrame, kind: str, *keep: str) -> DataFrame:
    """``(row_id, keep..., term, tfidf)`` with L2-normalised weights.

    Terms are looked up, weighted and normalised in the row; only then is the vector, stored once, taken apart. Nothing
    is exchanged: the names of the terms are at most ``MAX_FEATURES`` rows, hence the broadcast.
    """
    model = tfidf_model(kind, vocab.select("term", idf().alias("idf")), "text", "features")
    path = scratch_path(df.sparkSession, f"tfidf-{kind}")
    bare = F.col("features").alias("features", metadata={})
    model.transform(df.select("row_id", *keep, "text")).select("row_id", *keep, bare).write.parquet(path)
    rows = feature_rows(df.sparkSession, path, _counter(model).vocabulary, "row_id", *keep)
    return rows.withColumnsRenamed({"feature": "term", "value": "tfidf"})


class TfidfEstimator(Estimator):
    """Fits the vocabulary on the rows it is given; the model is made of stages that save, so it
    saves, loads and streams like any pipeline."""

    def __init__(self, kind: str, inputCol: str, outputCol: str, max_features: int = MAX_FEATURES):
        super().__init__()
        self.kind, self.inputCol, self.outputCol = kind, inputCol, outputCol
        self.max_features = max_features

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        train = dataset.select(F.col(self.inputCol).alias("text"))
        fitted = vocabulary(train, self.kind, self.max_features).withColumn("idf", idf())
        return tfidf_model(self.kind, fitted, self.inputCol, self.outputCol)


def scaling_bounds(train: DataFrame, names) -> DataFrame:
    """One row ``(lo_<name>, hi_<name>, ...)``, from one aggregate over the training rows."""
    return train.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in names],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in names],
    )


def scaled_sql(col: str, low: str, high: str) -> str:
    """(x - min) / (max - min); a constant column keeps x - min."""
    return f"coalesce(({col} - {low}) / nullif({high} - {low}, 0.0D), {col} - {low})"


def scale_signals(df: DataFrame, train: DataFrame, names, *keep: str) -> DataFrame:
    """Min-max scaling with the bounds of ``train``; other rows may leave [0, 1]."""
    bounds = scaling_bounds(train, names)
    # The bounds travel as one struct from a scalar subquery, so no join is needed.
    packed = bounds.select(F.struct(*bounds.columns).alias("b")).scalar()
    with_bounds = df.select(*keep, *names).withColumn("_b", packed)
    return with_bounds.select(
        *keep,
        *[F.expr(scaled_sql(c, f"_b.lo_{c}", f"_b.hi_{c}")).alias(c) for c in names],
    )


class SignalScaler(Estimator):
    """Scaled signal columns gathered into one vector."""

    def __init__(self, names, outputCol: str, prefix: str = "sig_"):
        super().__init__()
        self.names, self.outputCol, self.prefix = list(names), outputCol, prefix

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        cols = [self.prefix + n for n in self.names]
        b = scaling_bounds(dataset, cols).first()
        scaled = ", ".join(
            scaled_sql(c, f"{b['lo_' + c]!r}D", f"{b['hi_' + c]!r}D") + f" AS scaled_{c}" for c in cols
        )
        return PipelineModel(
            [
                SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
                VectorAssembler(inputCols=[f"scaled_{c}" for c in cols], outputCol=self.outputCol),
            ]
        )


# What the ablations do to the text the vectorisers see; the signals read the untouched text.
TEXT_VIEWS = {
    "as_is": "coalesce(text, '')",
    "years_stripped": f"regexp_replace(coalesce(text, ''), {regex(YEAR_PATTERN)}, ' ')",
    "confounds_stripped": (
        f"regexp_replace(regexp_replace(coalesce(text, ''), {regex(YEAR_PATTERN)}, ' '), "
        f"{regex(SOURCE_PATTERN)}, ' ')"
    ),
}


@dataclass(frozen=True)
class FeatureSpec:
    """Which blocks make up the feature vector, in the order word, char, signals."""

    word: bool = True
    char: bool = False
    signals: int = 0
    view: str = "as_is"
    ratio_from_text: bool = False
    max_features: int = MAX_FEATURES

    @property
    def signal_names(self) -> list[str]:
        return {0: [], 8: SIGNALS_8, 13: SIGNALS_13}[self.signals]


class MessageFeatures(Estimator):
    """The whole feature pipeline: text to one ``features`` vector, row by row, fitted on the
    training rows only."""

    def __init__(self, spec: FeatureSpec):
        super().__init__()
        self.spec = spec

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        spec = self.spec
        view = SQLTransformer(
            statement=f"SELECT *, {TEXT_VIEWS[spec.view]} AS _model_text FROM __THIS__"
        )
        stages, blocks = [view], []
        seen = view.transform(dataset)
        for kind in ("word", "char"):
            if getattr(spec, kind):
                fitted = TfidfEstimator(kind, "_model_text", f"_{kind}", spec.max_features).fit(seen)
                stages += fitted.stages
                blocks.append(f"_{kind}")
        if spec.signals:
            ratio = None if spec.ratio_from_text else "capital_ratio"
            signals = signal_transformer("text", prefix="sig_", ratio=ratio)
            scaler = SignalScaler(spec.signal_names, "_signals").fit(signals.transform(dataset))
            stages += [signals, *scaler.stages]
            blocks.append("_signals")
        stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
        return PipelineModel(stages)


def feature_names(model: PipelineModel) -> list[str]:
    """``word:``, ``char:`` and ``custom:`` names in vector order."""
    names = []
    for stage in model.stages:
        if isinstance(stage, COUNTERS):
            kind = stage.getOutputCol().split("_")[1]
            names += [f"{kind}:{t}" for t in stage.vocabulary]
        elif isinstance(stage, VectorAssembler) and stage.getOutputCol() == "_signals":
            names += ["custom:" + c.removeprefix("scaled_sig_") for c in stage.getInputCols()]
    return names


def weighing(model: PipelineModel) -> Weighing | None:
    """The weights of the terms, which come first in a vector, and which of its blocks each is in; None without terms."""
    parts = [stage.getScalingVec().toArray() for stage in model.stages if isinstance(stage, ElementwiseProduct)]
    return Weighing(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])) if parts else None


def transform_features(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, "features")
