"""Stage tables that many queries start from, each written once per application."""

from __future__ import annotations

from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from msgsieve.operators import bayes as B, clean as C, evaluate as E, models as M, ranks as R, vectorize as V
from msgsieve.operators.textmodel import TextModel
from msgsieve.schema import LABELS, messages
from msgsieve.session import scratch_path, stage
from msgsieve.sources import sinks

_models: dict[tuple, object] = {}


_gates: dict[tuple, Lock] = {}
_lock = Lock()


def _once(spark: SparkSession, scope: str, name, build):
    """``build()`` once per application and input, also when several threads ask for it."""
    key = (spark.sparkContext.applicationId, scope, name)
    with _lock:
        gate = _gates.setdefault(key, Lock())
    with gate:
        if key not in _models:
            _models[key] = build()
    return _models[key]


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, repaired, deduplicated messages with their split."""
    base = stage(spark, sf, "messages", lambda: C.prepare(messages(spark, sf)))
    return stage(spark, sf, "split", lambda: R.stratified_split(base))


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).where(F.col("split") == "train")


def test_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).where(F.col("split") == "test")


def vocab(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return stage(spark, sf, f"vocab_{kind}", lambda: V.vocabulary(train_rows(spark, sf), kind))


def tfidf(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return stage(
        spark,
        sf,
        f"tfidf_{kind}",
        lambda: V.tfidf_rows(
            prepared(spark, sf), vocab(spark, sf, kind), kind, "label", "split"
        ),
    )


def bayes_weights(spark: SparkSession, sf: str, complement: bool) -> DataFrame:
    rows = tfidf(spark, sf, "word").where(F.col("split") == "train")
    return B.term_weights(rows, vocab(spark, sf, "word"), complement)


def bayes_scores(spark: SparkSession, sf: str, complement: bool) -> DataFrame:
    """Test rows with class scores and prediction."""
    rows = test_rows(spark, sf).select("row_id", "channel", "label", "text")
    priors = None if complement else B.log_priors(train_rows(spark, sf))
    weights = bayes_weights(spark, sf, complement)
    terms = tfidf(spark, sf, "word").where(F.col("split") == "test")
    return B.scores(rows, terms, weights, priors)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test predictions of both closed-form models, one row per (model, message)."""

    def build():
        named = lambda name, complement: bayes_scores(spark, sf, complement).withColumn(
            "model", F.lit(name)
        )
        return named("MultinomialNB", False).unionByName(named("ComplementNB", True))

    return stage(spark, sf, "predictions", build)


def feature_model(spark: SparkSession, sf: str, spec: V.FeatureSpec):
    return _once(spark, sf, spec, lambda: M.features_of(train_rows(spark, sf), spec))


def feature_path(spark: SparkSession, sf: str, spec: V.FeatureSpec) -> str:
    """The feature sink: every message's vector, written once per spec."""

    def build():
        path = scratch_path(spark, "features")
        model = feature_model(spark, sf, spec)
        V.transform_features(
            model, prepared(spark, sf), "row_id", "channel", "label", "split"
        ).write.parquet(path)
        return path

    return _once(spark, sf, ("path", spec), build)


def features(spark: SparkSession, sf: str, spec: V.FeatureSpec) -> DataFrame:
    return spark.read.parquet(feature_path(spark, sf, spec))


def fitted(spark: SparkSession, sf: str, spec: V.FeatureSpec, solver: str) -> M.Fitted:
    """A model trained on the stored vectors of the training split."""

    def build():
        path = feature_path(spark, sf, spec)
        weighing = V.weighing(feature_model(spark, sf, spec))
        data = M.Training(spark.read.parquet(path), path, F.col("split") == "train", weighing)
        model = M.SOLVERS[solver](data)
        data.unpersist()
        return model

    return _once(spark, sf, (spec, solver), build)


def fitted_together(spark: SparkSession, sf: str, spec: V.FeatureSpec, solvers: list[str]) -> dict[str, M.Fitted]:
    """Several models of one spec from shared passes over its rows."""

    def build():
        path = feature_path(spark, sf, spec)
        weighing = V.weighing(feature_model(spark, sf, spec))
        data = M.Training(spark.read.parquet(path), path, F.col("split") == "train", weighing)
        models = M.fit_together(data, solvers)
        data.unpersist()
        return models

    models = _once(spark, sf, ("together", spec, tuple(solvers)), build)
    return {name: _once(spark, sf, (spec, name), lambda m=model: m) for name, model in models.items()}


def test_predictions(spark: SparkSession, sf: str, spec: V.FeatureSpec, solver: str) -> DataFrame:
    data = features(spark, sf, spec).where(F.col("split") == "test")
    return fitted(spark, sf, spec, solver).predict(data)


def every_model(spark: SparkSession, sf: str) -> dict[str, tuple[V.FeatureSpec, M.Fitted]]:
    """The five models of the comparison: two closed-form ones and three from the solver, on words."""
    counter = next(s for s in feature_model(spark, sf, M.WORD).stages if hasattr(s, "vocabulary"))
    out = {}
    for name, complement in (("MultinomialNB", False), ("ComplementNB", True)):
        # As many rows as the vocabulary, and one of priors.
        told = {r["term"]: [r[c] for c in LABELS] for r in bayes_weights(spark, sf, complement).collect()}
        priors = None if complement else list(B.log_priors(train_rows(spark, sf)).select(*LABELS).first())
        out[name] = M.WORD, M.bayes_model(told, counter.vocabulary, priors)
    solved = fitted_together(spark, sf, M.WORD, ["LogisticRegression_balanced", "LinearSVC", "LinearSVC_balanced"])
    return out | {name: (M.WORD, model) for name, model in solved.items()}


def reloaded_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(model, row_id, channel, label, prediction)`` of the test rows by the five models, each saved and loaded first."""
    parts, vectors = [], {}
    for name, (spec, model) in every_model(spark, sf).items():
        if spec not in vectors:  # models on the same features share them
            path = scratch_path(spark, "model-features")
            sinks.save_model(feature_model(spark, sf, spec), path)
            out = scratch_path(spark, "vectors")
            V.transform_features(sinks.load_model(path), test_rows(spark, sf), "row_id", "channel", "label").write.parquet(out)
            vectors[spec] = spark.read.parquet(out)
        path = scratch_path(spark, f"model-{name}")
        sinks.save_model(M.classifier(model), path)
        scored = sinks.load_model(path).transform(vectors[spec])
        parts.append(scored.select(F.lit(name).alias("model"), "row_id", "channel", "label", "prediction"))
    return reduce(DataFrame.unionByName, parts)


def weights(spark: SparkSession, sf: str, spec: V.FeatureSpec) -> DataFrame:
    """Coefficients of the balanced logistic model by class and feature name."""
    names = V.feature_names(feature_model(spark, sf, spec))
    model = fitted(spark, sf, spec, "LogisticRegression_balanced")
    return M.coefficients(model, names, features(spark, sf, spec))


def scorer(spark: SparkSession, sf: str, spec: V.FeatureSpec):
    """Text rows to class probabilities with the stored pipeline; other columns ride along.

    The saved capital ratio does not exist for a rewritten text; it counts as 0, as lower-cased text
    has no capitals.
    """
    model = feature_model(spark, sf, spec)
    classifier = fitted(spark, sf, spec, "LogisticRegression_balanced")

    def score(df: DataFrame) -> DataFrame:
        if "capital_ratio" not in df.columns:
            df = df.withColumn("capital_ratio", F.lit(0.0))
        vectors = model.transform(df).select(*[c for c in df.columns if c != "capital_ratio"], "features")
        return M.with_probabilities(classifier.predict(vectors)).drop("features")

    return score


def text_model(spark: SparkSession, sf: str, spec: V.FeatureSpec) -> TextModel:
    """The fitted pipeline and balanced classifier as arrays, to score copies of messages."""
    classifier = fitted(spark, sf, spec, "LogisticRegression_balanced").model
    return _once(spark, sf, ("text", spec), lambda: TextModel.of(feature_model(spark, sf, spec), classifier, spec))


def metrics_sink(spark: SparkSession, sf: str) -> str:
    """Metric rows of the stored predictions, written as the metrics sink and read back."""
    def build():
        path = scratch_path(spark, "metrics")
        rows = E.metric_rows(E.counts(predictions(spark, sf), "model"), "model").select(
            "*", F.lit(None).cast("string").alias("error"), F.lit("naive_bayes").alias("experiment")
        )
        sinks.append_metrics(rows, path)
        return path

    return _once(spark, sf, "metrics", build)
