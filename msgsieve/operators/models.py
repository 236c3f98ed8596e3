"""Training and applying linear models and naive Bayes on a ``features`` vector column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.operators import evaluate as E, solver as Z
from msgsieve.operators.vectorize import FeatureSpec, MessageFeatures, weighing
from msgsieve.schema import FOLDS, LABELS
from msgsieve.session import scratch_path
from msgsieve.sources.sinks import STORED_VECTOR, append_metrics, read_metrics

# Independent fits that run side by side.
PARALLELISM = 6


def indexer() -> StringIndexerModel:
    """Label to class index by the closed domain, alphabetical; no pass over the data."""
    return StringIndexerModel.from_labels(LABELS, inputCol="label", outputCol="label_index")


def label_names(prediction_col: str = "label_prediction", out: str = "prediction") -> IndexToString:
    return IndexToString(inputCol=prediction_col, outputCol=out, labels=LABELS)


def label_counts(df: DataFrame) -> dict[str, int]:
    """At most one row per label comes to the driver."""
    return {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
    n, k = sum(counts.values()), len(counts)
    return {label: n / (k * c) for label, c in counts.items()}


def class_index(label: str = "label") -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in LABELS]), F.col(label)) - 1


class Training:
    """Stored training rows ``label, features``: as vectors for stock estimators, and as plain columns, dealt evenly
    and persisted at first use, for the solver."""

    def __init__(self, stored: DataFrame, path: str, condition: Column | None = None, weighing: Z.Weighing | None = None):
        self._path, self._condition = path, condition
        self.weighings = {0: weighing} if weighing is not None else {}
        self._spark, self._rows, self._lock = stored.sparkSession, None, Lock()
        self.vectors = stored if condition is None else stored.where(condition)
        counted = self._stored().groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(_vector_size()).alias("size")).collect()
        self.counts = {r["label"]: r["n"] for r in counted}
        self.size = max((r["size"] for r in counted), default=0)

    def _stored(self) -> DataFrame:
        plain = [f"`{f.name}` {f.dataType.simpleString()}" for f in self._spark.read.parquet(self._path).schema if f.name != "features"]
        rows = self._spark.read.schema(", ".join([*plain, f"features {STORED_VECTOR}"])).parquet(self._path)
        return rows if self._condition is None else rows.where(self._condition)

    @property
    def rows(self) -> DataFrame:
        with self._lock:
            if self._rows is None:
                self._rows = Z.even_rows(self._stored().select(F.lit(0).alias("space"), class_index().cast("int").alias("y"), "features"), self.weighings)
        return self._rows

    def solve(self, fits: list[Z.Fit]) -> list[np.ndarray]:
        return Z.fit_all(self.rows, fits, weighings=self.weighings)

    def unpersist(self) -> None:
        if self._rows is not None:
            self._rows.unpersist()


def _vector_size() -> Column:
    return F.coalesce("features.size", F.size("features.values"))


def training_vectors(pipeline, train: DataFrame) -> Training:
    """The vectors of ``train``, written once."""
    path = scratch_path(train.sparkSession, "vectors")
    # The vectoriser names every feature in the column's metadata, which each task would carry.
    bare = F.col("features").alias("features", metadata={})
    pipeline.transform(train).select("label", bare).write.parquet(path)
    return Training(train.sparkSession.read.parquet(path), path, weighing=weighing(pipeline))


class Fitted:
    """A fitted model with one interface: ``predict(df)`` adds a ``prediction`` label."""

    def __init__(self, kind: str, model):
        self.kind, self.model = kind, model

    def predict(self, df: DataFrame) -> DataFrame:
        if self.kind == "svc":
            return self._predict_margins(df)
        out = self.model.transform(df).drop("rawPrediction")
        return label_names().transform(out).drop("label_prediction")

    def _predict_margins(self, df: DataFrame) -> DataFrame:
        out = df
        for label, model in self.model.items():
            # Several threads may predict with this model: the columns are set on a copy.
            own = model.copy().setRawPredictionCol(f"_raw_{label}").setPredictionCol(f"_pred_{label}")
            out = own.transform(out)
        out = LargestMargin(list(self.model)).transform(out)
        return out.select(*df.columns, *[f"{c}_margin" for c in self.model], "prediction")


def logistic_model(w: np.ndarray) -> LogisticRegressionModel:
    """Coefficients ``(classes, features + 1)`` as a stock model: it predicts, saves, loads and streams."""
    context = _context()
    matrix = DenseMatrix(w.shape[0], w.shape[1] - 1, w[:, :-1].ravel(order="F"))
    parts = _py2java(context, matrix), _py2java(context, Vectors.dense(w[:, -1]))
    java = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", LogisticRegressionModel._randomUID(), *parts, w.shape[0], True
    )
    return LogisticRegressionModel(java).setPredictionCol("label_prediction")


def margin_model(w: np.ndarray) -> LinearSVCModel:
    """Coefficients ``(features + 1,)`` of one class against the rest as a stock model."""
    java = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.LinearSVCModel", LinearSVCModel._randomUID(), _py2java(_context(), Vectors.dense(w[:-1])), float(w[-1])
    )
    return LinearSVCModel(java)


def _context():
    from pyspark import SparkContext

    return SparkContext._active_spark_context


def _weights(counts: dict[str, int], balanced: bool, only: str | None = None) -> tuple[float, ...]:
    """Weights by class index; with ``only``, other classes weigh 1."""
    told = balanced_weights(counts) if balanced else {}
    return tuple(told.get(c, 1.0) if only is None or c == only else 1.0 for c in LABELS)


def logistic_fit(counts: dict[str, int], size: int, c: float = 1.0, balanced: bool = False, space: int = 0) -> Z.Fit:
    return Z.Fit("logistic", size, _weights(counts, balanced), c, space=space)


def fit_logistic(data: Training, c: float = 1.0, balanced: bool = False) -> Fitted:
    """Multinomial logistic regression: ``|w|**2 / 2 + c * sum(weight * loss)``, no standardisation, free intercepts."""
    return _logistic_of(data.solve([logistic_fit(data.counts, data.size, c, balanced)]))


def fit_svc(data: Training, c: float = 1.0, balanced: bool = False) -> Fitted:
    """One-vs-rest linear SVMs with the squared hinge; balanced weights apply to the positive side of each problem.

    The three problems share their passes over the rows.
    """
    return _svc_of(data, data.solve(_svc_fits(data, c, balanced)))


def _logistic_of(found: list[np.ndarray]) -> Fitted:
    return Fitted("lr", logistic_model(found[0]))


def _svc_fits(data: Training, c: float, balanced: bool) -> list[Z.Fit]:
    weights = {label: _weights(data.counts, balanced, label) for label in data.counts}
    return [Z.Fit("squared_hinge", data.size, weights[label], c, LABELS.index(label)) for label in sorted(data.counts)]


def _svc_of(data: Training, found: list[np.ndarray]) -> Fitted:
    return Fitted("svc", {label: margin_model(w[0]) for label, w in zip(sorted(data.counts), found)})


def fit_together(data: Training, solvers: list[str], c: float = 1.0) -> dict[str, Fitted]:
    """The named logistic models and SVMs from one sequence of passes."""
    fits = {
        name: _svc_fits(data, c, name.endswith("balanced")) if name.startswith("LinearSVC") else [logistic_fit(data.counts, data.size, c, name.endswith("balanced"))]
        for name in solvers
    }
    found = iter(data.solve([fit for own in fits.values() for fit in own]))
    parts = {name: [next(found) for _ in own] for name, own in fits.items()}
    return {name: _svc_of(data, w) if name.startswith("LinearSVC") else _logistic_of(w) for name, w in parts.items()}


def fit_bayes(data: Training, complement: bool = False) -> Fitted:
    solver = NaiveBayes(
        labelCol="label_index",
        predictionCol="label_prediction",
        modelType="complement" if complement else "multinomial",
    )
    return Fitted("nb", solver.fit(indexer().transform(data.vectors)))


def bayes_model(weights: dict[str, list[float]], terms: list[str], priors: list[float] | None = None) -> Fitted:
    """A closed-form naive Bayes model as a stock one: ``weights`` has what one unit of a term adds to each class's score.

    Its scores are the sums of these and its prediction the largest, whichever way the weights were made.
    """
    matrix = np.array([weights[t] for t in terms], float).T
    start = np.zeros(len(LABELS)) if priors is None else np.array(priors, float)
    context = _context()
    parts = [_py2java(context, x) for x in (Vectors.dense(start), DenseMatrix(*matrix.shape, matrix.ravel(order="F")), DenseMatrix(0, 0, []))]
    java = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.NaiveBayesModel", NaiveBayesModel._randomUID(), *parts)
    return Fitted("nb", NaiveBayesModel(java).setPredictionCol("label_prediction"))


class LargestMargin(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``prediction``: the first label of the largest margin, and ``<label>_margin``, from one raw column a label."""

    labels = Param(Params._dummy(), "labels", "labels that have a margin, in order", TypeConverters.toListString)

    def __init__(self, labels: list[str] | None = None):
        super().__init__()
        if labels is not None:
            self._set(labels=list(labels))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = self.getOrDefault(self.labels)
        out = dataset.withColumns({f"{c}_margin": vector_to_array(f"_raw_{c}")[1] for c in labels})
        best = F.array_max(F.array(*[f"{c}_margin" for c in labels]))
        out = out.withColumn("prediction", F.coalesce(*[F.when(F.col(f"{c}_margin") == best, c) for c in labels]))
        return out.drop(*[f"_{kind}_{c}" for kind in ("raw", "pred") for c in labels])


def as_pipeline(features: PipelineModel, fitted: Fitted) -> PipelineModel:
    """Text to ``prediction`` in one model that saves, loads and streams, whatever was fitted."""
    return PipelineModel([*features.stages, *classifier(fitted).stages])


def classifier(fitted: Fitted) -> PipelineModel:
    """The same from the ``features`` column on."""
    if fitted.kind != "svc":
        return PipelineModel([fitted.model, label_names()])
    sides = [m.copy().setRawPredictionCol(f"_raw_{c}").setPredictionCol(f"_pred_{c}") for c, m in fitted.model.items()]
    return PipelineModel([*sides, LargestMargin(list(fitted.model))])


SOLVERS = {
    "MultinomialNB": lambda df: fit_bayes(df),
    "ComplementNB": lambda df: fit_bayes(df, complement=True),
    "LogisticRegression": lambda df: fit_logistic(df),
    "LogisticRegression_balanced": lambda df: fit_logistic(df, balanced=True),
    "LinearSVC": lambda df: fit_svc(df),
    "LinearSVC_balanced": lambda df: fit_svc(df, balanced=True),
}


def with_probabilities(predicted: DataFrame) -> DataFrame:
    """One probability column per label instead of the vector."""
    p = vector_to_array("probability")
    return predicted.withColumns({f"p_{c}": p[i] for i, c in enumerate(LABELS)}).drop("probability")


def coefficients(model: Fitted, names: list[str], df: DataFrame) -> DataFrame:
    """``(class, feature, weight)`` of a logistic model: classes x features rows, from the model."""
    matrix = model.model.coefficientMatrix.toArray()
    rows = [
        (LABELS[i], name, float(w)) for i in range(matrix.shape[0]) for name, w in zip(names, matrix[i])
    ]
    return df.sparkSession.createDataFrame(rows, "class string, feature string, weight double")


def features_of(train: DataFrame, spec: FeatureSpec):
    return MessageFeatures(spec).fit(train)


def run_experiments(
    train: DataFrame,
    test: DataFrame,
    plan: list[tuple[str, FeatureSpec, list[str]]],
    predict: Callable[[FeatureSpec, str], DataFrame] | None = None,
    parallelism: int = PARALLELISM,
    sink: str | None = None,
) -> DataFrame:
    """Tidy metric rows of every (experiment, model) in ``plan``.

    With ``sink``, the rows of each pair are appended there as soon as it is done, under a key of data, feature spec and
    model. A run on a sink that has rows takes over what stands there under its keys and fits only the rest, so a
    killed run goes on where it was; failed pairs are tried again.

    Experiments are isolated: one that fails becomes an ``error`` row and the rest go on. Equal
    (spec, model) pairs are fitted once, and models on the same spec share its vectors. ``predict``
    may supply stored predictions of the test rows instead.
    """
    spark = train.sparkSession
    shared, lock = {}, Lock()

    def vectors_of(spec):
        with lock:
            gate = shared.setdefault(spec, {"lock": Lock()})
        with gate["lock"]:
            if "vectors" not in gate:
                gate["pipeline"] = features_of(train, spec)
                gate["vectors"] = training_vectors(gate["pipeline"], train)
        return gate["pipeline"], gate["vectors"]

    def fit_and_predict(spec, solver):
        pipeline, vectors = vectors_of(spec)
        model = SOLVERS[solver](vectors)
        return model.predict(pipeline.transform(test).select("label", "channel", "features"))

    keys, kept = {}, None
    if sink:
        data = data_digest(train) + data_digest(test)
        keys = {(name, m): run_key(data, name, spec, m) for name, spec, models in plan for m in models}
        kept = _kept_runs(spark, sink, keys)
    done = {(r["experiment"], r["model"]) for r in kept.select("experiment", "model").distinct().collect()} if kept is not None else set()
    todo = [(name, spec, [m for m in models if (name, m) not in done]) for name, spec, models in plan]
    pairs = list(dict.fromkeys((spec, m) for _, spec, models in todo for m in models))

    def runs_of(pair, outcome):
        return [(name, m, outcome) for name, spec, models in todo for m in models if (spec, m) == pair]

    def one(pair):
        try:
            # Three labels x three predictions x two channels.
            outcome = E.counts((predict or fit_and_predict)(*pair)).collect(), None
        except Exception as error:  # noqa: BLE001 - the run must go on
            outcome = [], f"{type(error).__name__}: {error}"
        if sink:
            with lock:
                append_metrics(_run_rows(spark, runs_of(pair, outcome)), sink, keys)
        return outcome

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            outcomes = list(pool.map(one, pairs))
    finally:
        for gate in shared.values():
            if "vectors" in gate:
                gate["vectors"].unpersist()
    new = _run_rows(spark, [run for pair, outcome in zip(pairs, outcomes) for run in runs_of(pair, outcome)])
    return new if kept is None else new.unionByName(kept.select(*new.columns))


def data_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order."""
    each = F.xxhash64(*sorted(c for c in df.columns)).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("s")).first()
    return f"{sorted(df.columns)}:{r['n']}:{r['s']};"


def run_key(data: str, experiment: str, spec: FeatureSpec, model: str) -> str:
    return hashlib.sha256(f"{data}{experiment}|{spec!r}|{model}".encode()).hexdigest()


def _kept_runs(spark, sink: str, keys: dict[tuple[str, str], str]) -> DataFrame | None:
    """Rows of the sink that belong to this plan; None if nothing was written yet."""
    try:
        stored = read_metrics(spark, sink)
    except AnalysisException:
        return None
    wanted = spark.createDataFrame([(*pair, key) for pair, key in keys.items()], "experiment string, model string, run_key string")
    mine = stored.join(F.broadcast(wanted), ["experiment", "model", "run_key"], "left_semi")  # as many rows as the plan has
    path = scratch_path(spark, "kept-runs")
    mine.where(F.col("metric") != "error").drop("run_key").write.parquet(path)
    return spark.read.parquet(path)


def _run_rows(spark, runs: list[tuple]) -> DataFrame:
    """Metric rows of ``(experiment, model, (count cells, error))``; a failed run is one ``error`` row."""
    cells = spark.createDataFrame(
        [(name, m, *row) for name, m, (rows, _) in runs for row in rows],
        "experiment string, model string, channel string, label string, prediction string, n long",
    )
    rows = E.metric_rows(cells, "experiment", "model").withColumn("error", F.lit(None).cast("string"))
    failed = spark.createDataFrame(
        [(name, m, error) for name, m, (_, error) in runs if error],
        "experiment string, model string, error string",
    ).select(
        "experiment",
        "model",
        F.lit(E.ALL).alias("slice"),
        F.lit("error").alias("metric"),
        F.lit(None).cast("double").alias("value"),
        "error",
    )
    return rows.unionByName(failed)


WORD = FeatureSpec()
#: The tuning run sees text only, so its ratio is that of the cleaned text.
TUNED = FeatureSpec(char=True, signals=8, ratio_from_text=True)
RUN_2 = [
    ("E0_baseline_word", WORD, ["LogisticRegression_balanced", "LinearSVC_balanced"]),
    (
        "E1_years_stripped",
        FeatureSpec(view="years_stripped"),
        ["LogisticRegression_balanced", "LinearSVC_balanced"],
    ),
    (
        "E2_char_ngrams",
        FeatureSpec(word=False, char=True),
        ["LogisticRegression_balanced", "LinearSVC_balanced"],
    ),
    (
        "E3_word_plus_char",
        FeatureSpec(char=True),
        ["LogisticRegression_balanced", "LinearSVC_balanced"],
    ),
    (
        "E4_complement_nb",
        WORD,
        ["LogisticRegression_balanced", "LinearSVC_balanced", "ComplementNB"],
    ),
]
FULL_8 = FeatureSpec(char=True, signals=8)
FULL_13 = FeatureSpec(char=True, signals=13)
ABLATIONS = {
    "signals": (("A_tfidf_only", FeatureSpec(char=True)), ("B_tfidf_plus_custom", FULL_8)),
    "confounds": (
        ("A_with_confounds", FULL_8),
        ("B_confounds_stripped", FeatureSpec(char=True, signals=8, view="confounds_stripped")),
    ),
    "url_signals": (("A_original_8", FULL_8), ("B_all_13", FULL_13)),
}


def ablations(
    train: DataFrame, test: DataFrame, names=tuple(ABLATIONS), predict=None, model="LogisticRegression_balanced"
) -> DataFrame:
    """Pairs of variants side by side: ``(ablation, slice, metric, a, b, difference)``.

    A comparison that lacks a variant is none: if one fails, an error that names it is raised once all have been tried.
    """
    plan = [(f"{n}/{name}", spec, [model]) for n in names for name, spec in ABLATIONS[n]]
    metrics = run_experiments(train, test, plan, predict)
    # At most one row for each of a few variants.
    failed = metrics.where(F.col("error").isNotNull()).select("experiment", "error").orderBy("experiment").collect()
    if failed:
        raise RuntimeError("; ".join(f"{r['experiment']} failed: {r['error']}" for r in failed))
    split = F.split("experiment", "/")
    tidy = metrics.withColumn("ablation", split[0]).withColumn(
        "experiment", F.lower(F.substring(split[1], 1, 1))
    )
    return E.side_by_side(tidy, "a", "b", "ablation")


# The grid of the tuning run.
GRID_C = [0.1, 1.0, 10.0]


def cross_validate(
    df: DataFrame, spec: FeatureSpec, grid=GRID_C, folds: int = FOLDS, parallelism: int = PARALLELISM
) -> DataFrame:
    """``(c, fold, macro_f1)`` of balanced logistic regression; ``df`` has a ``fold`` column.

    Vectorisers and scaler are refitted inside each fold, on its training rows only, so each fold has a feature
    space of its own. All settings of all folds are fitted together: a pass over the training rows of all folds adds to
    the sums of every (fold, c). All held-out rows are scored in one more pass.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "folds")
    df.write.parquet(f"{path}/messages")
    df = spark.read.parquet(f"{path}/messages")
    cells = {(r["fold"], r["label"]): r["n"] for r in df.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = {k: {c: sum(n for (f, x), n in cells.items() if x == c and f != k) for c in LABELS} for k in range(folds)}

    def prepare(fold):
        pipeline = features_of(df.where(F.col("fold") != fold), spec)
        bare = F.col("features").alias("features", metadata={})
        seen = pipeline.transform(df).select("label", "channel", (F.col("fold") == fold).alias("held_out"), bare)
        seen.write.parquet(f"{path}/vectors/space={fold}")
        return weighing(pipeline)

    with ThreadPoolExecutor(parallelism) as pool:
        weighings = {fold: told for fold, told in enumerate(pool.map(prepare, range(folds))) if told is not None}
    kinds = f"label string, channel string, held_out boolean, features {STORED_VECTOR}, space int"
    stored = spark.read.schema(kinds).parquet(f"{path}/vectors").withColumn("y", class_index().cast("int"))
    sizes = {r["space"]: r["size"] for r in stored.groupBy("space").agg(F.max(_vector_size()).alias("size")).collect()}
    settings = [(fold, float(c)) for fold in range(folds) for c in grid]
    counts = {k: {c: n for c, n in inside[k].items() if n} for k in inside}
    fits = [logistic_fit(counts[fold], sizes.get(fold, 0), c, True, fold) for fold, c in settings]
    rows = Z.even_rows(stored.where("NOT held_out"), weighings)
    found = Z.fit_all(rows, fits, weighings=weighings)
    rows.unpersist()
    told = _predicted(stored.where("held_out"), {n: (f, c, w) for n, ((f, c), w) in enumerate(zip(settings, found))})
    return (
        E.summary(told, "c", "fold").where(F.col("slice") == E.ALL).select("c", "fold", "macro_f1")
    )


def _predicted(stored: DataFrame, models: dict[int, tuple[int, float, np.ndarray]]) -> DataFrame:
    """``c, fold, channel, label, prediction, n`` of the rows of each fold under its models ``(fold, c, coefficients)``."""
    sent = stored.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            space = batch.column(0).to_numpy()
            for fold in np.unique(space).tolist():
                part = batch.filter(pa.array(space == fold))
                sizes = part.column(3).value_lengths().to_numpy()
                block = Z.Rows(np.zeros(part.num_rows, int), part.column(3).flatten().to_numpy(), part.column(4).flatten().to_numpy(), sizes)
                for own, c, w in sent.value.values():
                    if own == fold:
                        best = pa.array(np.array(LABELS)[block.margins(w).argmax(axis=1)], pa.string())
                        n = part.num_rows
                        columns = [pa.array(np.full(n, c)), pa.array(np.full(n, fold, np.int32)), part.column(2), part.column(1), best]
                        yield pa.RecordBatch.from_arrays(columns, ["c", "fold", "channel", "label", "prediction"])

    flat = stored.select("space", "label", "channel", *Z.entries())
    each = flat.mapInArrow(run, "c double, fold int, channel string, label string, prediction string")
    return each.groupBy("c", "fold", "channel", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation per setting, best first."""
    return (
        scores.groupBy("c")
        .agg(
            F.count(F.lit(1)).alias("folds"),
            F.avg("macro_f1").alias("mean_macro_f1"),
            F.stddev_pop("macro_f1").alias("std_macro_f1"),
        )
        .orderBy(F.desc("mean_macro_f1"), "c")
    )


def tune(df: DataFrame, spec: FeatureSpec, grid=GRID_C, folds: int = FOLDS, scores: DataFrame | None = None):
    """Cross-validate, then refit the best setting on all rows: (scores, c, pipeline, model).

    ``scores`` may supply those of an earlier run.
    """
    if scores is None:
        path = scratch_path(df.sparkSession, "scores")
        cross_validate(df, spec, grid, folds).write.parquet(path)
        scores = df.sparkSession.read.parquet(path)
    best = cv_summary(scores).first()["c"]
    pipeline = features_of(df, spec)
    data = training_vectors(pipeline, df)
    model = fit_logistic(data, c=best, balanced=True)
    data.unpersist()
    return scores, best, pipeline, model
