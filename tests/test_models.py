import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from msgsieve.operators import bayes as B, explain as L, models as M, ranks as R, vectorize as V
from msgsieve.operators.textmodel import TextModel
from msgsieve.plans import stages as S
from msgsieve.schema import LABELS
from msgsieve.sources import sinks
from msgsieve.streaming.scoring import score_messages, score_stream

WORDS = {
    "ham": "lunch meeting tomorrow family dinner",
    "phishing": "verify account password bank login",
    "spam": "prize winner free offer cash",
}


@pytest.fixture(scope="module")
def corpus(spark):
    """Separable messages: each class has its own words plus shared ones."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        label = LABELS[(i % 6 > 2) + (i % 6 > 4)]
        words = list(rng.choice(WORDS[label].split(), 4)) + list(rng.choice("note item thing".split(), 3))
        rows.append((i, " ".join(words), label, "sms" if i % 2 else "email", 0.1))
    df = spark.createDataFrame(rows, "row_id long, text string, label string, channel string, capital_ratio double")
    return R.stratified_split(df).persist()


@pytest.fixture(scope="module")
def halves(corpus):
    return corpus.where("split = 'train'"), corpus.where("split = 'test'")


def test_vocabulary_sees_training_rows_only(spark, halves):
    train, test = halves
    spec = V.FeatureSpec(char=True, signals=8)
    names = V.feature_names(V.MessageFeatures(spec).fit(train))
    noisy = train.unionByName(test.limit(0))
    assert names == V.feature_names(V.MessageFeatures(spec).fit(noisy))
    model = V.MessageFeatures(spec).fit(train)
    odd = test.limit(1).withColumn("text", F.lit("zzzz unseen zzzz"))
    row = model.transform(odd).select("features").first()[0]
    assert row.size == len(names) and not np.isnan(row.toArray()).any()
    assert names == sorted(n for n in names if n.startswith("word:")) + sorted(
        n for n in names if n.startswith("char:")
    ) + [f"custom:{n}" for n in spec.signal_names]


def test_constant_signal_scales_to_zero_and_test_may_leave_the_range(spark):
    train = spark.createDataFrame([(1, 3.0, 0.0), (2, 3.0, 2.0)], "row_id int, a double, b double")
    test = spark.createDataFrame([(3, 3.0, 5.0)], "row_id int, a double, b double")
    row = V.scale_signals(test, train, ["a", "b"], "row_id").first()
    assert (row.a, row.b) == (0.0, 2.5)


def test_class_weights_sum_to_rows(halves):
    train, _ = halves
    rows = B.class_weights(train).collect()
    assert sum(r.n * r.weight for r in rows) == pytest.approx(train.count())
    counts = M.label_counts(train)
    assert {r.label: r.weight for r in rows} == pytest.approx(M.balanced_weights(counts))


@pytest.mark.parametrize("complement", [False, True])
def test_closed_form_bayes_agrees_with_the_library(halves, complement):
    train, test = halves
    vocab = V.vocabulary(train, "word").persist()
    rows = V.tfidf_rows(train, vocab, "word", "label")
    weights = B.term_weights(rows, vocab, complement)
    priors = None if complement else B.log_priors(train)
    mine = B.scores(test.select("row_id", "label"), V.tfidf_rows(test, vocab, "word"), weights, priors)
    pipeline = V.MessageFeatures(V.FeatureSpec()).fit(train)
    vectors = M.training_vectors(pipeline, train)
    theirs = M.fit_bayes(vectors, complement).predict(pipeline.transform(test))
    a = {r.row_id: r.prediction for r in mine.collect()}
    b = {r.row_id: r.prediction for r in theirs.select("row_id", "prediction").collect()}
    assert a == b and len(a) == test.count()


@pytest.mark.parametrize("solver", ["LogisticRegression", "LogisticRegression_balanced", "LinearSVC", "LinearSVC_balanced"])
def test_solvers_beat_the_majority_class(halves, solver):
    train, test = halves
    pipeline = V.MessageFeatures(V.FeatureSpec()).fit(train)
    model = M.SOLVERS[solver](M.training_vectors(pipeline, train))
    predicted = model.predict(pipeline.transform(test))
    right = predicted.where("label = prediction").count()
    assert right == test.count()
    if model.kind == "lr":
        p = M.with_probabilities(predicted).select(*[f"p_{c}" for c in LABELS]).toPandas()
        assert np.allclose(p.sum(axis=1), 1.0)


def test_logistic_reaches_the_stated_objective(halves):
    """The solution against plain gradient descent on sum(loss)/n + |w|^2 / (2 C n)."""
    train, _ = halves
    pipeline = V.MessageFeatures(V.FeatureSpec(max_features=12)).fit(train)
    vectors = M.training_vectors(pipeline, train)
    model = M.fit_logistic(vectors, c=1.0).model
    data = vectors.vectors.select("label", "features").collect()
    x = np.array([r.features.toArray() for r in data])
    y = np.array([LABELS.index(r.label) for r in data])
    w, b, n = np.zeros((3, x.shape[1])), np.zeros(3), len(y)
    for _ in range(20000):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = p - np.eye(3)[y]
        w -= 0.5 * (g.T @ x / n + w / n)
        b -= 0.5 * g.mean(axis=0)
    assert np.allclose(model.coefficientMatrix.toArray(), w, atol=0.005)


def test_a_failing_experiment_becomes_an_error_row(halves):
    train, test = halves
    plan = [("good", V.FeatureSpec(), ["ComplementNB"]), ("bad", V.FeatureSpec(), ["NoSuchModel"])]
    rows = M.run_experiments(train, test, plan).collect()
    assert {r.metric for r in rows if r.experiment == "bad"} == {"error"}
    good = {(r.slice, r.metric): r.value for r in rows if r.experiment == "good"}
    assert good[("all", "macro_f1")] == 1.0


def test_an_ablation_with_a_failed_variant_is_no_result(halves):
    train, test = halves

    def predict(spec, solver):
        if spec == M.FULL_13:
            raise ValueError("no such signal")
        return test.select("label", "channel", F.col("label").alias("prediction"))

    with pytest.raises(RuntimeError, match="url_signals/B_all_13 failed: ValueError: no such signal"):
        M.ablations(train, test, predict=predict)
    rows = M.ablations(train, test, ("signals", "confounds"), predict).collect()
    assert {r.ablation for r in rows} == {"signals", "confounds"} and all(r.a == r.b == 1.0 for r in rows if r.metric == "macro_f1")


def test_finished_experiments_survive_a_killed_run(spark, halves, tmp_path):
    train, test = halves

    class Killed(BaseException):
        pass

    def predict(spec, solver):
        if solver == "second":
            raise Killed
        return test.select("label", "channel", F.col("label").alias("prediction"))

    sink = str(tmp_path / "metrics")
    plan = [("E0", M.WORD, ["first"]), ("E1", M.WORD, ["second"])]
    with pytest.raises(Killed):
        M.run_experiments(train, test, plan, predict, parallelism=1, sink=sink)
    rows = sinks.read_metrics(spark, sink).where("metric = 'macro_f1' AND slice = 'all'").collect()
    assert [(r.experiment, r.model, r.value) for r in rows] == [("E0", "first", 1.0)]


def test_a_killed_run_goes_on(spark, halves, tmp_path):
    train, test = halves
    fitted, stop = [], [True]

    class Killed(BaseException):
        pass

    def predict(spec, solver):
        if stop and len(fitted) == 3:
            raise Killed
        fitted.append(solver)
        if fitted.count("second") == 1 and solver == "second":
            raise ValueError("fails the first time")
        return test.select("label", "channel", F.col("label").alias("prediction"))

    sink = str(tmp_path / "metrics")
    plan = [("E0", M.WORD, ["first", "second"]), ("E1", M.WORD, ["third", "fourth", "fifth"]), ("E2", M.FULL_8, ["third"])]
    with pytest.raises(Killed):
        M.run_experiments(train, test, plan, predict, parallelism=1, sink=sink)
    assert fitted == ["first", "second", "third"]
    stop.clear()
    rows = M.run_experiments(train, test, plan, predict, parallelism=1, sink=sink).collect()
    assert fitted[3:] == ["second", "fourth", "fifth", "third"]  # the failed one and those not reached
    assert len({(r.experiment, r.model) for r in rows}) == 6 and not any(r.error for r in rows)
    again = M.run_experiments(train, test, plan, predict, parallelism=1, sink=sink)
    assert len(fitted) == 7 and again.count() == len(rows)
    # Other data: nothing is taken over.
    M.run_experiments(train.limit(3), test, plan[:1], predict, parallelism=1, sink=sink)
    assert len(fitted) == 9


def test_every_model_saves_loads_and_streams(spark, tmp_path):
    for name, (spec, model) in S.every_model(spark, SF_SMALL).items():
        path = str(tmp_path / name)
        whole = M.as_pipeline(S.feature_model(spark, SF_SMALL, spec), model)
        sinks.save_model(whole, path)
        loaded = sinks.load_model(path)
        rows = S.test_rows(spark, SF_SMALL)
        key = lambda df: sorted((r.row_id, r.prediction) for r in df.select("row_id", "prediction").collect())
        want = key(model.predict(S.features(spark, SF_SMALL, spec).where("split = 'test'")))
        assert key(loaded.transform(rows)) == key(whole.transform(rows)) == want, name
        if name.endswith("NB"):
            assert want == key(S.bayes_scores(spark, SF_SMALL, name == "ComplementNB"))
        stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
        scored = loaded.transform(stream.where("split = 'test'")).select("row_id", "prediction")
        query = scored.writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-ck")
        assert query.trigger(availableNow=True).start().awaitTermination(120)
        assert key(spark.read.parquet(f"{path}-out")) == want, name


def test_cross_validation(spark, halves):
    train, _ = halves
    scores = M.cross_validate(R.kfold(train), V.FeatureSpec(), grid=[0.1, 10.0], folds=2).persist()
    assert scores.count() == 4
    best = M.cv_summary(scores).first()
    mine = [r.macro_f1 for r in scores.collect() if r.c == best.c]
    assert best.mean_macro_f1 == pytest.approx(np.mean(mine))
    assert best.std_macro_f1 == pytest.approx(np.std(mine))


@pytest.fixture(scope="module")
def full_model(halves):
    train, _ = halves
    pipeline = V.MessageFeatures(M.FULL_8).fit(train)
    classifier = M.fit_logistic(M.training_vectors(pipeline, train), balanced=True)
    return PipelineModel([pipeline, classifier.model, M.label_names()])


def test_reloaded_model_scores_alike_and_streams(spark, halves, full_model, tmp_path):
    _, test = halves
    full_model.save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    raw = test.select("row_id", F.upper("text").alias("text"))
    batch = score_messages(raw, full_model, "row_id")
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    query = score_stream(
        stream, loaded, str(tmp_path / "out"), str(tmp_path / "ck"), "row_id"
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == test.count()
    key = lambda df: sorted((r.row_id, r.prediction, round(r.p_ham, 9)) for r in df.collect())
    assert key(got) == key(batch)
    odd = spark.createDataFrame([(1, "yes"), (2, "x" * 20_000), (3, None)], "row_id long, text string")
    assert {r.row_id for r in score_messages(odd, loaded, "row_id").collect()} == {1, 2, 3}


def test_explanations(spark, halves, full_model):
    _, test = halves
    some = test.where("channel = 'sms'").orderBy("row_id").limit(4)
    pipeline, classifier, _ = full_model.stages
    model = TextModel.of(pipeline, classifier, M.FULL_8)
    rows = L.explain(some, model, ["row_id"], num_features=3, n_samples=300).collect()
    texts = {r.row_id: r for r in some.collect()}
    assert {r.row_id for r in rows} == set(texts)
    for r in rows:
        message = texts[r.row_id]
        assert r.token in message.text.split()
        assert r["class"] == message.label
        if r["rank"] == 1:
            assert r.weight > 0 and r.token in WORDS[message.label].split()
    again = L.explain(some.repartition(3), model, ["row_id"], num_features=3, n_samples=300).collect()
    key = lambda rs: sorted((r.row_id, r["rank"], r.token, round(r.weight, 6)) for r in rs)
    assert key(rows) == key(again)
    scored = M.with_probabilities(full_model.transform(some)).select("row_id", "text", "prediction", "p_ham")
    told = L.score_with_reasons(scored, model, ["row_id"], n_samples=100).collect()
    assert len(told) == 4
    for r in told:
        assert r.prediction == texts[r.row_id].label and len(r.reasons.split(", ")) >= 3


def test_ridge_spaces_agree():
    rng = np.random.default_rng(1)
    x, y, w = rng.random((6, 9)), rng.random(6), rng.random(6)
    wide = L._ridge(x, y, w, 0.3)
    c = x - (w @ x) / w.sum()
    direct = np.linalg.solve((c.T * w) @ c + 0.3 * np.eye(9), (c.T * w) @ (y - (w @ y) / w.sum()))
    assert np.allclose(wide, direct)
    assert L.local_weights(np.ones(1), np.ones((1, 0), bool), [], 3, 25.0) == []


def test_signal_weights_and_audit(spark):
    w = spark.createDataFrame(
        [("phishing", "custom:has_url", 0.5), ("phishing", "custom:url_count", -0.9), ("phishing", "word:x", 2.0), ("ham", "word:x", 1.0)],
        "class string, feature string, weight double",
    )
    assert [(r.signal, r.direction) for r in L.signal_weights(w).collect()] == [
        ("url_count", "away from phishing"), ("has_url", "toward phishing"),
    ]
    after = w.where("feature <> 'word:x'").withColumn("weight", F.col("weight") * 2)
    status = {r.feature: r.status for r in L.artefact_audit(w, after, k=2).collect()}
    assert status == {"word:x": "gone", "custom:has_url": "kept", "custom:url_count": "new"}


def test_stages_are_written_once(spark):
    a, b = S.prepared(spark, SF_SMALL), S.prepared(spark, SF_SMALL)
    assert a.inputFiles() == b.inputFiles()
    assert a.count() > 0
