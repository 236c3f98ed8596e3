import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from msgsieve.operators import evaluate as E, models as M, ranks as R, solver as Z, vectorize as V
from msgsieve.schema import LABELS
from msgsieve.sources.sinks import STORED_VECTOR


def data(seed, n=90, d=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.6)
    x[0] = 0
    y = rng.integers(0, 3, n)
    x[np.arange(n), y] += 0.7
    return x, y


def plain_optimum(x, y, fit):
    """Dense Newton steps, halved until they descend; one output at a time is enough for the hinge."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    n, d = x1.shape
    k = fit.outputs
    kept = np.ones((k, d))
    kept[:, -1] = 0.0 if fit.loss == "logistic" else 1.0
    weight = np.asarray(fit.weights)[y]

    def objective(w):
        z = x1 @ w.T
        if fit.loss == "logistic":
            losses = np.log(np.exp(z).sum(1)) - z[np.arange(n), y]
        else:
            losses = np.maximum(0, 1 - np.where(y == fit.target, 1, -1) * z[:, 0]) ** 2
        return 0.5 * (kept * w * w).sum() + fit.c * (weight * losses).sum()

    def gradient(w):
        z = x1 @ w.T
        if fit.loss == "logistic":
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            slope = p - np.eye(k)[y]
        else:
            side = np.where(y == fit.target, 1, -1)[:, None]
            slope = -2 * side * np.maximum(0, 1 - side * z)
        return kept * w + fit.c * (weight[:, None] * slope).T @ x1

    w = np.zeros((k, d))
    for _ in range(200):
        g = gradient(w)
        h = np.zeros((k * d, k * d))
        for i in range(k * d):  # curvature by differences
            e = np.zeros(k * d)
            e[i] = 1e-6
            h[i] = ((gradient(w + e.reshape(k, d)) - gradient(w - e.reshape(k, d))) / 2e-6).ravel()
        step = -np.linalg.lstsq(h + 1e-9 * np.eye(k * d), g.ravel(), rcond=None)[0].reshape(k, d)
        t = 1.0
        while objective(w + t * step) > objective(w) and t > 1e-10:
            t /= 2
        w = w + t * step
        if np.linalg.norm(g) < 1e-9:
            break
    return w, objective


def rows_of(spark, tables, path):
    """One stored table of several spaces."""
    for space, (x, y) in tables.items():
        told = [(space, int(c), Vectors.dense(r) if i % 2 else Vectors.sparse(len(r), {j: v for j, v in enumerate(r) if v})) for i, (r, c) in enumerate(zip(x, y))]
        spark.createDataFrame(told, ["space", "y", "features"]).select(F.col("space").cast("int"), F.col("y").cast("int"), "features").write.mode("append").parquet(path)
    return Z.even_rows(spark.read.schema(f"space int, y int, features {STORED_VECTOR}").parquet(path))


def test_all_fits_reach_their_optimum_in_step(spark, tmp_path):
    tables = {0: data(1), 1: data(2, 60, 5)}
    rows = rows_of(spark, tables, str(tmp_path / "v"))
    fits = [Z.Fit("logistic", 7 - 2 * s, w, c, space=s) for s in (0, 1) for c in (0.1, 10.0) for w in ((1.0, 1.0, 1.0), (0.5, 2.0, 1.5))]
    fits += [Z.Fit("squared_hinge", 7 - 2 * s, (1.0, 3.0, 1.0), c, t, s) for s in (0, 1) for c in (0.1, 10.0) for t in range(3)]
    for fit, w in zip(fits, Z.fit_all(rows, fits, 1e-8)):
        best, objective = plain_optimum(*tables[fit.space], fit)
        assert objective(w) <= objective(best) * (1 + 1e-9)
        assert np.allclose(w[:, :-1], best[:, :-1], atol=1e-4), fit
    rows.unpersist()


def test_together_and_alone_agree(spark, tmp_path):
    tables = {0: data(3), 1: data(4)}
    rows = rows_of(spark, tables, str(tmp_path / "v"))
    fits = [Z.Fit("logistic", 7, (1.0, 1.0, 1.0), c, space=s) for s in (0, 1) for c in (0.1, 1.0, 10.0)]
    for fit, w in zip(fits, Z.fit_all(rows, fits)):
        assert np.allclose(w, Z.fit_all(rows, [fit])[0], atol=1e-6)


def test_no_rows_of_a_space(spark, tmp_path):
    rows = rows_of(spark, {0: data(5)}, str(tmp_path / "v"))
    assert not Z.fit_all(rows, [Z.Fit("squared_hinge", 7, (1.0, 1.0, 1.0), space=9)])[0].any()


def test_tuning_equals_single_fits(spark):
    """Every cell of the grid against a pipeline and a model of its own; the best setting is refitted."""
    rng = np.random.default_rng(2)
    words = {"ham": "lunch meeting tomorrow", "phishing": "verify account login", "spam": "prize winner cash"}
    rows = []
    for i in range(90):
        label = LABELS[i % 3]
        own = words[label if rng.random() < 0.7 else LABELS[rng.integers(3)]].split()
        rows.append((i, " ".join([*rng.choice(own, 2), *rng.choice("note item thing".split(), 2)]), label, "sms" if i % 2 else "email", 0.1))
    df = spark.createDataFrame(rows, "row_id long, text string, label string, channel string, capital_ratio double")
    folded = R.kfold(df, folds=3).persist()
    spec = V.FeatureSpec(char=True, signals=8, ratio_from_text=True)
    scores, best, pipeline, model = M.tune(folded, spec, grid=[0.1, 1.0], folds=3)
    got = {(r.fold, r.c): r.macro_f1 for r in scores.collect()}
    for fold in range(3):
        inside, outside = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        own = M.features_of(inside, spec)
        vectors = M.training_vectors(own, inside)
        for c in (0.1, 1.0):
            told = M.fit_logistic(vectors, c, balanced=True).predict(own.transform(outside).select("label", "channel", "features"))
            want = E.summary(E.counts(told)).where("slice = 'all'").first()["macro_f1"]
            assert got[fold, c] == pytest.approx(want, abs=1e-12)
    assert best == M.cv_summary(scores).first()["c"]
    again = M.fit_logistic(M.training_vectors(M.features_of(df, spec), df), best, balanced=True).model
    assert np.allclose(model.model.coefficientMatrix.toArray(), again.coefficientMatrix.toArray(), atol=1e-6)
    # The ratio comes from the text: the saved one, which is 0.1 everywhere, would scale to nothing but constants.
    assert "capital_ratio" in [n.split(":")[1] for n in V.feature_names(pipeline) if n.startswith("custom:")]
    shouted = df.limit(1).withColumns({"text": F.lit("ABC def"), "capital_ratio": F.lit(0.9)})
    ratio = pipeline.transform(shouted).select("sig_capital_ratio").first()[0]
    assert ratio == 0.5


def test_models_fitted_together_equal_those_fitted_alone(spark):
    rows = [(i, f"{w} note {w} thing{i % 5}", c, "sms", 0.1) for i, (w, c) in enumerate([("lunch", "ham"), ("login", "phishing"), ("prize", "spam")] * 12)]
    df = spark.createDataFrame(rows, "row_id long, text string, label string, channel string, capital_ratio double")
    data = M.training_vectors(M.features_of(df, V.FeatureSpec()), df)
    names = ["LogisticRegression", "LogisticRegression_balanced", "LinearSVC", "LinearSVC_balanced"]
    for name, model in M.fit_together(data, names).items():
        alone = M.SOLVERS[name](data)
        if model.kind == "lr":
            assert np.allclose(model.model.coefficientMatrix.toArray(), alone.model.coefficientMatrix.toArray(), atol=1e-6)
        else:
            assert all(np.allclose(model.model[c].coefficients.toArray(), alone.model[c].coefficients.toArray(), atol=1e-6) for c in LABELS)


@pytest.mark.parametrize("cells", [7, 30, 10**6])
def test_dense_and_sparse_rows_answer_alike(monkeypatch, cells):
    x, y = data(5)
    sizes, (_, indices) = (x != 0).sum(axis=1), np.nonzero(x)
    w = np.random.default_rng(6).normal(size=(4, 3, 8))
    fits = [Z.Fit("logistic", 7, (1.0, 2.0, 1.0)), Z.Fit("squared_hinge", 7, (1.0, 3.0, 1.0), target=1), Z.Fit("logistic", 7, (1.0, 1.0, 1.0))]
    asked = list(zip(fits, [("line", w[0], w[1]), ("curve", w[2][:1], w[3][:1]), ("value", w[1])]))
    monkeypatch.setattr(Z, "CELLS", cells)
    sums = []
    for share in (0, 1000):
        monkeypatch.setattr(Z, "CELLS_AN_ENTRY", share)
        blocks = list(Z.Rows(y, indices.astype(np.int32), x[x != 0], sizes).parts(7))
        assert all((b.matrix is not None) == bool(share) for b in blocks) and sum(len(b.y) for b in blocks) == len(y)
        answers = [b.answers(asked) for b in blocks]
        sums.append([[sum(own) for own in zip(*each)] for each in zip(*answers)])
    assert [len(a) for a in sums[0]] == [7, 1, 7]
    for a, b in zip(*sums):
        assert all(np.allclose(u, v, rtol=1e-10, atol=1e-10) for u, v in zip(a, b))


def test_curvature_of_some_rows_saves_passes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((400, 60)) * (rng.random((400, 60)) < 0.4) * np.geomspace(0.05, 4, 60)
    y = (x @ rng.normal(size=(60, 3)) + rng.normal(size=(400, 3))).argmax(axis=1)
    rows = rows_of(spark, {0: (x, y)}, str(tmp_path / "v"))
    fits = [Z.Fit("logistic", 60, (1.0, 2.0, 1.0), 10.0), Z.Fit("squared_hinge", 60, (1.0, 3.0, 1.0), 10.0, 1)]
    asked = []
    one_pass = Z._pass
    monkeypatch.setattr(Z, "_pass", lambda *told: asked.append(1) or one_pass(*told))
    found = Z.fit_all(rows, fits, 1e-6)
    for fit, w in zip(fits, found):
        best, objective = plain_optimum(x, y, fit)
        assert objective(w) <= objective(best) * (1 + 1e-9)
    alone = []
    for fit in fits:  # the same questions, answered here, of directions that the diagonal shapes
        block = Z.Rows(y, np.tile(np.arange(60), 400), x.ravel(), np.full(400, 60))
        solver, sent = Z._newton(fit, 1e-6), 0
        try:
            question = next(solver)
            while True:
                sent += 1
                question = solver.send(block.answers([(fit, question)])[0])
        except StopIteration:
            alone.append(sent)
    assert 2 * len(asked) < max(alone), (len(asked), alone)
    rows.unpersist()


def test_weighed_entries_are_packed_as_counts(spark, tmp_path):
    """Counts times weights over a norm of the row, in two blocks, and plain numbers behind them."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(0.6, (90, 12)).astype(float)
    counts[:3] = 0
    counts[3:5] *= 300  # more than a byte holds, unless all of a block share it
    counts[5, :8] = [2, 3, 0, 0, 0, 0, 0, 0]  # no entry that all others are a multiple of
    weight = rng.uniform(1, 4, 12)
    x = counts * weight
    for cut in (slice(0, 8), slice(8, 12)):
        x[:, cut] /= np.where(x[:, cut].any(axis=1), np.linalg.norm(x[:, cut], axis=1), 1)[:, None]
    x = np.hstack([x, rng.random((90, 2)) * (rng.random((90, 2)) < 0.7)])
    y = rng.integers(0, 3, 90)
    weighing = Z.Weighing(weight, np.repeat([0, 1], [8, 4]))
    told = [(0, int(c), Vectors.sparse(14, {j: v for j, v in enumerate(r) if v})) for r, c in zip(x.tolist(), y)]
    spark.createDataFrame(told, ["space", "y", "features"]).select(F.col("space").cast("int"), F.col("y").cast("int"), "features").write.parquet(str(tmp_path / "v"))
    stored = spark.read.schema(f"space int, y int, features {STORED_VECTOR}").parquet(str(tmp_path / "v"))
    packed = Z.even_rows(stored, {0: weighing})
    bytes_of = packed.select(*[F.sum(F.length(c)).alias(c) for c in ("indices", "counts", "values")]).first()
    entries = np.count_nonzero(x)
    assert bytes_of.indices == 2 * entries and bytes_of["values"] == 8 * (entries - bytes_of.counts)
    assert bytes_of.counts > 0.9 * np.count_nonzero(x[:, :12])
    (batch,) = packed.toArrow().combine_chunks().to_batches()
    block = Z._rows(batch, weighing)
    back = np.zeros((90, 14))
    back[np.repeat(np.arange(90), block.sizes), block.indices] = block.values
    ordered = lambda m, c: np.array(sorted(np.hstack([m, np.reshape(c, (-1, 1))]).tolist(), key=lambda r: [round(v, 6) for v in r]))
    assert np.allclose(ordered(back, block.y), ordered(x, y), rtol=1e-13, atol=0)
    fit = Z.Fit("logistic", 14, (1.0, 2.0, 1.0))
    (w,), (plain,) = Z.fit_all(packed, [fit], 1e-8, {0: weighing}), Z.fit_all(Z.even_rows(stored), [fit], 1e-8)
    assert np.allclose(w, plain, atol=1e-6)
    packed.unpersist()


def test_many_fits_keep_little_on_the_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.random((300, 40)) * (rng.random((300, 40)) < 0.4)
    y = (x @ rng.normal(size=(40, 3)) + rng.normal(size=(300, 3))).argmax(axis=1)
    rows = rows_of(spark, {0: (x, y)}, str(tmp_path / "v"))
    fits = [Z.Fit("logistic", 40, (1.0, 1.0, 1.0), c) for c in (0.1, 1.0, 10.0)]
    monkeypatch.setattr(Z, "DRIVER_BYTES", 3 * 4 * 120**2)  # three inverses of 60 rows with two lines each
    shaping = Z._shaping(rows, fits, {})[0]
    assert len(shaping.y) == 60 and not any(isinstance(v, np.ndarray) and v.size > 60 * 60 for v in vars(shaping).values())
    kept = []
    scaled = Z._scaled
    monkeypatch.setattr(Z, "_scaled", lambda rest, shaped, known: kept.append(sum(s.nbytes + y.nbytes for s, y in known)) or scaled(rest, shaped, known))
    found = Z.fit_all(rows, fits, 1e-8)
    assert 0 < max(kept) <= Z.DRIVER_BYTES // 3
    for fit, w in zip(fits, found):
        best, objective = plain_optimum(x, y, fit)
        assert objective(w) <= objective(best) * (1 + 1e-9)
    rows.unpersist()
