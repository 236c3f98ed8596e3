import pytest

from msgsieve.operators import evaluate as E


def cells(spark, *rows):
    return spark.createDataFrame(rows, "model string, channel string, label string, prediction string, n long")


def test_slice_macro_f1_uses_labels_seen_in_the_slice(spark):
    c = cells(
        spark, ("m", "sms", "ham", "ham", 1), ("m", "sms", "ham", "spam", 1), ("m", "email", "phishing", "phishing", 3)
    )
    got = {r.slice: r for r in E.summary(c, "model").collect()}
    assert got["sms"].macro_f1 == pytest.approx((2 / 3) / 2)
    assert got["email"].macro_f1 == 1.0
    assert got["all"].macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert got["all"].accuracy == pytest.approx(4 / 5)


def test_confusion_report_and_cell(spark):
    c = cells(
        spark, ("m", "sms", "phishing", "ham", 2), ("m", "sms", "phishing", "phishing", 1),
        ("m", "email", "ham", "ham", 5), ("m", "email", "phishing", "phishing", 1),
    )
    matrix = {r.label: (r.ham, r.phishing, r.spam) for r in E.confusion_matrix(c, "model").collect()}
    assert matrix == {"ham": (5, 0, 0), "phishing": (2, 2, 0)}
    report = {r["row"]: r for r in E.class_report(c, "model").collect()}
    assert report["phishing"].recall == 0.5 and report["phishing"].precision == 1.0
    assert report["ham"].precision == pytest.approx(5 / 7)
    assert report["accuracy"].f1 == pytest.approx(7 / 9)
    assert report["weighted avg"].support == 9
    cell = E.cell_recall(c, "model").first()
    assert (cell.recall, cell.n) == (pytest.approx(1 / 3), 3)
    assert E.cell_recall(c, "model", channel="email", label="spam").count() == 0


def test_leaderboard_and_pairs(spark):
    c = cells(
        spark, ("a", "sms", "ham", "ham", 1), ("a", "email", "spam", "ham", 1),
        ("b", "sms", "ham", "ham", 1), ("b", "email", "spam", "spam", 1),
    )
    assert [r.model for r in E.leaderboard(c).collect()] == ["b", "a"]
    assert E.best_model(c).first().model == "b"
    metrics = E.metric_rows(c.withColumnRenamed("model", "experiment"), "experiment")
    row = E.side_by_side(metrics, "a", "b").where("slice = 'all' and metric = 'macro_f1'").first()
    assert row.difference == pytest.approx(row.b - row.a) and row.b == 1.0


def test_triage_puts_the_dangerous_mistakes_first(spark):
    rows = [(1, "sms", "phishing", "spam", "x"), (2, "sms", "phishing", "phishing", "x"), (3, "sms", "phishing", "ham", "y" * 300), (4, "email", "phishing", "ham", "x")]
    df = spark.createDataFrame(rows, "row_id long, channel string, label string, prediction string, text string")
    got = E.error_triage(df).collect()
    assert [r.row_id for r in got] == [3, 1, 2] and len(got[0].preview) == 200


def test_top_per_class_breaks_ties_by_name(spark):
    w = spark.createDataFrame([("ham", "b", 1.0), ("ham", "a", 1.0), ("ham", "c", 2.0)], "class string, feature string, weight double")
    assert [(r["rank"], r.feature) for r in E.top_per_class(w, 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]
