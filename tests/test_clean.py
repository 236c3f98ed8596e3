from pyspark.sql import functions as F

from msgsieve.operators import clean as C, quality as Q
from msgsieve.schema import messages
from conftest import SF_SMALL

COLS = "row_id long, text string, source string, source_rank int, channel string, label string"


def rows(spark, *items):
    return spark.createDataFrame(
        [(i, t, f"s{rank}", rank, "sms", label) for i, (t, rank, label) in enumerate(items)], COLS
    )


def test_keep_first_and_conflicts(spark):
    df = rows(spark, ("same", 1, "phishing"), ("same", 0, "ham"), ("other", 1, "spam"))
    kept = C.dedup_exact(df, conflicts=True).orderBy("text").collect()
    assert [(r.row_id, r.label, r.copies, r.label_conflict) for r in kept] == [
        (2, "spam", 1, 0),
        (1, "ham", 2, 1),
    ]


def test_one_hot_text_survives_once_whatever_the_partitions(spark):
    df = rows(spark, *[("hot", 1, "ham")] * 400, *[(f"t{i}", 1, "ham") for i in range(50)])
    for parts in (1, 17):
        kept = C.dedup_exact(df.repartition(parts)).collect()
        assert len(kept) == 51
        assert min(r.row_id for r in kept) == 0


def test_template_twins(spark):
    kept = C.dedup_template(rows(spark, ("code 123 now", 0, "ham"), ("code 98765 now", 0, "ham")))
    assert [r.row_id for r in kept.collect()] == [0]


def test_clean_text(spark):
    df = rows(
        spark, (None, 0, "ham"), (" \n ", 0, "ham"), ("short", 0, "ham"), ("x" * 10, 0, "ham"),
        ("x" * 10001, 0, "ham"), ("ÀB cdefghij", 0, "ham"),
    )
    got = {r.row_id: (r.text, r.capital_ratio) for r in C.clean_text(df).collect()}
    assert got == {3: ("x" * 10, 0.0), 5: ("àb cdefghij", 0.2)}


def test_one_dedup_equals_two(spark):
    df = messages(spark, SF_SMALL)
    two = C.dedup_template(C.repair(C.dedup_exact(C.clean_text(df))))
    one = C.prepare(df)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_attrition(spark):
    df = rows(
        spark, (None, 0, "ham"), ("  ", 0, "ham"), ("tiny", 0, "ham"), ("message one 1", 0, "ham"),
        ("Message  one 1", 1, "ham"), ("message one 2", 0, "ham"),
    )
    got = [(r.stage, r.rows, r.lost) for r in C.attrition(df).orderBy("step").collect()]
    assert got == [
        ("raw", 6, 0), ("text_present", 5, 1), ("text_not_empty", 4, 1), ("length_band", 3, 1),
        ("exact_dedup", 2, 1), ("template_dedup", 1, 1),
    ]
    assert [r.rows for r in C.attrition(df.limit(0)).collect()] == [0] * 6


def test_fold_subject_keeps_missing_text(spark):
    df = spark.createDataFrame([("t", None), (None, "s"), ("t", "s")], "text string, subject string")
    assert [r.text for r in C.fold_subject(df).collect()] == [" t", None, "s t"]


def test_validate(spark):
    df = rows(spark, (None, 0, "ham"), ("abc", 0, "weird"), ("long enough", 0, None))
    got = {(r["check"], r.value): r.n for r in Q.validate(df).collect()}
    assert got[("missing_text", "")] == 1 and got[("missing_label", "")] == 1
    assert got[("short_text", "")] == 1 and got[("unknown_label", "weird")] == 1
    assert ("unknown_channel", "sms") not in got


def test_source_overlap(spark):
    df = rows(spark, ("a", 0, "ham"), ("a", 1, "ham"), ("a", 1, "ham"), ("a", 2, "ham"), ("b", 1, "ham"), ("b", 2, "ham"))
    got = {(r.source_a, r.source_b): r.shared_texts for r in Q.source_overlap(df).collect()}
    assert got == {("s0", "s1"): 1, ("s0", "s2"): 1, ("s1", "s2"): 2}


def test_crosstab_is_zero_filled(spark):
    row = Q.crosstab(rows(spark, ("a", 0, "ham"))).first()
    assert (row.ham, row.phishing, row.spam) == (1, 0, 0)
    assert Q.value_counts(rows(spark, ("a", 0, "ham"), ("a", 0, "spam"), ("a", 0, "spam")), "label").first().n == 2
    assert Q.head_of_cell(rows(spark, ("a", 0, "ham"))).where(F.lit(True)).count() == 0
