import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.operators import ranks as R


def strata(spark, sizes, parts=4):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, name, "sms"))
            i += 1
    return spark.createDataFrame(rows, "row_id long, label string, channel string").repartition(parts)


def brute_split(sizes, ids_of, share=0.2):
    n = sum(sizes.values())
    train = n - math.ceil(share * n)
    quota = {s: c * train // n for s, c in sizes.items()}
    rest = sorted(sizes, key=lambda s: (-(sizes[s] * train % n), s))
    for s in rest[: train - sum(quota.values())]:
        quota[s] += 1
    out = {}
    for s, ids in ids_of.items():
        order = sorted(ids, key=lambda i: (md5(f"42:{i}".encode()).hexdigest(), i))
        out.update({i: "train" if p < quota[s] else "test" for p, i in enumerate(order)})
    return out


@pytest.mark.parametrize(
    "sizes", [{"ham": 5, "phishing": 3, "spam": 1}, {"ham": 700, "phishing": 1, "spam": 299}, {"ham": 1}]
)
def test_split_equals_brute_force(spark, sizes):
    for parts in (1, 17):
        df = strata(spark, sizes, parts)
        ids = {}
        for r in df.collect():
            ids.setdefault(r.label, []).append(r.row_id)
        got = {r.row_id: r.split for r in R.stratified_split(df).collect()}
        assert got == brute_split(sizes, ids)


def test_split_of_5_3_1_has_two_test_rows(spark):
    split = R.stratified_split(strata(spark, {"ham": 5, "phishing": 3, "spam": 1}))
    assert split.where("split = 'test'").count() == 2


def test_folds_are_even_disjoint_and_covering(spark):
    df = strata(spark, {"ham": 103, "phishing": 7, "spam": 2})
    rows = R.kfold(df).collect()
    assert len(rows) == 112
    for label, n in (("ham", 103), ("phishing", 7), ("spam", 2)):
        sizes = [sum(r.fold == f and r.label == label for r in rows) for f in range(5)]
        assert sorted(sizes, reverse=True) == [(n + 4 - f) // 5 for f in range(5)]


def test_other_seed_other_rows(spark):
    df = strata(spark, {"ham": 200})
    a = {r.row_id for r in R.stratified_split(df).where("split='test'").collect()}
    b = {r.row_id for r in R.stratified_split(df, seed=7).where("split='test'").collect()}
    assert len(a) == len(b) == 40 and a != b


@pytest.mark.parametrize("hot", [0, 900])
def test_quantiles_equal_numpy(spark, hot):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(1001) ** 3 * 1.2 - 0.1, np.zeros(hot)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {r.prob: r.value for r in R.exact_quantiles(df, "v", probs, 0.0, 1.0, buckets=64).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_no_text_is_shuffled_by_the_split(spark):
    df = strata(spark, {"ham": 50}).withColumn("text", F.lit("x"))
    plan = R.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_missing_strata_are_strata(spark):
    rows = [(i, None if i % 2 else "ham", "sms") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, label string, channel string")
    got = R.stratified_split(df).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {
        ("ham", "train"): 16, ("ham", "test"): 4, (None, "train"): 16, (None, "test"): 4,
    }


def test_quotas_of_eleven_billion_rows(spark):
    sizes = {"a": 8_000_000_001, "b": 2_000_000_000, "c": 1_000_000_000}
    totals = spark.createDataFrame([(k, n) for k, n in sizes.items()], "label string, n long")
    got = {r.label: r.train_rows for r in R.train_quotas(totals, ["label"]).collect()}
    n = sum(sizes.values())
    train = n - math.ceil(0.2 * n)
    assert sum(got.values()) == train
    assert all(abs(got[k] - sizes[k] * train / n) <= 1 for k in sizes)
