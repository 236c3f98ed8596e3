import random

from conftest import SF_SMALL
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from msgsieve.llm import sharding as S


def published(key, n):
    """The loop of the paper."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


KEYS = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, 2**31] + [random.Random(7).randrange(-(2**63), 2**63) for _ in range(400)] + list(range(400))


@pytest.mark.parametrize("shards", [1, 2, 40, 41, 1000])
def test_equals_the_published_loop(spark, shards):
    df = spark.createDataFrame([(k,) for k in KEYS], "k long")
    rows = S.with_jump(df, F.col("k"), shards, "s", "g").collect()
    assert [r.s for r in rows] == [published(r.k, shards) for r in rows]
    assert [r.g for r in rows] == [published(r.k, shards + 1) for r in rows]


def test_more_jumps_than_usual(spark, monkeypatch):
    monkeypatch.setattr(S, "USUAL_JUMPS", 2)
    df = spark.createDataFrame([(k,) for k in KEYS], "k long")
    rows = S.with_jump(df, F.col("k"), 40, "s").collect()
    assert [r.s for r in rows] == [published(r.k, 40) for r in rows]


def test_growth_moves_rows_into_the_new_shards_only(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    rows = S.moved(docs, 40, 44).collect()
    assert all(r.new_shard >= 40 for r in rows)
    assert 250 < len(rows) < 480  # 4 of 44 shards take 364 of 4,000


def test_even_shares(spark):
    n = [r["count"] for r in S.sharded(spark.range(40000).withColumnRenamed("id", "doc_id")).groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) < 1200 and min(n) > 800


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF_SMALL), SF_SMALL, "op13_sharding", S.op13_sharding, S.ORACLE_SQL) == ""


def test_edges(spark, tmp_path):
    rows = [(None, None, "a"), (None, "", "b"), (5, "x", "c"), (5, "x", "c"), (5, "y" * 100_000, "d"), (9, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op13_sharding(spark, str(tmp_path)).collect()
    assert len(out) == 6
    assert {(r.doc_id, r.size, r.shard) for r in out} == {(i, 16 + len((t or "").encode()), published(i or 0, 40)) for i, t, _ in rows}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert S.sharded(docs).columns == ["doc_id", "text", "shard", "grown_shard"]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op13_sharding(spark, f"{tmp_path}/none").collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    S.write_shards(docs, f"{tmp_path}/out", 8, files=2)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.doc_id, r.shard) for r in back} == {(i, published(i, 8)) for i in range(500)}


def test_native(spark):
    plan = S.sharded(spark.range(10).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
