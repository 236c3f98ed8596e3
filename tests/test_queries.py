import re

import pytest

from compare import compare, connect
from conftest import SF, SF_SMALL
from msgsieve.plans.oracle import oracle_sql
from msgsieve.plans.queries import QUERIES

ORACLE = oracle_sql()
# Queries that write and read files, or are fully covered elsewhere, need no second partitioning.
INVARIANT = [
    "dedup_exact", "dedup_template", "dedup_conflicts", "stratified_split", "kfold_assign",
    "describe_capital_ratio", "source_overlap", "attrition_funnel", "signals_13",
]


@pytest.fixture(scope="module")
def engines():
    return {sf: connect(sf) for sf in (SF, SF_SMALL)}


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, engines, name):
    assert compare(spark, engines[SF], SF, name, QUERIES[name], ORACLE[name]) == ""


@pytest.mark.parametrize("name", INVARIANT)
def test_result_does_not_depend_on_partitions(spark, engines, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert compare(spark, engines[SF_SMALL], SF_SMALL, name, QUERIES[name], ORACLE[name]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", list(ORACLE))
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_registered():
    assert set(ORACLE) <= set(QUERIES)
