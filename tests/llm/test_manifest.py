import random
from hashlib import sha256
from zlib import crc32

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from compare import compare, connect
from msgsieve.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests, fanout=16):
    """All levels, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def climb(levels, place, fanout=16):
    for level in levels[:-1]:
        start = place - place % fanout
        yield level[start:place], level[place + 1 : start + fanout]
        place //= fanout


def brute(rows, fanout=16):
    """Rows of the query, from plain lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    lower = {s: tree([leaf(r) for r in own[s]], fanout) for s in names}
    upper = tree([lower[s][-1][0] for s in names], fanout)
    root, out = upper[-1][0], []
    for g, s in enumerate(names):
        for k, r in enumerate(own[s]):
            sides = [*climb(lower[s], k, fanout), *climb(upper, g, fanout)]
            text = r[4]
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            digest = leaf((*r[:4], text))
            for left, right in sides:
                digest = h(*left, digest, *right)
            proof = h(*[x for left, right in sides for x in (*left, *right)])
            out.append((r[0], leaf(r), lower[s][-1][0], root, proof, digest, digest == root))
    return out


def table(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, path):
    got = [tuple(r) for r in M.op11_manifest(spark, table(spark, rows, path)).select(*COLUMNS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_query_equals_plain_trees(spark, tmp_path):
    rnd = random.Random(3)
    sizes = {"b": 1, "hot": 600, None: 17, "é": 16, "z": 257, "a": 33}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            text = rnd.choice([None, "", "Some Text", "ÄÖ lower", "x" * 50]) if k % 3 else f"Text {k}"
            rows.append((rnd.choice([k, k, k, 7, None]), s, rnd.choice(["en", None]), rnd.choice([None, k]), text))
    rows += rows[:40]  # repeated rows
    rnd.shuffle(rows)
    check(spark, rows, tmp_path)


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_one_group(spark, tmp_path, n):
    check(spark, [(i, "s", "en", i, f"T{i}") for i in range(n)], tmp_path)


def test_groups_of_one_row(spark, tmp_path):
    check(spark, [(i, f"s{i:03}", "en", i, f"T{i}") for i in range(300)], tmp_path)


def test_empty_table_and_long_text(spark, tmp_path):
    assert M.op11_manifest(spark, table(spark, [], tmp_path / "none")).collect() == []
    check(spark, [(0, "s", None, None, "A" * 3_000_000), (1, "s", "-", 0, "-")], tmp_path / "long")


def test_some_requests_and_a_stored_manifest(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    digest = M.leaf_digest([F.col(c) for c in M.COLUMNS]).alias("leaf")
    docs.select("doc_id", "source", digest).write.parquet(f"{tmp_path}/leaves")
    M.build(spark.read.parquet(f"{tmp_path}/leaves"), "source", ["doc_id"], "leaf", fanout=4).save(f"{tmp_path}/m")
    stored = M.load(spark, f"{tmp_path}/m")
    some = M.prove(stored, stored.leaves.where("doc_id IN (0, 77, 499)"))
    out = some.select("doc_id", M.folded(F.col("leaf"), F.col("path")).alias("to")).collect()
    assert sorted(r.doc_id for r in out) == [0, 77, 499] and {r.to for r in out} == {stored.root}
    assert stored.root == brute(rows, fanout=4)[0][3]
    assert all(r.n == 1 for r in stored.nodes.groupBy("digest").agg(F.count("*").alias("n")).collect())


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF_SMALL), SF_SMALL, "op11_manifest", M.op11_manifest, M.ORACLE_SQL) == ""
