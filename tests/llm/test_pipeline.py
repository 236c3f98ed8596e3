import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from conftest import SF_SMALL
from msgsieve.llm.common import written

pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, sentences=12):
    rnd = random.Random(seed)
    return " ".join(" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(8)).capitalize() + "." for _ in range(sentences))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Planted copies, near copies, passages and toxic texts among clean ones."""
    passage = prose("passage", 9)
    rows = [(i, prose(i), "en", f"s{i % 3}", 0) for i in range(150)]
    rows += [(200 + i, prose(900 + i) + f" vilonze{i % 5} grumze{i % 7} vilonze{i % 3}", "en", "s1", 0) for i in range(60)]
    rows += [(300, prose(5), "en", "s0", 0), (301, prose(5), "en", "s2", 0), (302, prose(6) + " Or so", "en", None, 0)]
    rows += [(310 + i, prose(2000 + i) + f" then{i} " + passage, "en", "s0", 0) for i in range(20)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, prose(7000), "en", "s1", 0), (None, prose(7001), "en", "s1", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 150, 2)] + [(200 + i, 1, 1) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_on_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        after = stage(spark, docs, folder)
        if name != "packing":
            assert after.columns == docs.columns
        docs = written(after, name)
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    clean = set(range(150)) | set(range(310, 330)) | {400, 401, None}
    assert ids["toxicity"] == clean | {300, 301, 302}
    after_lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert set(after_lines) == ids["toxicity"]
    assert after_lines[310].text.endswith(prose("passage", 9))
    assert all(after_lines[310 + i].text == prose(2000 + i) + f" then{i}" for i in range(1, 20))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"] if 310 < (r.doc_id or 0) < 330)
    assert ids["near_dedup"] == clean and sum(r.doc_id is None for r in seen["near_dedup"]) == 2
    assert sorted(map(str, seen["mixing"])) == sorted(map(str, seen["near_dedup"]))
    assert ids["packing"] == clean and len(seen["packing"]) == len(seen["mixing"])


def test_no_text_falls_between_line_and_near_dedup(spark, folder):
    passage, part = prose("part", 30), " ".join(prose("short").split()[:60])
    rows = [
        (1, passage + " " + prose(31, 7), "en", "s0", 0),
        (2, passage + " " + prose(32, 7), "en", "s0", 0),
        (3, prose(33, 60) + " " + part + " " + prose(34, 60), "en", "s0", 0),
        (4, part + " " + " ".join(prose(35).split()[:15]), "en", "s0", 0),
        (5, prose(33, 60) + " " + part + " " + prose(34, 60) + " and more", "en", "s0", 0),
    ]
    docs = written(spark.createDataFrame(rows, KIND).repartition(3), "docs")
    cut = written(C.line_dedup(spark, docs, folder), "cut")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[2] == prose(32, 7) and texts[4] == " ".join(prose(35).split()[:15])
    assert texts[5] == rows[4][1] and texts[1] == rows[0][1] and texts[3] == rows[2][1]
    assert {r.doc_id for r in C.near_dedup(spark, cut, folder).collect()} == {1, 2, 3, 4}


def test_repeated_rows_and_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = written(docs.union(docs), "twice")
    kept = C.near_dedup(spark, twice, folder).where("doc_id IS NOT NULL")
    assert kept.count() == kept.select("doc_id").distinct().count() == 150 + 60 + 20 + 2
    nothing = written(docs.limit(0), "nothing")
    for name, stage in C.STAGES:
        nothing = written(stage(spark, nothing, folder), name)
        assert nothing.count() == 0


def test_run_equals_the_stages(spark):
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end OR n > 2048").count() == 0
    assert C.ORACLE_SQL is None


def test_packing_follows_the_order_of_mixing(spark):
    rows = [(i, f"one two {i % 10}", "en", f"s{i % 3}", 0) for i in range(3000)]
    docs = written(spark.createDataFrame(rows, KIND).repartition(5), "plain")
    got = {}
    for name, order in (("up", "doc_id"), ("down", F.desc("doc_id"))):
        stored = written(docs.repartitionByRange(4, order).sortWithinPartitions(order), name)
        packs = C.packing(spark, stored, "").collect()
        assert sorted(r.doc_id for r in packs) == list(range(3000)) and len({(r.sequence_id, r.offset) for r in packs}) == 3000
        got[name] = [r.doc_id for r in sorted(packs, key=lambda r: (r.sequence_id, r.offset))]
        numbers = {r.sequence_id for r in packs}
        assert numbers == set(range(len(numbers)))
    assert got["up"][0] == 0 and got["down"][0] == 2999
    # All texts are alike in length here, so the packed order is the stored one.
    assert got["up"] == list(range(3000)) and got["down"] == got["up"][::-1]
