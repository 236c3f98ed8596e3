import zlib

import numpy as np

from conftest import SF
from msgsieve.llm import language_id as L


def test_query_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = L.op2_language_id(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) > 0.98


def test_edges(spark):
    rows = [(i, f"{a} {b} the {a} ing " * 3, "en") for i, (a, b) in enumerate([("and", "with"), ("that", "of")] * 5)]
    rows += [(20 + i, f"der {a} und {b} nicht ein " * 3, "de") for i, (a, b) in enumerate([("die", "das"), ("von", "zu")] * 5)]
    rows += [(40 + i, "из на для что это " * 3, "xx") for i in range(5)]
    rows += [(90, None, "en"), (91, "text", None), (None, "text", "en"), (92, "", "de"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.families == (("germanic", ("de", "en")), ("xx", ("xx",))) and list(model.pairs) == [("de", "en")]
    tests = [(1, "und die ein nicht"), (2, "THE WITH ING THAT"), (3, "это что"), (4, None), (5, "12 ... !"), (6, ""), (7, "é"), (8, "the and " * 200_000)]
    out = {r.n: r for r in L.identified(spark.createDataFrame(tests, "n long, text string"), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8)] == ["de", "en", "xx", "und", "und", "und", "en"]
    assert out[7].lang_pred in ("de", "en", "xx") and out[4].score == 0.0
    nothing = L.fit(docs.limit(0))
    assert [r.lang_pred for r in L.identified(docs.limit(1), nothing).collect()] == ["und"]
    assert L.identified(docs.limit(0), model).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(1, "some words here", "en")], "doc_id long, text string, lang string")
    assert L.identified(docs, L.fit(docs)).first().lang_pred == "en"
