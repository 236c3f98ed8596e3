from collections import Counter

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from msgsieve.functions import grams as G, tokens as K
from msgsieve.operators.vectorize import tfidf_model, token_rows, vocabulary

TEXTS = ["It's a I ÀB", None, "", " \t\n", "aaaa aaaa aaa a", "日本語 \U0001f600\U0001f600 x\x00 x", "".join(map(chr, range(0x4E00, 0x6E00))), "ab ab", "ab ab"]


def test_grams_are_those_of_the_tokens(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    want = {r.id: Counter(r.char_tokens) for r in K.char_ngrams().transform(df).collect()}
    for piece in (3, G.PIECE):
        monkeypatch.setattr(G, "PIECE", piece)
        rows = G.gram_rows(df, "id").collect()
        got = {i: Counter() for i in want}
        for r in rows:
            got[r.id][r.term] = r.tf
        assert got == want and len(rows) == sum(map(len, want.values()))
        counts = G.gram_counts(df).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).collect()
        assert {r.term: r.tf for r in counts} == sum(want.values(), Counter())
        assert {r.term: r.df for r in counts} == Counter(t for c in want.values() for t in c)


def test_counts_are_folded_over_rows_before_they_leave_a_task(spark):
    df = spark.createDataFrame([("some equal words",)] * 500, "text string").coalesce(1)
    counts = G.gram_counts(df)
    assert counts.count() == counts.select("term").distinct().count()


def test_vectors_are_those_of_the_stock_counter(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame(list(enumerate([*TEXTS, "aaaa it's"])), "id int, text string").coalesce(1)
    terms = sorted({t for r in K.char_ngrams().transform(df).collect() for t in r.char_tokens[:60]}) + ["where", "a b"]
    stock = CountVectorizerModel.from_vocabulary(terms, inputCol="char_tokens", outputCol="v")
    want = {r.id: r.v for r in stock.transform(K.char_ngrams().transform(df)).collect()}
    own = G.GramCounter(terms, inputCol="text", outputCol="v")
    own.save(str(tmp_path / "own"))
    for piece, cells in ((3, len(terms) * 2), (G.PIECE, G.CELLS)):
        monkeypatch.setattr(G, "PIECE", piece)
        monkeypatch.setattr(G, "CELLS", cells)
        for model in (own, G.GramCounter.load(str(tmp_path / "own"))):
            out = model.transform(df)
            assert out.columns == ["id", "text", "v"]
            got = {r.id: r.v for r in out.collect()}
            assert got == want and all(isinstance(v, SparseVector) for v in got.values())


def test_no_token_is_made_for_each_place_of_a_text(spark):
    df = spark.createDataFrame([(0, "some words some words")], "row_id long, text string")
    model = tfidf_model("char", spark.createDataFrame([(" so", 1.0), ("ord", 2.0)], "term string, idf double"), "text", "features")
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan and "ArrowEvalPython" in plan
    assert list(model.transform(df).first()["features"].toArray()) == pytest.approx([0.2**0.5, 0.8**0.5])


def test_vocabulary_folds_tokens_over_rows(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "garden club garden club", "club of the garden"]], "text string").coalesce(1)
    want = token_rows(df, "word").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).collect()
    for piece in (2, G.PIECE):
        monkeypatch.setattr(G, "PIECE", piece)
        got = vocabulary(df, "word", min_df=1).select("term", "df", "tf").collect()
        assert sorted(got) == sorted(want)
    monkeypatch.undo()
    many = spark.createDataFrame([("some equal words",)] * 500, "text string").coalesce(1)
    plan = vocabulary(many, "word")._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and G.token_counts(K.word_ngrams(out="t").transform(many), "t").count() == 3
