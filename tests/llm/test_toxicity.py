import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgsieve.llm import toxicity as T

BAD = ["vilon", "grum", "skarb"]


@pytest.fixture(scope="module")
def corpus():
    """Clean texts, shabby ones full of symbols, and toxic ones with forms of bad words."""
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(20, 80))]
        toxic, shabby = i % 6 == 0, i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + f"ze{rnd.randint(0, 40)}")
        if shabby:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(shabby), int(toxic)))
    return docs, labels


KIND = "doc_id long, text string, _text string"
LABELS = "doc_id long, low_quality int, toxic int"


def test_held_out_accuracy_and_chain(spark, corpus):
    docs, labels = corpus
    table = spark.createDataFrame(docs, KIND).repartition(3)
    chain = T.fit_chain(table, spark.createDataFrame([x for x in labels if x[0] % 7 > 1], LABELS), T.CATEGORIES)
    assert [len(w) for w in chain.weights] == [len(chain.words) + 6, len(chain.words) + 7]
    p = {r.doc_id: r for r in T.scored(table, chain).collect()}
    held = [x for x in labels if x[0] % 7 <= 1]
    assert np.mean([(p[i].p_toxic >= 0.5) == bool(t) for i, _, t in held]) > 0.97
    assert np.mean([(p[i].p_low_quality >= 0.5) == bool(q) for i, q, _ in held]) > 0.97


def test_scores_equal_a_plain_sum(spark, corpus):
    chain = T.Chain(("a", "b"), np.zeros(0, np.uint64), (0.5, -1.0), (np.arange(6.0), np.append(np.zeros(6), 2.0)))
    rows = T.scored(spark.createDataFrame([(1, "AAbb 12"), (2, None), (3, "")], "doc_id long, text string"), chain).collect()
    upper, lower, digits = 2 / 7, 2 / 7, 2 / 7
    a = 1 / (1 + np.exp(-(0.5 + lower * 1 + digits * 2)))
    assert rows[0].p_a == pytest.approx(a) and rows[0].p_b == pytest.approx(1 / (1 + np.exp(-(2 * a - 1))))
    assert [(r.p_a, r.p_b) for r in rows[1:]] == [(0.0, 0.0)] * 2


@pytest.mark.parametrize("labels, p", [([], 0.0), ([(1, 0, 0), (2, 0, 0), (2, None, None)], 0.0), ([(1, 1, 1), (2, 1, 1)], 1.0)])
def test_one_sided_labels(spark, labels, p):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, "more text", "x"), (None, "no id", "x")], KIND)
    chain = T.fit_chain(docs, spark.createDataFrame(labels, LABELS), T.CATEGORIES)
    got = T.scored(docs, chain).collect()
    assert [(r.p_low_quality, r.p_toxic) for r in got] == [(p, p)] * 3
    assert T.scored(docs.limit(0), chain).count() == 0
    assert T.scored(docs.withColumn("p_toxic", F.lit("clash")), chain).columns == ["doc_id", "text", "_text", "p_low_quality", "p_toxic"]
