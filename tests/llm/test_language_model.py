import math
import zlib
from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from msgsieve.llm import language_model as M

TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a mat", None, "", "the the the", "a cat", "the dog ran on the mat"]


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def brute_force(train):
    """Probability function of the modified Kneser-Ney bigram model, from dictionaries."""
    pairs = Counter()
    for t in train:
        before = "<s>"
        for w in tokens(t):
            pairs[before, w] += 1
            before = w
    total, followers, preceded = Counter(), defaultdict(list), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        followers[v].append(n)
        preceded[w] += 1
    d = M.discounts(*(sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)))
    e = M.discounts(*(sum(n == k for n in preceded.values()) for k in (1, 2, 3, 4)))
    types, vocabulary = len(pairs), len(preceded)
    rest = sum(e[min(n, 3) - 1] for n in preceded.values()) / types

    def p(v, w):
        low = rest / (vocabulary + 1)
        if w in preceded:
            low += max(preceded[w] - e[min(preceded[w], 3) - 1], 0) / types
        if not total[v]:
            return low
        back = sum(d[min(n, 3) - 1] for n in followers[v]) / total[v]
        n = pairs[v, w]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[v] + back * low

    return p, Counter(w for t in train for w in tokens(t))


@pytest.fixture(scope="module")
def small(spark):
    train = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    return M.fit(train, shards=3)


def test_scores_equal_brute_force(spark, small):
    p, c = brute_force(TEXTS)
    tests = [*TEXTS, "the zebra sat", "zebra zebra", "mat the"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    n, v = sum(c.values()), len(c)
    for r in M.score(rows, small, keep=["doc_id"]).collect():
        own = tokens(tests[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), abs=1e-9)
        want = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *own], own))
        assert r.score == pytest.approx(want, abs=1e-5)


def test_probabilities_sum_to_one():
    p, c = brute_force(TEXTS)
    for v in ["<s>", "the", "cat", "never"]:
        assert sum(p(v, w) for w in [*c, "unknown"]) == pytest.approx(1)


def test_empty_training_table(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    model = M.fit(nothing)
    rows = M.score(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), model, keep=["doc_id"]).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows} == {(1, 3, 0, 0.0, 0.0), (None, 1, 0, 0.0, 0.0)}
    assert M.score(nothing, model, keep=["doc_id"]).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    p, c = brute_force([r.text for r in rows if not held[r.doc_id]])
    texts, n, v = {r.doc_id: r.text for r in rows}, sum(c.values()), len(c)
    out = M.op1_language_model(spark, SF_SMALL).collect()
    assert len(out) == len(rows)
    for r in out:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *own], own)), rel=1e-5)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
