import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import SF_SMALL

from compare import compare, connect
from msgsieve.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    forms, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w, form in forms.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        yield w, form, root, n[w], len(near[w]), n[form] if form else None


def run(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    out = S.op12_spelling(spark, str(path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(repr, map(tuple, out)))


def invented(seed, n_docs=300):
    rnd = random.Random(seed)
    letters = "aeinrstéÉ×÷"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(60)]

    def word():
        w = base[min(int(rnd.expovariate(0.1)), 59)]
        if rnd.random() < 0.3:
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]])
        return w.upper() if rnd.random() < 0.1 and w.isascii() else w

    return [(rnd.choice([k, k, None]), rnd.choice([" ", "1", ", "]).join(word() for _ in range(40))) for k in range(n_docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_all_pairs(spark, tmp_path, seed):
    rows = invented(seed)
    want = sorted(map(repr, brute(brute_words(rows))))
    assert len(want) > 100 and run(spark, rows, tmp_path) == want


@pytest.mark.parametrize("classes", [1, 2, 3, 5])
def test_blocks_lose_no_pair(spark, tmp_path, monkeypatch, classes):
    monkeypatch.setattr(S, "PART_WORDS", 7)
    monkeypatch.setattr(S, "TASK_PAIRS", 1000)
    n = brute_words(invented(5))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = Counter((r.word, r.near) for r in S.variants(words, classes).collect())
    assert got == Counter((a, b) for a in n for b in n if one_edit(a, b))


def test_product_of_long_words():
    a = ["ab" * 3000, "ab" * 2999 + "aa", "ba" * 3000]
    i, j = S.near_pairs(a, a, True)
    assert list(zip(i, j)) == [(0, 1)]
    b = ["ab" * 1000 + "x" + "ab" * 2000, "ab" * 3000 + "b"]
    i, j = S.near_pairs(a, b, False)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1)]


def test_carried_crc():
    prefixes = [b"1:", b"", b"-77:"]
    words = [b"", b"a", b"hello", "é".encode() * 200, b"x" * 1000]
    which = np.array([k for k in range(3) for _ in words])
    both = words * 3
    got = S.crc_after(
        np.array([crc32(p) for p in prefixes], np.uint32), which, np.array([len(w) for w in both]), np.array([crc32(w) for w in both], np.uint32)
    )
    assert got.tolist() == [crc32(prefixes[k] + w) for k, w in zip(which, both)]


def test_chain_of_forms_and_ties(spark, tmp_path):
    text = ["chaine" * 1] * 5 + ["chained"] * 25 + ["chainedd"] * 130 + ["chainef"] * 25
    rows = [(k, w) for k, w in enumerate(text)]
    assert run(spark, rows, tmp_path) == sorted(map(repr, brute(brute_words(rows))))


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "Letters letters " * 10), (5, "q" * 200_000), (5, "LETTERSx " * 9)]
    rows += [(9, "m" * 5000)] * 6 + [(10, "m" * 4999 + "n")] * 5
    assert run(spark, rows, tmp_path / "a") == sorted(map(repr, brute(brute_words(rows))))
    assert run(spark, rows[:3], tmp_path / "b") == []
    assert run(spark, [(4, "oneword " * 5)], tmp_path / "c") == sorted(map(repr, brute(brute_words([(4, "oneword " * 5)]))))


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF_SMALL), SF_SMALL, "op12_spelling", S.op12_spelling, S.ORACLE_SQL) == ""
