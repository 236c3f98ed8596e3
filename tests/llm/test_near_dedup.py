import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF
from msgsieve.llm import hashing as H
from msgsieve.llm import near_dedup as N


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute_force(ids, texts, k, percent):
    sets, up = shingle_sets(texts, k), list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        near = set()
        for e in s:
            near.update(holders.setdefault(e, []))
            holders[e].append(i)
        for j in near:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                up[top(i)] = top(j)
    least = {}
    for i, name in enumerate(ids):
        least[top(i)] = min(least.get(top(i), name), name)
    return {name: (len(sets[i]), least[top(i)]) for i, name in enumerate(ids)}


def test_shingles_are_those_of_the_words():
    texts = ["a b c d", "A b", "", None, "a b c d a b c d", "é\x0bx  y\n", " \t"]
    got = H.shingles(*H.words(pa.array(texts, pa.string())), 3)
    assert [len(s) for s in got] == [len(s) for s in shingle_sets(texts, 3)]
    same = H.shingles(*H.words(pa.array(["X Y Z", "x y z", "x y", "x", "x y z z"])), 3)
    assert same[0].tolist() == same[1].tolist() and len({s.tobytes() for s in same}) == 4


@pytest.mark.parametrize("n", [1, 5, 60, 900])
def test_sketch_estimates_similarity(n):
    rng = np.random.default_rng(n)
    near = []
    for _ in range(30):
        both = rng.integers(0, 2**63, size=n + 2 * max(1, n // 10), dtype=np.uint64)
        extra = max(1, n // 10)
        a, b = np.unique(both[: n + extra]), np.unique(np.concatenate([both[:n], both[n + extra :]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near.append((N.sketch(a) == N.sketch(b)).mean() - j)
    assert abs(np.mean(near)) < 0.03 and np.std(near) < 0.08
    assert (N.sketch(a) == N.sketch(a.copy())).all() and (N.sketch(a) > 0).all()


def test_groups_equal_brute_force(spark):
    """A hot group of copies, near copies of all degrees, short texts, repeated words."""
    rnd = random.Random(7)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    texts = [" ".join(base)] * 60
    for _ in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(len(own))] = rnd.choice(["x", "y", f"z{rnd.randint(0, 99)}"])
        texts.append(" ".join(own))
    texts += ["a", "A", "a b", "a b c", "a b c d", "", None, " ", "same same same same", "same " * 50]
    texts += [" ".join(f"v{rnd.randint(0, 30)}" for _ in range(rnd.randint(1, 30))) for _ in range(80)]
    rows = [(3 * i + 1, t, "e") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    for k, percent in ((3, 85), (5, 80)):
        want = brute_force([r[0] for r in rows], [r[1] for r in rows], k, percent)
        got = N.near_duplicates(docs, shingle=k, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "BLOCK_BYTES", 2000)
    test_groups_equal_brute_force(spark)


def test_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, None), (5, text), (5, text), (5, "entirely other words than those before it"), (9, text)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "component_id").collect()), key=str) == sorted(
        [(None, None), (None, None), (5, 5), (5, 5), (5, 5), (9, 5)], key=str
    )
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_force([r.doc_id for r in rows], [r.text for r in rows], 3, 85)
    got = N.op3_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shared_sizes_send_a_shingle_of_a_piece_once(spark):
    nodes = np.array([7, 3, 3, 9], dtype=np.int64)
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 2**63], [2, 5], [5, 6], [])]
    shingles, least, most = N.held_by(nodes, sets)
    got = {s: (a, b) for s, a, b in zip(shingles.view(np.uint64).tolist(), least.tolist(), most.tolist())}
    assert len(shingles) == 5 and got == {1: (7, 7), 2: (3, 7), 5: (3, 3), 6: (3, 3), 2**63: (7, 7)}
    assert [len(x) for x in N.held_by(nodes[3:], sets[3:])] == [0, 0, 0]
    texts = [(1, "a b c d"), (2, "a b c e"), (2, "a b c e f"), (4, None), (5, "x y z x y z")]
    for parts in (1, 5):
        rows = N.shared_sizes(spark.createDataFrame(texts, "node long, text string").repartition(parts), 3).collect()
        assert {r.node: r.own for r in rows} == {1: 1, 2: 2, 5: 3}
