import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from conftest import SF, SF_SMALL
from msgsieve.llm import quality_rules as Q


def base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def classes(text):
    out = Counter()
    for c in text or "":
        out[next((k for k, p in Q.CLASSES.items() if re.fullmatch(p.replace(r"\p{L}", r"[^\W\d_]"), c)), "rest")] += 1
    return [out[k] for k in [*Q.CLASSES, "rest"]]


def jensen_shannon(a, b):
    a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
    kl = lambda p, m: sum(x * math.log2(x / y) for x, y in zip(p, m) if x)
    middle = [(x + y) / 2 for x, y in zip(a, b)]
    return math.sqrt(max(0.0, (kl(a, middle) + kl(b, middle)) / 2))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r.doc_id: base(r.text) for r in docs}
    failed = {i: n < 20 or 100 * k > 30 * n for i, (n, _, _, _, k) in want.items()}
    sums: dict = {}
    for r in docs:
        if not failed[r.doc_id]:
            words = Counter(w.decode() for w in r.text.encode().split())
            own = [words[w] for w in Q.COMMON[r.lang]]
            for name, counts in (("classes", classes(r.text)), ("words", [*own, sum(words.values()) - sum(own)])):
                held = sums.setdefault((r.lang, name), [0] * len(counts))
                sums[r.lang, name] = [x + y for x, y in zip(held, counts)]
    got = {r.doc_id: r for r in Q.op7_quality_rules(spark, SF_SMALL).collect()}
    assert set(got) == set(want)
    for r in docs:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want[r.doc_id]
        assert g.base_failed == failed[r.doc_id]
        words = Counter(w.decode() for w in r.text.encode().split())
        own = [words[w] for w in Q.COMMON[r.lang]]
        far = {
            "classes": jensen_shannon(classes(r.text), sums[r.lang, "classes"]) if sum(classes(r.text)) >= Q.LEAST["classes"] else None,
            "words": jensen_shannon([*own, sum(words.values()) - sum(own)], sums[r.lang, "words"]) if sum(words.values()) >= Q.LEAST["words"] else None,
        }
        assert g.classes_distance == (None if far["classes"] is None else pytest.approx(far["classes"], abs=2e-6))
        assert g.words_distance == (None if far["words"] is None else pytest.approx(far["words"], abs=2e-6))
        assert g.kept == (not failed[r.doc_id] and all(far[k] is None or far[k] <= Q.MOST[k] for k in far))


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF), SF, "op7_quality_rules", Q.op7_quality_rules, Q.ORACLE_SQL) == ""


def test_query_runs_no_python(spark):
    plan = Q.op7_quality_rules(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_edges(spark):
    same = "a b c d e f g h i j "
    texts = [None, "", " \n\t", "one", same * 3, same + "x", "é" * 50 + "\x0b" + "x y\n\nx y\nx y", "a " * 30_000, "# | <b>\r\n", same * 3]
    rows = [(i, t, [None, "en", "tlh"][i % 3], "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, _hash int")
    counts = Q.counted(docs).cache()
    got = {r.doc_id: r for r in Q.judged(counts).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == base(t), t
        assert got[i].classes == classes(t)
        assert got[i].kept is not None
    assert Q.judged(Q.counted(docs.limit(0))).count() == 0
    assert Q.judged(Q.counted(docs.withColumn("doc_id", F.lit(None).cast("long")))).count() == len(texts)
