import random

from conftest import SF_SMALL
from msgsieve.llm import line_dedup as L


def sentences(seed, n, size=8):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(size)).capitalize() + "." for _ in range(n)]


def text(seed, n=10):
    return " ".join(sentences(seed, n))


PASSAGE = text("p", 8)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    return {r.doc_id: r for r in L.without_repeats(docs, **options).collect()}


def test_passage_is_cut_from_all_but_the_first(spark):
    rows = [
        (1, text(1) + " before it " + PASSAGE + " and on " + text(2), "x"),
        (2, text(3) + "\n" + PASSAGE + "\n" + text(4), "x"),
        (3, text(5) + " no stop here " + PASSAGE, "x"),
        (4, PASSAGE, "x"),
        (5, text(6), "x"),
    ] + [(10 + i, text(100 + i) + " glued " + PASSAGE, "x") for i in range(30)]
    got = run(spark, rows)
    before = {r[0]: r[1] for r in rows}
    assert got[1].text == before[1] and got[1].words_before is None
    assert got[5].text == before[5]
    assert got[2].text == text(3) + "\n" + text(4) and got[2].words_before == 224
    assert got[3].text == text(5) + " no stop here"
    assert got[4].text == ""
    assert all(got[10 + i].text == text(100 + i) + " glued" for i in range(30))


def test_common_lines_stay(spark):
    rows = [(i, "All rights are reserved by us. " + text(i, 6), "x") for i in range(40)]
    assert {i: r.text for i, r in run(spark, rows).items()} == {i: t for i, t, _ in rows}


def test_blocks_from_several_documents_and_spared_copies(spark):
    a, b = text("a"), text("b")
    rows = [(1, a, "x"), (2, b, "x"), (3, text("c") + " " + a + " " + b + " " + text("d"), "x"), (4, a, "x")]
    got = run(spark, rows)
    assert got[3].text == text("c") + " " + text("d") and got[4].text == ""
    assert run(spark, rows, spare=0.75)[4].text == a


def test_patience():
    assert L.longest_chain([3, 0, 1, 5, 2, 4]) == [1, 2, 4, 5]
    assert L.patience([]) == []
    # swapped: the blocks that run forward are one alignment, the other one is the next
    assert L.patience([3, 0, 1, 2]) == [[1, 2, 3], [0]]
    # repeated blocks are no anchors and are aligned after those that occur once
    assert L.patience([7, 0, 7, 9]) == [[1, 3], [0], [2]]
    assert L.patience([5, 5]) == [[0], [1]]
    rnd = random.Random(3)
    for _ in range(200):
        there = [rnd.randint(0, 20) for _ in range(rnd.randint(1, 25))]
        chains = L.patience(there)
        assert sorted(k for c in chains for k in c) == list(range(len(there)))
        assert all(there[x] < there[y] and x < y for c in chains for x, y in zip(c, c[1:]))


def plain(rows, size):
    """The rule written plainly: what is left of each text, as words.

    Earlier documents come in the order of their ids; a word that stands in a common run of ``size`` words goes, but
    for fewer than four words at an end of a block that an earlier holder of the next ones does not have.
    """
    seen: dict = {}
    out = {}
    for i, text in sorted(rows):
        words = (text or "").split()
        low = [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in words]
        windows = [tuple(low[k : k + size]) for k in range(len(low) - size + 1)]
        first = [seen.get(w, i) for w in windows]
        held = [k for k, a in enumerate(first) if a < i]
        groups: list = []
        for k in held:
            if groups and k - groups[-1][-1] <= size:
                groups[-1].append(k)
            else:
                groups.append([k])
        gone: set = set()
        for group in groups:
            drop: set = set()
            for side in (group, group[::-1]):
                for n, k in enumerate(side[1 : L.MIN_LINE], 1):
                    if abs(k - side[0]) >= L.MIN_LINE:
                        break
                    if first[k] < first[side[0]]:
                        drop.update(side[:n])
                        break
            gone.update(w for k in group if k not in drop for w in range(k, k + size))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
        for w in windows:
            seen.setdefault(w, i)
    return out


def test_query_equals_the_plain_rule(spark):
    path = SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows, L.MIN_WORDS)
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text or "").split() for r in L.without_repeats(docs).collect()}
    assert got == want
    assert sum(map(len, want.values())) < sum(len((t or "").split()) for _, t in rows)
    before = {i: len((t or "").split()) for i, t in rows}
    assert {r.doc_id: (r.words_deleted, r.n_words) for r in L.op10_line_dedup(spark, path).collect()} == {
        i: (before[i] - len(w), len(w)) for i, w in want.items()
    }


def test_hot_keys_are_dealt(spark):
    own = [text(1000 + i, 2) + f" own{i}" for i in range(2500)]  # no chance repeats next to the passage
    rows = [(i, own[i] + (" glued " if i else " first ") + PASSAGE + f" tail{i}", "x") for i in range(2500)]
    got = run(spark, rows)
    assert got[0].text == rows[0][1]
    assert all(got[i].text == own[i] + f" glued tail{i}" for i in range(1, 2500))


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, PASSAGE, "x"), (5, PASSAGE, "x"), (5, PASSAGE, "x"), (6, "A. B!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = L.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "spans", "words_before"]
    assert sorted(map(str, (r[:3] for r in got.collect()))) == sorted(map(str, rows))
    assert L.without_repeats(docs.limit(0)).count() == 0
    long = " ".join(sentences("l", 4000))
    got = run(spark, [(1, long, "x"), (2, "start. " + long, "x")])
    assert got[2].text == "start."


def test_query_keeps_every_document(spark):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    rows = L.op10_line_dedup(spark, SF_SMALL).collect()
    assert len(rows) == n and any(r.words_deleted for r in rows) and all(r.words_deleted >= 0 for r in rows)


def unstopped(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(n))


def test_passages_without_whole_lines(spark):
    p, shouts = unstopped("p", 50), " ".join(f"{w.upper()}!!" for w in unstopped("s", 60).split())
    rows = [
        (1, unstopped(1, 30) + " " + p + " " + unstopped(2, 30), "x"),
        (2, unstopped(3, 30) + " " + p + " " + unstopped(4, 30) + ".", "x"),
        (3, shouts, "x"),
        (4, "one two " + shouts, "x"),
        (5, unstopped(5, 20) + " " + " ".join(p.split()[5:45]), "x"),
        (6, unstopped(6, 20) + " " + " ".join(p.split()[5:44]), "x"),
    ]
    got = run(spark, rows)
    assert got[2].text == unstopped(3, 30) + " " + unstopped(4, 30) + "."
    assert got[4].text == "one two" and got[5].text == unstopped(5, 20)
    assert got[6].text == rows[5][1]


def test_a_passage_whose_parts_have_other_first_holders(spark):
    lines = sentences("parts", 8)
    passage = " ".join(lines)
    rows = [
        (1, text(1) + " " + " ".join(lines[:4]), "x"),
        (2, " ".join(lines[4:]) + " " + text(2), "x"),
        (3, text(3) + " " + passage, "x"),
        (4, passage + " " + text(4), "x"),
    ]
    got = run(spark, rows)
    assert got[3].text == rows[2][1] and got[4].text == text(4)
    scattered = [(i, text(20 + i) + " " + lines[i], "x") for i in range(8)]
    got = run(spark, [*scattered, (8, text(3) + " " + passage, "x"), (9, passage + " " + text(4), "x")])
    assert got[8].text.endswith(passage) and got[9].text == text(4)


def test_repeated_and_swapped_passages(spark):
    p, q = text("p", 7), text("q", 7)
    rows = [
        (1, text(1) + " " + p + " " + text(2) + " " + q, "x"),
        (2, text(3) + " " + p + " " + text(4) + " " + p + " " + text(5), "x"),
        (3, text(6) + " " + q + " " + text(7) + " " + p + " " + text(8), "x"),
        (4, text("r", 7) + " " + text(9) + " " + text("r", 7), "x"),
        (5, text(10) + " " + text("r", 7) + " " + text(11), "x"),
    ]
    got = run(spark, rows)
    assert got[2].text == " ".join(text(i) for i in (3, 4, 5))
    assert got[3].text == " ".join(text(i) for i in (6, 7, 8))
    assert got[4].text == rows[3][1] and got[5].text == text(10) + " " + text(11)


def test_no_block_is_left_twice(spark):
    rnd = random.Random(11)
    stock = [unstopped(f"stock{i}", rnd.randint(3, 30)).split() for i in range(25)]
    runs = lambda i, k: [w for _ in range(rnd.randint(1, 3)) for w in rnd.choice(stock)] + [f"own{i}x{k}"]
    rows = [(i, " ".join(w for k in range(6) for w in runs(i, k)), "x") for i in range(40)]
    got = run(spark, rows, min_words=20)
    seen: set = set()
    for i, before, _ in rows:
        own, left = before.split(), got[i].text.split()
        windows = {tuple(own[k : k + 20]) for k in range(len(own) - 19)}
        kept = {tuple(left[k : k + 20]) for k in range(len(left) - 19)}
        assert not kept & windows & seen
        if not windows & seen:
            assert got[i].text == before
        seen |= windows
