import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL

from msgsieve.llm import common, packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", None, "it's I'll!!", "a<|endoftext|>. b <|ENDOFTEXT|>", "Straße–. été.. naïve", "x .,; y...z", ".", "é á.",
    "日本語. テスト!", " nb sp.", "we'd.", "A1b2.c3", "don't.'", "\x1cab\x1f.", "😀 ok!", "İstanbul. ΣΑΣ.", "'s 'S ca't",
]


def direct(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("texts", [ODD, [t for t in ODD if not t or "<|" not in t], [t or "" for t in reversed(ODD)]])
def test_ids_are_the_tokenizers(texts):
    ids, counts = P.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts)


@pytest.mark.parametrize("remembered", [0, 40, 1_000_000])
def test_ids_stay_right_as_words_are_remembered_and_forgotten(monkeypatch, remembered):
    monkeypatch.setattr(P, "REMEMBERED", remembered)
    encoder, rnd = P.WordEncoder(PATH), random.Random(3)
    words = [w for t in ODD if t for w in t.split()] + [f"{a}{b}" for a in ("ba", "Ko", "été", "x9") for b in ("nu", "LIM.", "s!?", "ør")]
    for _ in range(30):
        texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(3)]
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts)


def test_a_remembered_word_takes_few_bytes():
    encoder, n = P.WordEncoder(PATH), 40_000
    letters = "bcdfghklmnprstvz"
    texts = ["".join(letters[(i >> s) & 15] + "aeio"[(i >> s) & 3] for s in (0, 4, 8, 12)) for i in range(n)]
    assert len(set(texts)) == n
    column = pa.array([" ".join(texts)])
    P.WordEncoder(PATH).encode(column)  # what is loaded and kept once, whatever the number of words
    tracemalloc.start()
    encoder.encode(column)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 60 * n


def test_a_worker_gives_memory_back_at_the_end_of_a_partition(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    seen = []
    for x in common.frugal(lambda batches: (2 * b for b in batches))([1, 2]):
        assert not given
        seen.append(x)
    assert seen == [2, 4] and given == [1]


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, rnd.choice([10, 60, 100])) for _ in range(rnd.randint(1, 400))]
    histogram = Counter(lengths)
    sequences, ranks = {}, {n: [] for n in histogram}
    rows = P.plan(histogram, 100)
    for n in histogram:
        own = sorted(r for r in rows if r[0] == n)
        ends = [r[1] for r in own[1:]] + [histogram[n]]
        for (_, first, times, sequence, offset), end in zip(own, ends):
            assert (end - first) % times == 0
            for rank in range(first, end):
                step, place = divmod(rank - first, times)
                sequences.setdefault(sequence + step, []).append((offset + place * n, n))
                ranks[n].append(rank)
    assert all(sorted(ranks[n]) == list(range(k)) for n, k in histogram.items())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert len(sequences) == best_fit_decreasing(lengths, 100)


def test_query_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = dict(zip(texts, direct(texts.values())))
    rows = P.op6_packing(spark, SF_SMALL).collect()
    sequences = {}
    for r in rows:
        whole = [*ids[r.doc_id], 0]
        own = whole[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length and (r.length == 2048 or r.start + r.length == len(whole))
        assert zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(r.doc_id for r in rows) == {d: -(-(len(x) + 1) // 2048) for d, x in ids.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(sequences) == best_fit_decreasing([r.length for r in rows], 2048)


def test_edges(spark):
    kind = "doc_id long, text string, length string, piece string"
    none = spark.createDataFrame([], kind)
    assert P.packed(P.tokenized(none, PATH, ["doc_id"]), ["doc_id"]).count() == 0
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (None, "", "x", "y"), (2, "ab " * 5000, "x", "y")]
    docs = spark.createDataFrame(rows, kind)
    got = P.packed(P.written(P.tokenized(docs, PATH, ["doc_id"]), "t"), ["doc_id", "piece", "start"]).collect()
    assert sorted(r.length for r in got) == [1, 1, 1, 905, 2048, 2048]
    assert len({(r.sequence_id, r.offset) for r in got}) == 6
