"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped
into memory by the workers that score.

Counting. Every task turns its texts into word hashes and counts pairs (previous word, word) in
blocks. A block's counts are sent as one compressed binary value per shard; the shard is set by the previous
word, so a shard can count its followers. Words so frequent that their followers would unbalance a shard
(seen in the first texts of every task: that decides where rows go and never what is counted) are dealt over
all shards by the follower. Each shard merges its blocks into ``pair-<shard>.npy`` (sorted hash of the
pair, count) and sends per-word statistics on, by ranges of the word hash, to ``word-<range>.npy``.

Files are written in the shared folder under a name of their own attempt and renamed, so a repeated task
replaces a file by an equal one. Workers map them read-only: memory holds the pages that are looked up.
The shared folder must be mounted on the workers (a path or ``file:``), as mapping needs.

Probability of word w after v, with c counts, N1+ numbers of distinct neighbours, D the modified discounts::

    p(w|v) = max(c(v,w) - D, 0) / c(v) + (D1 N1(v.) + D2 N2(v.) + D3 N3+(v.)) / c(v) * p(w)
    p(w)   = max(N1+(.w) - D', 0) / N1+(..) + (D1' n1' + D2' n2' + D3' n3') / N1+(..) / (V + 1)

After an unseen word it is p(w). The V known words and one unknown word sum to one in every context.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm.common import read, crc_part
from msgsieve.session import scratch_path

#: Words of a block that is counted at once; bytes of text that are scored at once.
BLOCK_WORDS = 2_500_000
SCORE_BYTES = 2_000_000
STATS = "n_words long, tokens double, pairs double, pair_1 double, pair_2 double, pair_3 double, pair_4 double, next_1 double, next_2 double, next_3 double, next_4 double"


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that hold for the whole model."""

    folder: str
    shards: int
    hot: tuple[int, ...]
    vocabulary: int
    tokens: int
    texts: int
    pairs: float
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float


def mounted(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("the model is memory-mapped: spark.checkpoint.dir must be a mounted path or file:")
    return path


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: sizes, then bytes; sorted uint64 arrays as differences."""
    raw = [np.array([len(a) for a in arrays], dtype=np.int64).tobytes()] + [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(value: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous words, words and tokens of each text; every text starts after START and closes with END."""
    words, counts = H.words(column)
    text_of = np.repeat(np.arange(len(counts)), counts)
    n = counts + 1
    token = np.full(int(n.sum()), H.END, dtype=H.U64)
    token[np.arange(len(words)) + text_of] = words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(n) - n] = H.START
    return before, token, n


def shard_of(before: np.ndarray, token: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    own = (before >> H.U64(20)) % H.U64(shards)
    if len(hot):
        spread = np.isin(before, hot)
        own[spread] = (token[spread] >> H.U64(20)) % H.U64(shards)
    return own.astype(np.uint16)


def range_of(word: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a word's own row: ranges of the hash, so that files follow each other in order."""
    return (((word >> H.U64(32)) * H.U64(shards)) >> H.U64(32)).astype(np.uint16)


def merged(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def count_pairs(before: np.ndarray, token: np.ndarray, shards: int, hot: np.ndarray):
    """One packed block per shard: distinct previous words, their numbers of followers, followers, counts."""
    known, ids = np.unique(np.concatenate([before, token]), return_inverse=True)
    ids = ids.astype(H.U64)
    keys = np.sort((ids[: len(before)] << H.U64(32)) | ids[len(before) :])
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys))).astype(np.uint32)
    keys = keys[first]
    left, right = known[(keys >> H.U64(32)).astype(np.int64)], known[(keys & H.U64(0xFFFFFFFF)).astype(np.int64)]
    shard = shard_of(left, right, shards, hot)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        at = order[cuts[s] : cuts[s + 1]]
        if len(at):
            own = left[at]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            followers = np.diff(np.append(new, len(own))).astype(np.uint32)
            yield s, pack(own[new], followers, right[at], count[at])


def save(path: str, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        draft = f"{path}.{name}.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            np.save(out, values)
        os.replace(draft, f"{path}.{name}.npy")


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; half a count where a tiny corpus gives none."""
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0
    return tuple(min(max(d, 0.0), k) for d, k in zip(raw, (1.0, 2.0, 3.0)))


def fit(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count ``docs`` and write the model's arrays; a null text counts as an empty one.

    ``shards`` (default: the session's shuffle partitions) should grow with the corpus: a shard's pairs
    are merged in one task. Repeated rows count as often as they occur. An empty table gives a model
    without words, under which every token has probability one.
    """
    spark = docs.sparkSession
    shards = min(int(shards or spark.conf.get("spark.sql.shuffle.partitions")), 65_000)
    folder = mounted(scratch_path(spark, "lm"))
    os.makedirs(folder)
    docs = docs.select(F.col(text).alias("text"))

    def usual(batches):
        """Of the first texts of a task the words that make up a good part, at most 8 x shards rows."""
        for batch in batches:
            for part in H.pieces(batch, "text", 500_000):
                token = sequences(part.column(0))[1]
                words, n = np.unique(token, return_counts=True)
                large = n * 8 * shards > len(token)
                yield pa.RecordBatch.from_pydict({"word": words[large].view(np.int64), "share": n[large] / len(token)})
                break
            break

    tasks = docs.mapInArrow(usual, "word long, share double")
    mean = tasks.groupBy("word").agg(F.sum("share").alias("sum")).where(F.col("sum") * 4 * shards > docs.rdd.getNumPartitions())
    frequent = mean.select("word").collect()  # words of a mean share over 1 / (4 x shards): at most 4 x shards
    hot = np.array([r[0] for r in frequent], dtype=np.int64).view(H.U64)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in H.pieces(batch, "text"):
                before, token, _ = sequences(part.column(0))
                held.append((before, token))
                size += len(token)
                if size >= BLOCK_WORDS:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    def blocks(held):
        rows = list(count_pairs(np.concatenate([b for b, _ in held]), np.concatenate([t for _, t in held]), shards, hot))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "value"]
        )

    def merge(key, frame):
        s = int(key[0])
        left, right, n = [], [], []
        for value in frame["value"]:
            own, followers, r, c = unpack(value, [np.uint64, np.uint32, np.uint64, np.uint32])
            left.append(np.repeat(own, followers))
            right.append(r)
            n.append(c.astype(np.float64))
        left, right, n = np.concatenate(left), np.concatenate(right), np.concatenate(n)
        pair = H.pair_hash(left, right)
        order = np.argsort(pair)
        pair, left, right, n = pair[order], left[order], right[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, left, right, n = pair[first], left[first], right[first], np.add.reduceat(n, first)
        save(f"{folder}/pair-{s}", key=pair, n=n.astype(np.float32))
        small = [(n == k).astype(np.float64) for k in (1, 2)]
        words, c, n1, n2, n3 = merged(left, n, *small, (n >= 3).astype(np.float64))
        later, preceded = merged(right, np.ones(len(right)))
        to, to_later = range_of(words, shards), range_of(later, shards)
        cut = np.searchsorted(to, np.arange(shards + 1))
        cut_later = np.searchsorted(to_later, np.arange(shards + 1))
        rows, tallies = [], [float((n == k).sum()) for k in (1, 2, 3, 4)]
        for t in range(shards):
            a, b, e, f = cut[t], cut[t + 1], cut_later[t], cut_later[t + 1]
            if b > a or f > e:
                small = [x[a:b].astype(np.float32) for x in (n1, n2, n3)]
                rows.append((t, pack(words[a:b], c[a:b], *small, later[e:f], preceded[e:f].astype(np.float32)), *tallies))
                tallies = [0.0] * 4
        return pa.Table.from_arrays(
            [pa.array(x) for x in zip(*rows)], ["shard", "value", "p1", "p2", "p3", "p4"]
        ).cast(pa.schema([("shard", pa.int32()), ("value", pa.binary()), *((f"p{k}", pa.float64()) for k in (1, 2, 3, 4))]))

    def words_of(key, frame):
        got = [unpack(v, [np.uint64, np.float64, *[np.float32] * 3, np.uint64, np.float32]) for v in frame["value"]]
        none = lambda x: np.zeros(len(x))
        keys = np.concatenate([x for g in got for x in (g[0], g[5])])
        columns = [np.concatenate([x for g in got for x in (g[j].astype(np.float64), none(g[5]))]) for j in (1, 2, 3, 4)]
        columns.append(np.concatenate([x for g in got for x in (none(g[0]), g[6].astype(np.float64))]))
        word, c, n1, n2, n3, preceded = merged(keys, *columns)
        # END is no context: it is counted by how often it follows. START is a context and no word.
        save(
            f"{folder}/word-{int(key[0])}",
            key=word, n=c, n1=n1.astype(np.float32), n2=n2.astype(np.float32), n3=n3.astype(np.float32), before=preceded.astype(np.float32),
        )
        is_word = preceded > 0
        row = [int(is_word.sum()), float(c[is_word].sum()), float(preceded.sum())]
        row += [float(frame[f"p{k}"].sum()) for k in (1, 2, 3, 4)]
        row += [float((preceded == k).sum()) for k in (1, 2, 3, 4)]
        return pa.Table.from_arrays([pa.array([x]) for x in row], [f.split()[0] for f in STATS.split(", ")])

    def pandas_free(fn):
        def run(key, table):
            columns = {name: table.column(name).to_numpy(zero_copy_only=False) for name in table.column_names}
            return fn([k.as_py() for k in key], columns)

        return run

    blocks_table = docs.mapInArrow(count, "shard int, value binary")
    per_word = blocks_table.groupBy("shard").applyInArrow(
        pandas_free(merge), "shard int, value binary, p1 double, p2 double, p3 double, p4 double"
    )
    stats = per_word.groupBy("shard").applyInArrow(pandas_free(words_of), STATS)
    total = stats.agg(*[F.sum(c).alias(c) for c in stats.columns], F.count(F.lit(1)).alias("rows")).first()
    n = {k: float(total[k] or 0) for k in stats.columns}
    texts = docs.count()
    d, e = discounts(*(n[f"pair_{k}"] for k in (1, 2, 3, 4))), discounts(*(n[f"next_{k}"] for k in (1, 2, 3, 4)))
    many = n["n_words"] - n["next_1"] - n["next_2"]
    rest = (e[0] * n["next_1"] + e[1] * n["next_2"] + e[2] * many) / n["pairs"] if n["pairs"] else 1.0
    # Each word is counted as a context; END, which is none, once for each text.
    return Model(folder, shards, tuple(int(h) for h in hot), int(n["n_words"]), int(n["tokens"]) + texts, texts, n["pairs"], d, e, rest)


class Arrays:
    """The mapped arrays, opened when first looked up."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def array(self, kind: str, shard: int, name: str):
        key = kind, shard, name
        if key not in self.open:
            path = f"{self.model.folder}/{kind}-{shard}.{name}.npy"
            self.open[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64 if name == "key" else np.float64)
        return self.open[key]

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, names: list[str]) -> list[np.ndarray]:
        """Values of ``keys``, each in its shard; 0 where there is none."""
        out = [np.zeros(len(keys)) for _ in names]
        order = np.lexsort((keys, shard)) if kind == "pair" else np.arange(len(keys))
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in range(self.model.shards):
            at = order[cuts[s] : cuts[s + 1]]
            stored = self.array(kind, s, "key")
            if not len(at) or not len(stored):
                continue
            place = np.minimum(np.searchsorted(stored, keys[at]), len(stored) - 1)
            found = stored[place] == keys[at]
            at, place = at[found], place[found]
            for values, name in zip(out, names):
                values[at] = self.array(kind, s, name)[place]
        return out


def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.where(n > 2, d[2], np.where(n > 1, d[1], d[0])), 0.0)


def probabilities(model: Model, arrays: Arrays, before: np.ndarray, token: np.ndarray):
    """For each token: its training count and the model's probability of it after ``before``."""
    words, ids = np.unique(np.concatenate([before, token]), return_inverse=True)
    c, n1, n2, n3, preceded = arrays.find("word", range_of(words, model.shards), words, ["n", "n1", "n2", "n3", "before"])
    d, total = model.discounts, np.maximum(c, 1.0)
    back = np.where(c > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / total, 1.0)
    p_word = discounted(preceded, model.word_discounts) / max(model.pairs, 1.0) + model.word_rest / (model.vocabulary + 1)
    left, right = ids[: len(before)], ids[len(before) :]
    pairs, place = np.unique((left.astype(np.uint64) << H.U64(32)) | right.astype(np.uint64), return_inverse=True)
    a, b = (pairs >> H.U64(32)).astype(np.int64), (pairs & H.U64(0xFFFFFFFF)).astype(np.int64)
    shard = shard_of(words[a], words[b], model.shards, np.array(model.hot, dtype=H.U64))
    (n,) = arrays.find("pair", shard, H.pair_hash(words[a], words[b]), ["n"])
    p = discounted(n, d) / total[a] + back[a] * p_word[b]
    is_end = words == H.END
    counted = np.where(preceded > 0, c, 0.0)
    counted[is_end] = model.texts
    return counted[right], p[place]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` with ``n_tokens, n_known, train_tokens, base_score, score``.

    Logarithms are to base ten. A null or empty text has one token, its end.
    """
    keep = list(keep)
    source = docs.select(*keep, F.col(text).alias("_text"))
    made = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", " + made

    def run(batches):
        arrays = Arrays(model)
        for batch in batches:
            for part in H.pieces(batch, "_text", SCORE_BYTES):
                before, token, n = sequences(part.column(len(keep)))
                count, p = probabilities(model, arrays, before, token)
                first = np.cumsum(n) - n
                total = model.tokens + model.vocabulary + 1
                sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / total), np.log10(p))]
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), model.tokens)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return source.mapInArrow(run, schema)


def op1_language_model(spark, sf_dir):
    """Score every document; train on those whose crc32(doc_id) mod 7 is not 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_part("doc_id", 7) == 2)
    return score(docs, fit(docs.where(~F.col("held_out"))), keep=["doc_id", "held_out"])
