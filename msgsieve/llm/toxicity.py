"""Toxicity by a classifier chain: one linear model for each category, each fed with the probabilities of
the categories before it.

Features are the presence of telling terms and a few shares of characters. Terms are words and, so that a model
knows a word's other forms, beginnings of words. Telling ones are those whose document frequency differs
most between a category and the rest, by its z-score, over the labelled sample. Every
model of the chain is a logistic regression. For training, the probability of an earlier category comes
from a model that has not seen the row (out of fold); for prediction, from the model of all rows, so the
later models learn how far the earlier ones can be trusted.

The sample of labelled rows is bounded by ``SAMPLE``, drawn by the hash of the id; its features, a few dozen
numbers a row, are all that reaches the driver, where the models are fitted. Every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm import linear
from msgsieve.llm.common import frugal, read, written

SAMPLE = 20_000
TERMS_PER_CATEGORY = 256
#: Bytes of a word's beginning that make a term, for words that go on.
BEGINNINGS = (4, 5, 6, 7)
LEAST_Z = 4.0
LEAST_TEXTS = 5
FOLDS = 3
PENALTY = 5e-4
THRESHOLD = 0.5

_TERM = np.zeros(256, dtype=bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_SHARES = np.zeros((6, 256))
_SHARES[0, 65:91] = _SHARES[1, 97:123] = _SHARES[2, 48:58] = _SHARES[3, 128:] = 1
_SHARES[4, [ord(c) for c in "#*$%&|<>{}[]\\^~_=+@"]] = 1
_SHARES[5, [ord(c) for c in "!?"]] = 1


@dataclass(frozen=True)
class Chain:
    """Categories in order, the telling terms, and for each category an intercept and weights of
    words, shares and earlier probabilities; a category that was never or always seen is a constant."""

    categories: tuple[str, ...]
    words: np.ndarray
    intercepts: tuple[float, ...]
    weights: tuple[np.ndarray, ...]


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of runs of letters and digits, lower-cased, and the row of each."""
    data, offsets = H.buffers(column)
    starts, ends, counts = H.runs(data, offsets, _TERM)
    rows = np.repeat(np.arange(len(counts)), counts)
    found, of = [H.run_hashes(data, starts, ends, H._BYTE)], [rows]
    for n in BEGINNINGS:
        longer = ends - starts > n
        found.append(H.mix64(H.run_hashes(data, starts[longer], starts[longer] + n, H._BYTE) + H.U64(n)))
        of.append(rows[longer])
    return np.concatenate(found), np.concatenate(of)


def shares(column: pa.Array) -> np.ndarray:
    """For each text the shares of upper-case, lower-case, digit, non-ASCII, symbol and ``!?`` bytes."""
    data, offsets = H.buffers(column)
    out = np.zeros((len(column), len(_SHARES)))
    for i in range(len(column)):
        own = data[offsets[i] : offsets[i + 1]]
        if len(own):
            out[i] = _SHARES @ np.bincount(own, minlength=256) / len(own)
    return out


def features(column: pa.Array, words: np.ndarray) -> np.ndarray:
    """A row of 0/1 for each telling word and the shares, for each text."""
    found, rows = terms(column)
    out = np.zeros((len(column), len(words) + len(_SHARES)))
    if len(words) and len(found):
        at = np.minimum(np.searchsorted(words, found), len(words) - 1)
        hit = words[at] == found
        out[rows[hit], at[hit]] = 1.0
    out[:, len(words) :] = shares(column)
    return out


def telling_terms(sample: DataFrame, categories: list[str]) -> np.ndarray:
    """Sorted hashes of the terms that tell each category best; at most TERMS_PER_CATEGORY for each."""

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "_text"):
                found, rows = terms(part.column(0))
                order = np.lexsort((found, rows))
                found, rows = found[order], rows[order]
                new = np.concatenate([[True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]) if len(found) else np.zeros(0, bool)
                at = pa.array(rows[new])
                own = [part.column(1 + i).take(at) for i in range(len(categories))]
                yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), *own], ["word", *categories])

    seen = sample.select("_text", *categories).mapInArrow(run, ", ".join(["word long", *(f"`{c}` int" for c in categories)]))
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories])
    counts = written(counts.where(F.col("n") >= LEAST_TEXTS), "term-counts")
    chosen = set()
    for c in categories:
        n, k = totals["n"] or 0, totals[c] or 0
        if not 0 < k < n:
            continue
        share = F.lit(k / n)
        z = F.abs(F.col(c) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        best = counts.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(TERMS_PER_CATEGORY)
        chosen |= {r["word"] for r in best.collect()}
    return np.sort(np.array(sorted(chosen), dtype=np.int64).view(H.U64))


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text: str, size: int) -> DataFrame:
    """``_fold, _text`` and 0/1 columns for at most ``size`` labelled documents.

    A document labelled more than once has a category if any of its labels says so; a label that is
    null counts as 0.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in categories]
    )
    drawn = written(known.orderBy(F.xxhash64(id_col), id_col).limit(size), "labels-drawn").select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{c}") for c in categories]
    )
    # at most ``size`` rows of an id and a few small numbers
    rows = docs.select(F.col(id_col), F.col(text).alias("_text")).join(F.broadcast(drawn), F.col(id_col) == F.col("_id"))
    fold = F.pmod(F.xxhash64("_text"), F.lit(FOLDS))  # copies share a fold
    return written(
        rows.select(fold.alias("_fold"), "_text", *[F.col(f"_{c}").alias(c) for c in categories]), "labelled"
    )


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> Chain:
    """Learn the chain from 0/1 columns ``categories`` of ``labels``, in this order.

    A category that no row or every row of the sample has becomes a constant probability of 0 or 1;
    without any labelled row every category is 0.
    """
    rows = labelled_sample(docs, labels, categories, id_col, text, sample)
    words = telling_terms(rows, categories)

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "_text"):
                x = features(part.column(1), words)
                at = [np.flatnonzero(row).astype(np.int32) for row in x]
                value = [row[i].astype(np.float32) for row, i in zip(x, at)]
                columns = [part.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], ["_fold", "_at", "_value", *categories])

    schema = ", ".join(["_fold long, _at array<int>, _value array<float>", *(f"`{c}` int" for c in categories)])
    table = rows.mapInArrow(run, schema).toArrow()  # at most ``sample`` rows
    x = np.zeros((table.num_rows, len(words) + len(_SHARES)), dtype=np.float32)
    for i, (at, value) in enumerate(zip(table["_at"], table["_value"])):
        x[i, at.values.to_numpy()] = value.values.to_numpy()
    fold = table["_fold"].to_numpy()
    intercepts, weights = [], []
    for c in categories:
        positive = table[c].to_numpy() > 0
        b, w = linear.fit(x, positive, "logistic", PENALTY)
        intercepts.append(b)
        weights.append(w)
        if c != categories[-1]:
            seen = np.zeros(len(x), dtype=np.float32)
            for k in range(FOLDS):
                b, w = linear.fit(x[fold != k], positive[fold != k], "logistic", PENALTY)
                seen[fold == k] = _share(x[fold == k] @ w + b)
            x = np.column_stack([x, seen])
    return Chain(tuple(categories), words, tuple(intercepts), tuple(weights))


def _share(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-margin))


def probabilities(chain: Chain, column: pa.Array) -> np.ndarray:
    """A row for each text and a column for each category."""
    x = features(column, chain.words)
    for b, w in zip(chain.intercepts, chain.weights):
        x = np.column_stack([x, _share(x @ w + b)])
    return x[:, x.shape[1] - len(chain.categories) :]


def scored(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability for each category; a null or empty text has probability 0 of all.
    Columns of the new names are replaced."""
    names = [prefix + c for c in chain.categories]
    docs = docs.drop(*names)
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{n}` double" for n in names)

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, text):
                column = part.column(part.schema.get_field_index(text))
                p = probabilities(chain, column)
                p[np.diff(H.buffers(column)[1]) == 0] = 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p[:, i]) for i in range(len(names)))], [*columns, *names])

    return docs.mapInArrow(run, schema)


CATEGORIES = ["low_quality", "toxic"]


def categories_of(labels: DataFrame) -> DataFrame:
    """The label table as 0/1 categories, the milder one first."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int"))


def op5_toxicity(spark, sf_dir):
    """Probabilities of low quality and toxicity of all documents, learnt from ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, categories_of(read(spark, sf_dir, "labels")), CATEGORIES)
    return scored(docs, chain).drop("text").withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
