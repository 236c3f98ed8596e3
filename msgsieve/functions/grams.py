"""Character n-grams of the words of many texts at a time, as arrays: what ``tokens.char_ngrams`` gives, counted.

The n-grams of a word are cut once for all texts of a piece that have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

#: Words of which n-grams are counted at a time.
PIECE = 200_000
#: Cells of the table of rows by vocabulary that is filled at a time.
CELLS = 2_000_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...``, as many as the size says, for each start."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    flat = points.ravel()
    width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.cumsum(width.reshape(points.shape).sum(axis=1))
    raw = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(raw))


def counted(words: pa.ListArray, low: int, high: int, by_row: bool):
    """For each length the n-grams of texts cut into ``words``: ``(terms, rows with it, times)`` or, ``by_row``,
    ``(terms, row, times)`` for each row and n-gram in it."""
    codes = words.flatten().dictionary_encode()
    if not len(codes):
        return
    word, rows = np.asarray(codes.indices).astype(np.int64), len(words)
    row = np.repeat(np.arange(rows), words.value_lengths().to_numpy())
    different = len(codes.dictionary)
    held, times = np.unique(row * different + word, return_counts=True)
    row, word = np.divmod(held, different)
    total = np.bincount(word, times, minlength=different)
    texts = codes.dictionary.to_pylist()
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, different) + 2
    starts = np.cumsum(sizes) - sizes
    letters, letter = np.unique(points, return_inverse=True)
    for n in range(low, high + 1):
        many = np.maximum(sizes - n + 1, 0)
        at = _spread(starts, many)
        if not len(at):
            continue
        key, largest = letter[at], len(letters)
        for i in range(1, n):
            if largest * len(letters) >= 2**62:
                found, key = np.unique(key, return_inverse=True)
                largest = len(found)
            key, largest = key * len(letters) + letter[at + i], largest * len(letters)
        _, first, gram = np.unique(key, return_index=True, return_inverse=True)
        terms = _strings(points[at[first][:, None] + np.arange(n)])
        each = many[word]
        pairs = np.repeat(row, each) * len(first) + gram[_spread((np.cumsum(many) - many)[word], each)]
        if by_row:
            found, which = np.unique(pairs, return_inverse=True)
            of, own = np.divmod(found, len(first))
            yield terms.take(pa.array(own)), of, np.bincount(which, np.repeat(times, each)).astype(np.int64)
        else:
            rows_with = np.bincount(np.unique(pairs) % len(first), minlength=len(first))
            yield terms, rows_with, np.bincount(gram, np.repeat(total, many), minlength=len(first)).astype(np.int64)


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\S+"), F.lit(0))


def _cut(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, _words().alias("_words"))


def _pieces(batch: pa.RecordBatch):
    """The batch in runs of rows of at most ``PIECE`` words, or one row."""
    ends = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().to_numpy())
    a = 0
    while a < batch.num_rows:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(a, b - a)
        a = b


def gram_rows(df: DataFrame, *keep: str, low: int = 3, high: int = 5) -> DataFrame:
    """Rows ``(keep..., term, tf)`` of the n-grams of ``text``, one for each row and n-gram in it."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "term string, tf int"])

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                for terms, row, times in counted(part.column(len(keep)), low, high, True):
                    own = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, terms, pa.array(times.astype(np.int32))], [*keep, "term", "tf"])

    return _cut(df, *keep).mapInArrow(run, schema)


def gram_counts(df: DataFrame, low: int = 3, high: int = 5) -> DataFrame:
    """``(term, df, tf)`` of the n-grams of ``text`` over pieces of the table: to be added up by term."""

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                for terms, rows, times in counted(part.column(0), low, high, False):
                    yield pa.RecordBatch.from_arrays([terms, pa.array(rows.astype(np.int64)), pa.array(times)], ["term", "df", "tf"])

    return _cut(df).mapInArrow(run, "term string, df long, tf long")


def token_counts(df: DataFrame, tokens: str) -> DataFrame:
    """``(term, df, tf)`` of an array column over pieces of the table: to be added up by term."""

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                words = part.column(0)
                codes = words.flatten().dictionary_encode()
                code, different = np.asarray(codes.indices).astype(np.int64), len(codes.dictionary)
                row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
                rows = np.bincount(np.unique(row * different + code) % max(different, 1), minlength=different)
                times = np.bincount(code, minlength=different)
                yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array(rows.astype(np.int64)), pa.array(times.astype(np.int64))], ["term", "df", "tf"])

    return df.select(tokens).mapInArrow(run, "term string, df long, tf long")


class Trie:
    """Terms by their beginnings: at each length the beginnings as sorted keys (number of the shorter one, letter), and
    the term that each is, or -1."""

    def __init__(self, terms: list[str]):
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in terms]
        sizes = np.array([len(p) for p in points])
        self.letters = np.unique(np.concatenate(points))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        node = np.zeros(len(terms), np.int64)
        for i in range(int(sizes.max())):
            on = np.flatnonzero(sizes > i)
            key = node[on] * len(self.letters) + np.searchsorted(self.letters, [points[t][i] for t in on])
            keys, node[on] = np.unique(key, return_inverse=True)
            term = np.full(len(keys), -1)
            ends = on[sizes[on] == i + 1]
            term[node[ends]] = ends
            self.levels.append((keys, term))

    def found(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, term)`` of every term in ``points`` that starts at a place and is over by its ``ends``."""
        letter = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        letter[self.letters[letter] != points] = -1
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        places, terms = [], []
        for i, (keys, term) in enumerate(self.levels):
            inside = at + i < ends[at]
            at, node = at[inside], node[inside]
            key = node * len(self.letters) + letter[at + i]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = (keys[node] == key) & (letter[at + i] >= 0)
            at, node = at[known], node[known]
            whole = term[node] >= 0
            places.append(at[whole])
            terms.append(term[node[whole]])
        return np.concatenate(places), np.concatenate(terms)


def counted_terms(words: pa.ListArray, trie: Trie, size: int):
    """Rows by term how often the words of a row, padded, hold each of ``size`` terms; in runs ``(rows, term, times)``
    with the number of entries of each row, its terms in order."""
    codes = words.flatten().dictionary_encode()
    rows, per_row = len(words), words.value_lengths().to_numpy()
    word = np.asarray(codes.indices).astype(np.int64)
    texts = codes.dictionary.to_pylist()
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    of = np.repeat(np.arange(len(texts)), sizes)
    place, term = trie.found(points, np.cumsum(sizes)[of])
    order = np.argsort(of[place], kind="stable")
    term = term[order]
    many = np.bincount(of[place], minlength=len(texts))
    starts = np.cumsum(many) - many
    ends = np.concatenate([[0], np.cumsum(per_row)])
    step = max(1, CELLS // size)
    for a in range(0, rows, step):
        b = min(a + step, rows)
        own = word[ends[a] : ends[b]]
        row = np.repeat(np.arange(b - a), per_row[a:b])
        each = many[own]
        cells = np.bincount(np.repeat(row * size, each) + term[_spread(starts[own], each)], minlength=(b - a) * size)
        filled = np.flatnonzero(cells)
        yield np.bincount(filled // size, minlength=b - a), filled % size, cells[filled]


class GramCounter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text to the sparse vector of how often each n-gram of ``vocabulary`` comes in it: what ``tokens.char_ngrams`` and
    ``CountVectorizerModel`` give, without a token for each place. N-grams are as long as the ones there, three to five characters."""

    terms = Param(Params._dummy(), "terms", "n-grams, in the order of the vector", TypeConverters.toListString)

    def __init__(self, vocabulary: list[str] | None = None, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if vocabulary is not None:
            self._set(terms=list(vocabulary), inputCol=inputCol, outputCol=outputCol)

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.terms)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, trie = len(self.vocabulary), Trie(self.vocabulary)

        @F.arrow_udf(returnType=VectorUDT())
        def vectors(words: pa.Array) -> pa.Array:
            numbers, indices, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in _pieces(pa.RecordBatch.from_arrays([words], ["words"])):
                for number, index, times in counted_terms(part.column(0), trie, size):
                    numbers.append(number)
                    indices.append(index.astype(np.int32))
                    values.append(times.astype(float))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(numbers))]).astype(np.int32))
            n = len(words)
            parts = {
                "type": pa.array(np.zeros(n, np.int8)),
                "size": pa.array(np.full(n, size, np.int32)),
                "indices": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(indices).astype(np.int32))),
                "values": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values))),
            }
            return pa.StructArray.from_arrays(list(parts.values()), list(parts))

        return dataset.withColumn(self.getOutputCol(), vectors(_words(self.getInputCol())))
