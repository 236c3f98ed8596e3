"""Vectorised words and 64-bit hashes of texts, computed on Arrow's own buffers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z. All functions work
on the flat byte buffer of a string column, so their cost is a few nanoseconds a byte and does not
depend on how many words there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x + GOLDEN).astype(U64, copy=False)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix64(a * U64(0xD6E8FEB86659FD93) + b)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(_LOWER.astype(U64) + U64(1000))
_EXACT = mix64(np.arange(256, dtype=U64) + U64(1000))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_IS_LINE = np.ones(256, dtype=bool)
_IS_LINE[10] = False
#: Bytes whose words are hashed at a time; a longer word is taken whole.
STRETCH = 1 << 18
_powers = _inverses = np.ones(1, dtype=U64)

#: Stand for the start of a text, its end, and the filling of a text shorter than a shingle. Hashes of
#: words are finalised with their length, so these three fixed values are as unlikely as any collision.
START, END, FILL = U64(0x5354415254), U64(0x454E44), U64(0x46494C4C)


def powers(n: int) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64 for a fixed odd r."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        grown = np.full(size, U64(0x5851F42D4C957F2D), dtype=U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of ``powers(n)`` modulo 2**64."""
    global _inverses
    if len(_inverses) < n:
        grown = np.full(len(powers(n)), U64(pow(int(powers(2)[1]), -1, 2**64)), dtype=U64)
        grown[0] = 1
        _inverses = np.multiply.accumulate(grown)
    return _inverses


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)


def pieces(batch: pa.RecordBatch, text: str, limit: int = 4_000_000):
    """Slices of a batch of about ``limit`` bytes of text, or one row if that is longer."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = np.diff(buffers(column)[1])
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(lengths) > start:
        yield batch.slice(start, len(lengths) - start)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes marked in ``inside``, and their number in each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    is_in = inside[data]
    before = np.empty_like(is_in)
    before[0] = False
    before[1:] = is_in[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(is_in & ~before)
    after = np.empty_like(is_in)
    after[-1] = False
    after[:-1] = is_in[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_in & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def run_hashes(data, starts, ends, table) -> np.ndarray:
    """A hash of the bytes of each run."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    # sums up to each byte under growing powers; what a run adds is brought back to power 0 by its start's inverse
    out = np.empty(len(starts), dtype=U64)
    cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], starts[-1] + 1, STRETCH)))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)]):
        base, size = starts[i], int(ends[j - 1] - starts[i])
        sums = np.zeros(size + 1, dtype=U64)
        np.cumsum(table[data[base : base + size]] * powers(size)[:size], out=sums[1:])
        first, after = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[after] - sums[first]) * inverse_powers(size)[first]
    return mix64(out + (ends - starts).astype(U64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and the number of words of each text."""
    data, offsets = buffers(column)
    starts, ends, counts = runs(data, offsets, _IS_WORD)
    return run_hashes(data, starts, ends, _BYTE), counts


def word_counts(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    return runs(*buffers(column), _IS_WORD)[2].astype(np.int64)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text is one shingle, no word none."""
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if not n:
            out.append(own)
            continue
        if n < k:
            own = np.concatenate([own, np.full(k - n, FILL, dtype=U64)])
        made = own[: len(own) - k + 1]
        for j in range(1, k):
            made = pair_hash(made, own[j : len(own) - k + 1 + j])
        made = np.sort(made)
        out.append(made[np.concatenate([[True], made[1:] != made[:-1]])])
    return out
