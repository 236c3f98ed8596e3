"""Best-fit packing planned on the histogram of lengths.

``tokenized`` turns texts into token ids and cuts those that exceed a sequence. ``plan`` runs best-fit
decreasing over counts per length: at most ``capacity`` numbers reach the driver, whatever the number of
documents. A plan row says that pieces of one length with ranks ``first, first + 1, ...`` take the
next places of a run of sequences. ``packed`` gives each piece the slot of its rank within its length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm.common import frugal, rank_within, read, written

CAPACITY = 2048
#: Words of which a worker remembers the ids; it starts anew beyond this, so its memory is bounded.
REMEMBERED = 1_000_000
#: Bytes of text that are encoded at a time.
STRETCH = 500_000
PIECE = "piece int, start long, length long, ids_crc32 long"

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_encoders: dict = {}


class WordEncoder:
    """Token ids of words by a tokenizer that never joins across ASCII white space.

    The ids of words met before are kept in arrays, some 30 bytes a word in place of 120 as objects: for each hash of a word, in their
    order, where its ids begin and how many there are. Among n words two are alike in 64 bits with a probability of n**2 / 2**65.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            closes[i] = token.endswith("</w>")
        self.closes = closes

    def forget(self) -> None:
        self.known, self.ids = np.zeros(0, H.U64), np.zeros(0, np.uint32)
        self.first = self.sizes = np.zeros(0, np.int32)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        """Marks those of ``hashes`` whose words are not remembered."""
        return np.searchsorted(self.known, hashes) == np.searchsorted(self.known, hashes, side="right")

    def learn(self, hashes: np.ndarray, missing: list[bytes]) -> None:
        """Remember the ids of words that were not known, in the order of their ``hashes``."""
        ids = self.encoded(missing)
        found = [ids[w] for w in missing]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        first = len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first, self.sizes = np.insert(self.first, at, first), np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype=np.uint32)])

    def encoded(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Encode words: those of Latin letters alone many at a time, as each is one unit ended by a
        closing token; all others one by one."""
        out = {}
        plain, other = [], []
        for w in missing:
            text = w.decode()
            (plain if text.isalpha() and max(text) < "ɐ" else other).append((w, text))
        for i in range(0, len(plain), 200):
            group = plain[i : i + 200]
            ids = np.array(self.tokenizer.encode(" ".join(t for _, t in group), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                other += group
                continue
            for (w, _), a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
                out[w] = ids[a:b].tobytes()
        for e, (w, _) in zip(self.tokenizer.encode_batch([t for _, t in other], add_special_tokens=False), other):
            out[w] = np.array(e.ids, dtype=np.uint32).tobytes()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text."""
        data, offsets = H.buffers(column)
        starts, ends, _ = H.runs(data, offsets, H._IS_WORD)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        # A closing run of punctuation after a letter is a unit of its own: fewer distinct words.
        last = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, np.arange(len(data))))
        middle = np.maximum(last[ends - 1] + 1, starts)
        split = (middle > starts) & (middle < ends)
        split &= _LETTER[data[np.maximum(middle - 1, 0)]]
        starts = np.sort(np.concatenate([starts, middle[split]]))
        ends = np.sort(np.concatenate([ends, middle[split]]))
        raw = data.tobytes()
        folded = b"<|" not in raw  # special tokens are told by case, all else is lower-cased anyway
        hashes, example, word = np.unique(
            H.run_hashes(data, starts, ends, H._BYTE if folded else H._EXACT), return_index=True, return_inverse=True
        )
        raw = raw.lower() if folded else raw
        new = np.flatnonzero(self.unknown(hashes))
        if len(new) and len(self.known) > REMEMBERED:
            self.forget()
            new = np.arange(len(hashes))
        if len(new):
            self.learn(hashes[new], [raw[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist())])
        at = np.searchsorted(self.known, hashes)[word]
        size, first = self.sizes[at].astype(np.int64), self.first[at].astype(np.int64)
        upto = np.cumsum(size)
        ids = self.ids[np.arange(int(upto[-1])) + np.repeat(first - (upto - size), size)]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def piece_rows(column: pa.Array, path: str, capacity: int, end_id: int):
    """Row number, piece, start, length and checksum of every piece of every text of a slice."""
    ids, counts = encoder(path).encode(column)
    close = np.array([end_id], dtype=np.uint32).tobytes()
    at = 0
    for row, n in enumerate(counts.tolist()):
        value = ids[at : at + n].tobytes() + close
        at += n
        for piece, start in enumerate(range(0, n + 1, capacity)):
            own = value[4 * start : 4 * (start + capacity)]
            yield row, piece, start, len(own) // 4, zlib.crc32(own)


def tokenized(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """The columns ``keep`` with ``piece, start, length, ids_crc32``, a row for each piece.

    A text's ids are those of the tokenizer without special tokens, then ``end_id``; a null or empty
    text has ``end_id`` only. Texts of more than ``capacity`` ids are cut, the last piece may be shorter.
    ``path`` must exist on the workers.
    """
    keep = list(keep)
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema), PIECE])

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "_text", STRETCH):
                row, piece, start, length, crc = zip(*piece_rows(part.column(len(keep)), path, capacity, end_id))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(rows) for i in range(len(keep))]
                    + [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)],
                    [*keep, "piece", "start", "length", "ids_crc32"],
                )

    return source.mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first, times, sequence, offset)``.

    Pieces of ``length`` with ranks from ``first`` on go ``times`` to a sequence, side by side from
    ``offset`` on; the first ``times`` to ``sequence``, the next to ``sequence + 1``. Ranks of a length
    are covered from 0 without a gap. Alike sequences are one entry while the plan is made, so its size
    follows the number of distinct lengths and not the number of pieces.
    """
    open_room: list[int] = []  # sorted room left, each with its groups of alike sequences
    groups: dict[int, list] = {}
    closed: list = []

    def put(room: int, many: int, content: tuple) -> None:
        if not many:
            return
        if room == 0:
            closed.append((many, content))
            return
        if room not in groups:
            insort(open_room, room)
            groups[room] = []
        groups[room].append((many, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(open_room, length)
            if at < len(open_room):
                room = open_room[at]
                many, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], open_room[at]
            else:
                room, content = capacity, ()
                many = -(-left // (capacity // length))
            each = room // length
            full = min(many, left // each)
            put(room - each * length, full, (*content, (length, each)))
            left -= full * each
            many -= full
            if many and left:
                put(room - left * length, 1, (*content, (length, left)))
                many, left = many - 1, 0
            put(room, many, content)
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for many, content in [*closed, *(g for room in open_room for g in groups[room])]:
        offset = 0
        for length, times in content:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += many * times
            offset += times * length
        sequence += many
    return rows


def packed(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, ranked: Callable = rank_within) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``order`` are the columns that tell pieces apart. ``ranked`` gives pieces of one length their turn: in any fixed order by
    default. Pass a written table: it is read three times.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted(plan(histogram, capacity))
    # length and rank as one number: ranks stay far below 2**48
    keys = np.array([(r[0] << 48) + r[1] for r in rows], dtype=np.int64)
    first, times, sequence, offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3, 4))
    placed = ranked(pieces, "length", order, "_rank")
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            step, place = np.divmod(rank - first[at], times[at])
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                own + [pa.array(sequence[at] + step), pa.array(offset[at] + place * length)], [*columns, "sequence_id", "offset"]
            )

    return placed.mapInArrow(run, schema)


def op6_packing(spark, sf_dir):
    """Pack all documents into sequences of 2048 tokens."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = written(tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]), "pieces")
    return packed(pieces, ["doc_id", "piece", "start", "ids_crc32"])
