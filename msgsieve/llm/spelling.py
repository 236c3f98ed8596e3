"""Grouping spelling variants: words one edit apart, by Gram matrices of letter counts.

Words. Every text gives its maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF; A-Z count as a-z. Equal words of a
text are counted before anything is exchanged, and Spark adds the counts up.

Pairs. A word is the vector of how often it holds each letter. One insertion moves the vector by a squared distance
of 1 and the length by 1, one replacement by 2 and 0. So words are dealt into blocks by length, and these by how many
letters of each of a few classes a word has: an edit changes one class by one (insertion), or moves one letter
within a class or from one to another (replacement), so a block meets itself, the blocks with a letter moved, and
those of the next length. The number of classes grows with the logarithm of the number of words, which only says how the
work is dealt. Large blocks are dealt over parts by a hash, and each task multiplies the counts of two parts:
``|a|**2 + |b|**2 - 2 a.b``. Pairs at the right distance (1 in adjacent lengths, 2 in equal ones) are verified on the
letters themselves, and only verified pairs leave the task.

Forms. A word's form is the most frequent word next to it (ties: the smallest), if that is at least ``RATIO`` times as
frequent. Counts grow along forms, so following them ends; it takes a number of joins that is the logarithm of the
longest chain.

Work and memory. The products are quadratic in the words of neighbouring blocks, which is the method; a part holds some
``PART_WORDS`` words, or fewer of long ones, and a task a few slices of their product. Spark deals the products over
as many tasks as they need.

Edge cases. Null and empty texts have no words. A missing id counts as an empty one in the planted deletions. Words of any length are
compared. Two different words are one with a probability of n**2 / 2**65 among the n different ones of 4 MB of text (a
64-bit hash tells them apart there; afterwards the words themselves do). Rows that repeat count as often as they
stand there. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm.common import broadcast_if_few, read, written
from msgsieve.llm.crcsql import CRC_TABLE, crc32_sql

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many, by a hash of document and run, loses a letter before it is counted.
DELETE_ONE_IN = 199
PART_WORDS, PART_LETTERS = 2048, 1 << 21
#: Products of two words in one task, on average.
TASK_PAIRS = 100_000_000
#: There is one class of letters, and one more for each four-fold of this number of words.
WORDS_PER_CLASS = 5000
#: Letters from the most frequent on, dealt over the classes to and fro; letters not named go by their code.
_ORDER = "etaoinshrdlucmfwygpbvkqjxz"
#: 26 letters, and the 64 from U+00C0 on.
_DIMS = 90

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Runs:
    """The runs of letters of a column's texts: bytes, lengths in letters, text of each, and a hash."""

    def __init__(self, column: pa.Array):
        data, offsets = H.buffers(column)
        wide = data == 0xC3  # the lead of U+00C0 to U+00FF
        after = np.zeros(len(data), bool)
        after[1:] = wide[:-1]
        inside = (_LETTER[data] | wide | after).astype(np.uint8)
        self.data, self._wide = data, np.concatenate([[0], np.cumsum(wide)])
        # ``runs`` looks its marks up by byte value: here the marks are the bytes
        self.starts, self.ends, counts = H.runs(inside, offsets, np.array([False, True]))
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.length = self.ends - self.starts - (self._wide[self.ends] - self._wide[self.starts])

    def take(self, kept: np.ndarray) -> None:
        self.starts, self.ends, self.text, self.length = (x[kept] for x in (self.starts, self.ends, self.text, self.length))

    def hashes(self) -> np.ndarray:
        return H.run_hashes(self.data, self.starts, self.ends, H._BYTE)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes().lower()  # bytes: A-Z only


_CRC = np.zeros(256, np.uint32)
for _b in range(256):
    _c = _b
    for _ in range(8):
        _c = (_c >> 1) ^ 0xEDB88320 if _c & 1 else _c >> 1
    _CRC[_b] = _c


def crc_after(prefixes: np.ndarray, which: np.ndarray, sizes: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """crc32 of a prefix followed by a word, from the crc32 of both: that of the prefix is carried over as many zero
    bytes as the word has, which is one table step a byte and linear, so it is done once for each prefix and size."""
    out = np.zeros(len(which), np.uint32)
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2)) if sizes.max(initial=0) <= 256 else None
    if bounds is not None:
        state = prefixes.copy()
        for size in range(len(bounds) - 1):
            mine = order[bounds[size] : bounds[size + 1]]
            out[mine] = state[which[mine]] ^ crcs[mine]
            state = _CRC[state & 255] ^ (state >> 8)
        return out
    short = sizes <= 256
    out[short] = crc_after(prefixes, which[short], sizes[short], crcs[short])
    for k in np.flatnonzero(~short).tolist():
        state = int(prefixes[which[k]])
        for _ in range(int(sizes[k])):
            state = int(_CRC[state & 255]) ^ (state >> 8)
        out[k] = state ^ int(crcs[k])
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", delete_one_in: int | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n`` of ``docs``: words of at least ``min_length`` letters and how often they occur.

    With ``delete_one_in``, a run whose crc32 of ``<id>:<run>`` that number divides loses the letter at crc32 modulo
    its length first.
    """

    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text"):
                runs = Runs(part.column(1))
                runs.take(runs.length >= min_length)
                if not len(runs.starts):
                    continue
                _, first, which = np.unique(runs.hashes(), return_index=True, return_inverse=True)
                words = [runs.word(k) for k in first.tolist()]
                lost: list[bytes] = []
                whole = np.ones(len(which), bool)
                if delete_one_in:
                    ids = part.column(0).to_pylist()
                    prefixes = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                    crcs = np.array([zlib.crc32(w) for w in words], np.uint32)[which]
                    crcs = crc_after(prefixes, runs.text, runs.ends - runs.starts, crcs)
                    whole = crcs % delete_one_in != 0
                    for k in np.flatnonzero(~whole).tolist():
                        if runs.length[k] > min_length:
                            letters = words[which[k]].decode()
                            at = int(crcs[k]) % len(letters)
                            lost.append((letters[:at] + letters[at + 1 :]).encode())
                counts = np.bincount(which[whole], minlength=len(words))
                kept = np.flatnonzero(counts)
                found = [words[k] for k in kept.tolist()] + lost
                n = np.concatenate([counts[kept], np.ones(len(lost), counts.dtype)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def classes_for(n_words: int) -> int:
    return 1 + max(0, int(math.log(max(n_words, 1) / WORDS_PER_CLASS, 4)))


def _class_counts(word: Column, classes: int) -> Column:
    """How many letters of each class a word has."""
    inside = [""] * classes
    for k in range(_DIMS):
        letter = chr(97 + k) if k < 26 else chr(0xC0 + k - 26)
        turn = _ORDER.find(letter) % (2 * classes) if letter in _ORDER else k % classes
        inside[min(turn, 2 * classes - 1 - turn)] += letter
    # ``translate`` drops letters that have no counterpart.
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in inside])


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts; whole numbers that the type holds exactly, their products too."""
    n, length = letters.shape
    dim = np.where(letters < 0xC0, letters - 97, letters - 0xC0 + 26).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * _DIMS + dim).ravel(), minlength=n * _DIMS).reshape(n, _DIMS)
    return counts.astype(np.float32 if length < 2048 else np.float64)


def near_pairs(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the words that one edit turns into each other; the words of each list are of one
    length, those of ``b`` as long or longer by one. If they are the ``same`` list, each pair is given once."""
    x, y = _letters(a), _letters(b)
    u, v = _vectors(x), _vectors(y)
    wanted = 2 if x.shape[1] == y.shape[1] else 1
    norm_u, norm_v = (u * u).sum(1), (v * v).sum(1)
    # One product gives the squared distances: the norms are two more columns.
    used = np.flatnonzero(u.any(0) & v.any(0))
    one = lambda m: np.ones((len(m), 1), m.dtype)
    u = np.hstack([-2 * u[:, used], norm_u[:, None], one(u)])
    v = np.hstack([v[:, used], one(v), norm_v[:, None]]).T
    slice_rows = max(1, (1 << 21) // len(b))
    found_i, found_j = [], []
    for start in range(0, len(a), slice_rows):
        rows = slice(start, start + slice_rows)
        i, j = np.divmod(np.flatnonzero(u[rows] @ v == wanted), len(b))
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        step = max(1, (1 << 22) // x.shape[1])
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            near = _one_edit(x[p], y[q])
            found_i.append(p[near])
            found_j.append(q[near])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row: one letter replaced, or one letter of ``y`` deleted, makes ``x``."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(1) == 1
    head = np.cumprod(x == y[:, :-1], axis=1).sum(1)
    tail = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= x.shape[1]


def _partners(block: Column, classes: int) -> Column:
    """The blocks that a block meets: itself, each with one letter in a later class instead of an earlier one (one of
    the two directions of each pair of blocks), and each with one letter more."""
    change = lambda deltas: F.zip_with(block, F.array(*[F.lit(d) for d in deltas]), lambda c, d: c + d)
    unit = lambda *at: [sum(d for p, d in at if p == k) for k in range(classes)]
    deltas = [unit()]
    deltas += [unit((p, -1), (q, 1)) for p in range(classes) for q in range(p + 1, classes)]
    deltas += [unit((p, 1)) for p in range(classes)]
    return F.array(*[change(d) for d in deltas])


def variants(words: DataFrame, classes: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: every two words of the stored table ``words(word, n)`` that are one edit apart, in both
    directions."""
    classes = classes or classes_for(words.count())
    letters = F.length("word")
    room = F.greatest(F.lit(1), F.least(F.lit(PART_WORDS), F.floor(F.lit(PART_LETTERS) / letters)))
    blocks = words.withColumn("block", _class_counts(F.col("word"), classes))
    counts = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.first(room).alias("room"))
    sizes = written(counts.select("block", F.ceil(F.col("size") / F.col("room")).cast("int").alias("parts")), "word-blocks")
    dealt = blocks.join(broadcast_if_few(sizes), "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    parts = dealt.groupBy("block", "part").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    parts = written(parts.withColumn("size", F.size("words").cast("long")), "word-parts")
    one = parts.withColumn("partner", F.explode(_partners(F.col("block"), classes)))
    two = parts.select(*[F.col(c).alias(f"{c}_b") for c in parts.columns])
    # Ids and sizes first, for the number of tasks; the words follow.
    joined = lambda *more: one.select("block", "part", "partner", "size", *more).join(
        two.select("block_b", "part_b", "size_b", *[f"{c}_b" for c in more]), F.col("partner") == F.col("block_b")
    ).where((F.col("block") != F.col("block_b")) | (F.col("part") <= F.col("part_b")))
    work = joined().agg(F.sum(F.col("size") * F.col("size_b")).alias("w")).first()["w"] or 0
    tasks = max(1, -(-work // TASK_PAIRS))
    own = (F.col("block") == F.col("block_b")) & (F.col("part") == F.col("part_b"))
    both = joined("words").select(own.alias("same"), "words", "words_b").repartition(tasks)

    def run(batches):
        for batch in batches:
            found = []
            for same, a, b in zip(*[column.to_pylist() for column in batch.columns]):
                i, j = near_pairs([w["word"] for w in a], [w["word"] for w in b], same)
                found += [(a[p], b[q]) for p, q in zip(i.tolist(), j.tolist())]
            rows = [(*x.values(), *y.values()) for a, b in found for x, y in ((a, b), (b, a))]
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "near", "near_n"])

    return both.mapInArrow(run, "word string, n long, near string, near_n long")


def followed(links: DataFrame) -> DataFrame:
    """``word, root``: where following ``links(word, form)`` ends. No chain may return to itself."""
    now = written(links.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = F.col("next").isNotNull().alias("went")
        step = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), went), "word-roots")
        now = step.select("word", "root")
        if step.where("went").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the stored table ``words(word, n)``."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = variants(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    told = written(
        told.select(
            "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = followed(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    """The words of all documents with the words one edit apart, the form each is a variant of, and its root."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs, delete_one_in=DELETE_ONE_IN)
    return grouped(written(counts.where(F.col("n") >= MIN_COUNT), "words"))


#: In SQL, words one edit apart are found by what is left when a letter is deleted.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
),
hashed AS (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % {DELETE_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed
    ) WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
),
cuts AS (
    SELECT DISTINCT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
),
pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
near AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM pairs GROUP BY word
),
forms AS (
    SELECT w.word, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN near USING (word)
),
steps AS (
    SELECT word, coalesce(form, word) AS root, 0 AS step FROM forms
    UNION ALL
    SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms
JOIN (SELECT word, last(root ORDER BY step) AS root FROM steps GROUP BY word) USING (word)
"""
