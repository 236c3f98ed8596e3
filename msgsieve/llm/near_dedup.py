"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017). A sketch has t coordinates. In round i every element of the
set falls into a bin by the i-th hash and leaves the value (i, hash) there, the smaller value stays;
a filled bin is closed to later rounds. From round t on all elements go to bin i - t, so after 2t rounds
every coordinate is filled. Coordinates of two sets agree with probability J, their Jaccard similarity,
and their sum is concentrated as if they were independent. A set of n elements takes about
n + t log t steps, against n * t for the usual sketch.

Banding. ``ROWS`` coordinates make a band; texts with an equal band are candidates. At the least
similarity a pair misses all ``BANDS`` bands with probability (1 - J**ROWS)**BANDS: 7e-9 at J = 0.85
and 3e-6 at 0.8.

Verification takes whole sets and integer arithmetic. Texts with equal sets are one class from the
start. In a bucket the class of the smallest id leads; every class is first compared with the one leader it
shares most buckets with, so a group of thousands of alike texts costs one comparison for each. Buckets whose
classes are all in one component are finished then, as nothing in them could add to a component. In the others
every pair of classes from different components is compared by its sketches, block by block where a bucket is large
and in the first bucket that the two share. Of the classes whose sketches agree with another's as often as those of linked
texts do, shingles that only one of them has are counted: they are in no intersection, which bounds the similarity of
a class to any other, exactly, and keeps a group of thousands of texts that are alike but not enough from being
compared in pairs. What is left is verified on whole sets, in blocks bounded by the bytes of their texts. What
leaves a block is which components are linked and no list of pairs. A linked pair agrees less often with a
probability under 1e-9 (Chernoff's bound), so no link between components is lost.

What a class needs (its sketch, component, text) is joined to one row a class that holds its buckets, at most BANDS.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm.common import broadcast_if_few, components, frugal, read, written

BANDS, ROWS = 32, 5
#: A power of two, so many numbers of bands fit into the last bits of a band's hash.
NUMBERS = 32
#: Classes of a bucket in a part whose sketches are compared with those of another part in one task.
BLOCK = 4096
#: Bytes of text in such a part when whole sets are compared.
BLOCK_BYTES = 8_000_000
LOST = 1e-9


def sketch(elements: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The sketch of a set of distinct hashes, not empty: t values, 0 to 2**64-1."""
    out, open_bins, first, n = np.zeros(t, dtype=H.U64), np.ones(t, dtype=bool), 0, len(elements)
    while open_bins.any():
        if first >= t:
            # the closing rounds: round t + b sends all elements to bin b
            bins = np.flatnonzero(open_bins)
            for b in bins.tolist():
                h = H.mix64(elements ^ H.mix64(np.full(1, t + b, dtype=H.U64)))
                out[b] = H.mix64(h.min() + H.U64(t + b))
            break
        rounds = min(t - first, max(1, math.ceil(1.2 * t * math.log(t) / n)))
        number = np.arange(first, first + rounds, dtype=H.U64)
        h = H.mix64(elements[None, :] ^ H.mix64(number)[:, None])
        # bin in the upper bits, then the round, then the hash: the first of each bin is its value
        bin_of = (h >> H.U64(32)) % H.U64(t)
        key = (bin_of << H.U64(48)) | ((number - H.U64(first))[:, None] << H.U64(32)) | (h & H.U64(0xFFFFFFFF))
        key = np.sort(key, axis=None)
        bins = (key >> H.U64(48)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        new = new[open_bins[bins[new]]]
        out[bins[new]] = H.mix64((key[new] & H.U64(0xFFFFFFFFFFFF)) + (H.U64(first) << H.U64(32)))
        open_bins[bins[new]] = False
        first += rounds
    return out


def least_agreeing(percent: int, t: int = BANDS * ROWS) -> int:
    """How many coordinates of a linked pair agree at least, but for a probability of LOST."""
    j, least = percent / 100, 0
    for k in range(1, t):
        q = k / t
        if q >= j or t * (q * math.log(q / j) + (1 - q) * math.log((1 - q) / (1 - j))) < -math.log(LOST):
            break
        least = k
    return least


def sketched(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """``id, n, key, coords`` for every row: set size, digest of the set, 16 bits of each coordinate."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text"):
                sets = H.shingles(*H.words(part.column(1)), shingle)
                coords = [(sketch(s) >> H.U64(48)).astype(np.uint16).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(coords, pa.binary()),
                    ],
                    ["id", "n", "key", "coords"],
                )

    return source.mapInArrow(run, "id long, n long, key binary, coords binary")


def band_hashes(coords: Column) -> Column:
    """A hash of the number and the coordinates of each band, with the number in its last bits."""
    size = 2 * ROWS
    hashes = [F.xxhash64(F.lit(i), F.substring(coords, i * size + 1, size)) for i in range(BANDS)]
    return F.array(*[h.bitwiseAND(~(NUMBERS - 1)).bitwiseOR(i) for i, h in enumerate(hashes)])


def per_class(rows: DataFrame, *carried: str) -> DataFrame:
    """One row for each class of ``rows(node, n, band, ...)``: ``node, n, held``, its bands with the columns ``carried``."""
    return rows.groupBy("node", "n").agg(F.collect_list(F.struct("band", *carried)).alias("held"))


def dealt(open_rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of ``open_rows(node, n, c, held, ...)``, one a class, as blocks ``(band, x, y)`` of its buckets.

    Buckets of one component are left out. A bucket whose classes weigh more than ``most`` is dealt by hash into
    parts, and each pair of parts is a block.
    """
    weighed = open_rows.withColumn("_weight", weight).select("c", "_weight", F.explode("held.band").alias("band"))
    bucket = weighed.groupBy("band").agg(F.sum("_weight").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / most)).cast("int").alias("parts")
    several = written(bucket.where("c1 <> c2").select("band", parts), "mixed")
    held = open_rows.select("node", "n", "c", F.explode("held.band").alias("band")).join(several, "band")
    ready = per_class(held, "parts").join(open_rows.drop("held"), ["node", "n"])
    rows = ready.withColumn("b", F.explode("held")).drop("held").withColumns({"band": F.col("b.band"), "_parts": F.col("b.parts")})
    own = F.pmod(F.xxhash64("node"), "_parts").cast("int")
    both = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return both.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "b", "_parts")


def block_pairs(table: pa.Table, x: int, y: int, percent: int):
    """Rows of a block that may be linked to each row of its first part: ``(row, rows)``.

    They are of different components, may be similar enough by size, share no bucket of a smaller number, and
    their sketches agree often enough.
    """
    least, columns = least_agreeing(percent), ("band", "node", "n", "s", "c", "own")
    band, node, n, s, c, own = (table.column(k).to_numpy() for k in columns)
    coords = np.frombuffer(b"".join(table.column("coords").to_pylist()), dtype=np.uint16).reshape(len(node), -1)
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    for i in left.tolist():
        most = np.minimum(s[right], s[i])
        fits = 100 * most >= percent * (n[right] + n[i] - most)
        to = right[fits & (c[right] != c[i]) & ((node[right] > node[i]) | (x != y))]
        agree = coords[to] == coords[i]
        to, agree = to[agree.sum(axis=1) >= least], agree[agree.sum(axis=1) >= least]
        first = agree.reshape(len(to), BANDS, ROWS).all(axis=2).argmax(axis=1) if len(to) else to
        to = to[first == band[i] % NUMBERS]
        if len(to):
            yield i, to


def with_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``node, n, c, band`` of ``dealt`` rows that have a pair to be verified; a class in several blocks repeats."""

    def run(key, table):
        x, y = key[1].as_py(), key[2].as_py()
        taken = np.zeros(table.num_rows, dtype=bool)
        for i, to in block_pairs(table, x, y, percent):
            taken[i] = taken[to] = True
        return table.select(["node", "n", "c", "band"]).filter(pa.array(taken))

    return rows.groupBy("band", "x", "y").applyInArrow(run, "node long, n long, c long, band long")


def agreeing(pairs: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of ``pairs(a, b, coords_a, coords_b)`` whose sketches agree as often as those of linked texts do."""
    least = least_agreeing(percent)

    @frugal
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16) for i in (2, 3))
            alike = (a == b).reshape(batch.num_rows, -1).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    return pairs.mapInArrow(run, "a long, b long")


def linked_components(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of components that a verified pair links; ``rows`` are dealt and have a ``text``."""

    def run(key, table):
        x, y = key[1].as_py(), key[2].as_py()
        sets = []
        for batch in table.select(["text"]).to_batches():
            for part in H.pieces(batch, "text"):
                sets += H.shingles(*H.words(part.column(0)), shingle)
        sizes = np.array([len(e) for e in sets])
        first = np.concatenate([[0], np.cumsum(sizes)])
        names, number = np.unique(np.concatenate([*sets, np.zeros(0, H.U64)]), return_inverse=True)
        c, held, links = table.column("c").to_numpy(), np.zeros(len(names), dtype=np.int64), set()
        for i, to in block_pairs(table, x, y, percent):
            own = number[first[i] : first[i + 1]]
            held[own] = 1
            for start in range(0, len(to), 1000):
                part = to[start : start + 1000]
                upto = np.cumsum(sizes[part])
                at = np.arange(int(upto[-1])) + np.repeat(first[part] - (upto - sizes[part]), sizes[part])
                common = np.add.reduceat(held[number[at]], upto - sizes[part])
                linked = 100 * common >= percent * (sizes[part] + sizes[i] - common)
                links |= {(min(int(c[i]), k), max(int(c[i]), k)) for k in np.unique(c[part[linked]]).tolist()}
            held[own] = 0
        ordered = sorted(links)
        return pa.Table.from_arrays([pa.array([e[k] for e in ordered], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.groupBy("band", "x", "y").applyInArrow(run, "a long, b long").distinct()


def held_by(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of ``sets``, and of each the least and the largest of the ``nodes`` that hold it."""
    shingles = np.concatenate(sets)
    nodes = np.repeat(nodes, [len(x) for x in sets])
    if not len(shingles):
        return shingles.view(np.int64), nodes, nodes
    order = np.argsort(shingles, kind="stable")
    shingles, nodes = shingles[order], nodes[order]
    new = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    return shingles[new].view(np.int64), np.minimum.reduceat(nodes, new), np.maximum.reduceat(nodes, new)


def shared_sizes(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, own``: how many shingles of a class no other of ``texts(node, text)`` has, where there are any.

    A shingle leaves a piece of the table once, with the least and the largest class that hold it there.
    """

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text", 2_000_000):
                sets = H.shingles(*H.words(part.column(1)), shingle)
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, held_by(part.column(0).to_numpy(), sets))), ["shingle", "node", "last"]
                )

    held = texts.select("node", "text").mapInArrow(run, "shingle long, node long, last long")
    alone = held.groupBy("shingle").agg(F.min("node").alias("node"), F.max("last").alias("last")).where("node = last")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those with 100 * intersection >= percent * union; ``texts(node, text)``."""
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text_a", 1_000_000):
                left, right = (H.shingles(*H.words(part.column(i)), shingle) for i in (2, 3))
                keep = []
                for x, y in zip(left, right):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    Texts are linked if their sets of distinct ``shingle``-word runs have a Jaccard similarity of
    ``percent`` or more; ``component_id`` is the smallest id reachable over links. A text with fewer words is one
    shingle; a null text or one without words has none and is linked with nothing. Rows with equal sets
    are linked. Ids are taken as whole numbers; rows that repeat an id count as linked. A
    row without an id is linked with nothing and has no component. An empty table gives none.
    """
    rows = written(sketched(docs, id_col, text, shingle), "sketch")
    # One class for each different set, named by its smallest id. Equal sets have equal sizes and sketches.
    class_of = rows.where("n > 0 AND id IS NOT NULL").groupBy("key")
    classes = written(class_of.agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("coords").alias("coords")), "classes")
    nodes = classes.select("node", "n", "coords")
    member = nodes.select("node", "n", F.explode(band_hashes(F.col("coords"))).alias("band"))
    several = member.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    buckets = written(per_class(member.join(several.select("band", "leader"), "band"), "leader"), "buckets")
    all_texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = written(buckets.select(F.col("node").alias("id")).distinct(), "wanted")
    texts = written(all_texts.join(broadcast_if_few(wanted), "id").select(F.col("id").alias("node"), "text"), "texts")
    # Each class and the leader that it shares most buckets with.
    led = buckets.select("node", "n", F.explode("held.leader").alias("a")).where("a <> node").groupBy("node", "n", "a").count()
    first = led.groupBy("node", "n").agg(F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("most"))
    pairs = first.join(nodes, ["node", "n"]).select((-F.col("most.a")).alias("a"), F.col("node").alias("b"), F.col("coords").alias("coords_b"))
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("coords").alias("coords_a")), "a")
    pairs = agreeing(pairs.select("a", "b", "coords_a", "coords_b"), percent).distinct()
    links = written(verified(pairs, texts, shingle, percent), "links")
    component = written(components(links), "components")
    placed = buckets.join(component, "node", "left").select("node", "n", F.coalesce("component", "node").alias("c"), "held")
    by_sketch = dealt(placed.join(nodes, ["node", "n"]), F.lit(1), BLOCK).withColumn("s", F.col("n"))
    chosen = written(with_pairs(by_sketch, percent), "candidates")
    open_texts = texts.join(chosen.select("node").distinct(), "node")
    # An id of several classes has shingles of all of them: the bound does not hold for it.
    repeated = classes.groupBy("node").count().where("count > 1").select("node")
    own = shared_sizes(open_texts, shingle).join(repeated, "node", "left_anti")
    alike = per_class(chosen.distinct()).join(placed.drop("held"), ["node", "n"]).join(own, "node", "left")
    alike = alike.withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).where(f"100 * s >= {percent} * n").drop("own")
    alike = written(alike.select("node", "n", "c", "s", "held").join(nodes, ["node", "n"]).join(texts, "node"), "alike")
    by_set = dealt(alike, F.octet_length("text"), BLOCK_BYTES)
    more = written(linked_components(by_set, shingle, percent), "links")
    component = written(components(links.union(more)), "components")
    named = classes.join(component, "node", "left").select(
        "key", F.coalesce("component", "node").alias("component_id")
    )
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.join(named, "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")
    )


def op3_near_dedup(spark, sf_dir):
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85).withColumn("kept", F.col("doc_id") == F.col("component_id"))
