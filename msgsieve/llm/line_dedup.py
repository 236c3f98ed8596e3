"""Line deduplication: blocks that a later document shares with an earlier one are deleted from the later one.

A block is a run of ``min_words`` words or more, wherever it begins and ends: stops, line breaks, short lines and
the order of the blocks do not matter. Words are compared without regard to the case of A-Z.

Lines. Texts need not have stops or line breaks, so lines are cut by their content: of each run of ``min_words`` words the
half as long run with the least hash is a line. Equal runs have equal lines, so every block holds a whole one, and there are
some five lines for a hundred words. Lines that one document alone holds go first. A line
that very many share is not dropped for it, as it links each of them with its first holder only, not all with all.

Pairs. A line with the words around it that have no other line is a stretch. A later holder of a stretch is paired
with its first holder. Where one line stands in different stretches, as at the ends of a block, it is paired by the
single windows (runs of ``min_words`` words) of them. So every window of a text is paired with the document that first holds
it: also a passage whose parts are held by others even earlier is found.

Alignment. For each pair the places of what both hold, in the later and in the earlier text, are joined to blocks, and
the blocks are aligned by patience diff: those that occur once are anchors, the longest chain of anchors that
runs forward in both texts is one alignment. What it leaves, as repeated and swapped blocks, is aligned again
until no block is left. Aligned blocks are deleted from the later text.

Ends. Of a block that begins or ends with fewer than ``MIN_LINE`` words that only a later holder adds, these
words stay: the first holder says where a passage ends.

A window is known by 64 bits of hash; among n windows sent two different ones are alike with a probability of n**2 / 2**65.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.llm import hashing as H
from msgsieve.llm.common import broadcast_if_few, frugal, read, written

MIN_LINE = 4
MIN_WORDS = 40
#: Groups of keys whose rows are counted to find hot ones: a table of at most so many rows.
CELLS = 1 << 16
#: Bytes of text whose windows are taken at a time.
PIECE = 1_000_000

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SPANS_SQL = "array<struct<start: long, stop: long>>"


def longest_chain(there: list[int]) -> list[int]:
    """The numbers of the longest increasing sequence of ``there``, found by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(there)
    for k, place in enumerate(there):
        p = bisect_left(tops, place)
        before[k] = ends[p - 1] if p else -1
        tops[p : p + 1] = [place]
        ends[p : p + 1] = [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = before[k]
    return chain[::-1]


def patience(there: list[int]) -> list[list[int]]:
    """Alignments of the common blocks of a pair, as lists of their numbers: every block is in one of them.

    ``there`` are their places in the earlier text, in the order of the later one. The first alignment is that of
    patience diff, the longest chain of blocks that occur once. Others (repeated, swapped) are
    aligned in one sweep: each continues the alignment that ends nearest before it, or begins one.
    """
    often = Counter(there)
    anchors = [k for k, place in enumerate(there) if often[place] == 1]
    first = [anchors[k] for k in longest_chain([there[k] for k in anchors])]
    out, aligned = ([first] if first else []), set(first)
    later: list[list[int]] = []
    tops: list[int] = []  # minus the places at which these end, which keeps them ascending
    for k, place in enumerate(there):
        if k in aligned:
            continue
        p = bisect_right(tops, -place)
        if p == len(tops):
            tops.append(-place)
            later.append([k])
        else:
            tops[p] = -place
            later[p].append(k)
    return out + later


def blocks(place: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where the blocks begin among windows at ``place`` (ascending) that stand at ``there`` in the earlier text."""
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(there) != 1)
    return np.flatnonzero(new)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """All runs of ``size`` words within the texts of a column: their hashes, places and links.

    The link of a window is the least hash of the runs of ``size // 2`` words in it. Equal windows have equal links,
    and as neighbouring windows mostly share theirs, there are some five links for a hundred words at ``size`` 40.
    """

    def __init__(self, column: pa.Array, size: int):
        data, offsets = H.buffers(column)
        starts, ends, counts = H.runs(data, offsets, H._IS_WORD)
        words = H.run_hashes(data, starts, ends, H._BYTE)
        n = len(words)
        upto = np.concatenate([[0], np.cumsum(counts)])
        self.of = np.zeros(0, np.int64)
        self.hash = self.link = np.zeros(0, H.U64)
        self.start = self.stop = np.zeros(0, np.int64)
        if n < size:
            return
        sums = np.concatenate([np.zeros(1, H.U64), np.cumsum(words * H.powers(n)[:n], dtype=H.U64)])
        scale = np.full(n, H.U64(pow(int(H.powers(2)[1]), -1, 2**64)), dtype=H.U64)
        scale[0] = 1
        scale = np.multiply.accumulate(scale)

        def hashes(first, after):
            return H.mix64((sums[after] - sums[first]) * scale[first] + (after - first).astype(H.U64))

        text = np.repeat(np.arange(len(counts)), counts)
        half, every = size // 2, np.arange(n + 1)
        inside = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        self.of = text[inside]
        self.hashes, self.word = hashes, inside
        self.hash = hashes(inside, inside + size)
        self.link = window_min(hashes(every[: n - half + 1], every[half:]), size - half + 1)[inside]
        base = offsets[:-1][self.of]
        self.start = starts[inside] - base
        after = inside + size
        # up to the next word, or to the end of the text
        last = after == upto[1:][self.of]
        self.stop = np.where(last, offsets[1:][self.of], starts[np.minimum(after, n - 1)]) - base


def shared_links(docs: DataFrame, min_words: int) -> DataFrame:
    """``id, links``: the links of each id of ``docs(id, text)`` that stand at another place too."""

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text", PIECE):
                w = Windows(part.column(1), min_words)
                new = np.ones(len(w.of), bool)
                new[1:] = (w.link[1:] != w.link[:-1]) | (w.of[1:] != w.of[:-1])
                ids = part.column(0).take(pa.array(w.of[new]))
                yield pa.RecordBatch.from_arrays([pa.array(w.link[new].view(np.int64)), ids], ["link", "id"])

    links = written(docs.select("id", "text").mapInArrow(run, "link long, id long"), "line-all")
    several = links.groupBy("link").count().where("count > 1").select("link")
    return dealt_join(links, several, "link", "id").groupBy("id").agg(F.collect_set("link").alias("links"))


def dealt_join(rows: DataFrame, each: DataFrame, key: str, by: str) -> DataFrame:
    """The stored ``rows`` joined with ``each``, which has one row for a key, however many rows a key has.

    Rows are counted by cells of keys, of which there are ``CELLS``. The rows of a cell far above the mean are dealt over parts by
    the hash of ``by``, and its few rows of ``each`` are repeated for the parts. At most a quarter of the cells
    can be so far above the mean, so their list is bounded whatever the table.
    """
    cell = F.pmod(F.xxhash64(F.col(key)), F.lit(CELLS))
    counts = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.coalesce(F.sum("n"), F.lit(0)) / CELLS).scalar()
    doublings = F.ceil(F.log2(F.col("n") / F.greatest(F.lit(1000), 4 * mean))).cast("int").alias("doublings")
    hot = counts.select("cell", doublings).where("doublings > 0").groupBy("doublings").agg(F.collect_list("cell").alias("cells"))
    levels = hot.collect()
    if not levels:
        return rows.join(each, key)
    parts = F.lit(1)
    for r in levels:
        parts = F.when(cell.isin(r["cells"]), 2 ** r["doublings"]).otherwise(parts)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int"))
    each = each.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(each, [key, "_part"]).drop("_part")


def expanded(held: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Place, start, stop, first holder and place there of each window of stretches ``(place, starts, stops, a, there, better)``."""
    steps = held.field("starts")
    sizes = steps.value_lengths().to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    number = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    out = [np.repeat(held.field("place").to_numpy(), sizes) + number]
    for name in ("starts", "stops"):
        sums = np.cumsum(held.field(name).flatten().to_numpy().astype(np.int64))
        out.append(sums - np.repeat(np.concatenate([[0], sums])[first], sizes))
    a = np.repeat(held.field("a").to_numpy(), sizes)
    there = np.repeat(held.field("there").to_numpy(), sizes).astype(np.int64) + number
    better = held.field("better")
    many = better.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = better.flatten()
    at = np.repeat(first, many) + flat.field("number").to_numpy()
    a[at] = flat.field("a").to_numpy()
    there[at] = flat.field("there").to_numpy()
    return out[0].astype(np.int64), out[1], out[2], a, there


def without_edges(place: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    """Marks the windows that count, of those at ``place`` (sorted) that ``a`` hold first.

    A block ends where its earlier holder's does: fewer than MIN_LINE words that only a later holder adds to
    one of its ends are no line and stay.
    """
    keep = np.ones(len(place), bool)
    begins = np.flatnonzero(np.concatenate([[True], place[1:] - place[:-1] > size]))
    for first, last in zip(begins.tolist(), [*(begins[1:] - 1).tolist(), len(place) - 1]):
        for i, step in ((first, 1), (last, -1)):
            for j in range(i + step, i + MIN_LINE * step, step):
                if not first <= j <= last or abs(place[j] - place[i]) >= MIN_LINE:
                    break
                if a[j] < a[i]:
                    keep[i:j:step] = False
                    break
    return keep


def stretches(texts: DataFrame, min_words: int) -> DataFrame:
    """The windows of ``texts(id, digest, text, links)`` with one of the ``links``, a row for each stretch of neighbours with
    the same link: ``stretch`` (a hash of its words), the place of the first window, how far the bytes at
    which windows start and stop are from those of the window before, and the windows' hashes."""

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text", PIECE):
                w = Windows(part.column(2), min_words)
                first = np.searchsorted(w.of, np.arange(part.num_rows + 1))
                keep = np.zeros(len(w.of), bool)
                for k in range(part.num_rows):
                    mine = slice(first[k], first[k + 1])
                    shared = part.column(3)[k].values.to_numpy(zero_copy_only=False).view(H.U64)
                    keep[mine] = np.isin(w.link[mine], shared)
                kept = np.flatnonzero(keep)
                if not len(kept):
                    continue
                of, link = w.of[kept], w.link[kept]
                new = np.ones(len(kept), bool)
                new[1:] = (kept[1:] != kept[:-1] + 1) | (of[1:] != of[:-1]) | (link[1:] != link[:-1])
                begin = np.flatnonzero(new)
                end = np.concatenate([begin[1:], [len(kept)]])
                offsets = pa.array(np.concatenate([begin, [len(kept)]]).astype(np.int32))

                def steps(x):
                    out = x.copy()
                    out[1:] -= x[:-1]
                    out[begin] = x[begin]
                    return pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.int32)))

                at = pa.array(of[begin])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.hashes(w.word[kept[begin]], w.word[kept[end - 1]] + min_words).view(np.int64)),
                        pa.array(link[begin].view(np.int64)), part.column(0).take(at), part.column(1).take(at),
                        pa.array((kept[begin] - first[of[begin]]).astype(np.int32)), steps(w.start[kept]), steps(w.stop[kept]),
                        pa.ListArray.from_arrays(offsets, pa.array(w.hash[kept].view(np.int64))),
                    ],
                    ["stretch", "link", "id", "digest", "place", "starts", "stops", "windows"],
                )

    kind = "stretch long, link long, id long, digest long, place int, starts array<int>, stops array<int>, windows array<long>"
    return texts.mapInArrow(run, kind)


def holders(rows: DataFrame) -> DataFrame:
    """``stretch, a, there, better``: the first document ``a`` with each stretch that is held more than once and its place
    there, and the windows of it, by number, that an even earlier one holds, with the first that does and the place there.

    Who first holds a window first holds the stretch it stands in there. So only first holders of stretches are
    compared window by window, and only under lines of which there are several.
    """
    first = F.min(F.struct(F.col("id").alias("a"), F.col("place").alias("there")))
    held = rows.groupBy("stretch").agg(first.alias("f"), F.max("id").alias("z"), F.min("link").alias("link"))
    held = written(held.select("stretch", "f.a", "f.there", "z", "link"), "line-stretches")
    several = held.groupBy("link").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x < y").select("link")
    open_ = dealt_join(held, several, "link", "stretch").select("stretch", F.col("a").alias("id"), F.col("there").alias("place"))
    each = rows.join(open_, ["stretch", "id", "place"]).select("stretch", "id", "place", F.posexplode("windows").alias("number", "window"))
    each = written(each, "line-windows")
    earliest = F.min(F.struct(F.col("id").alias("a"), (F.col("place") + F.col("number")).alias("there")))
    shared = each.groupBy("window").agg(earliest.alias("f"), F.max("id").alias("z")).where("f.a < z").select("window", "f.*")
    better = dealt_join(each, shared, "window", "stretch").where("a < id")
    better = better.groupBy("stretch").agg(F.collect_set(F.struct("number", "a", "there")).alias("better"))
    return held.join(better, "stretch", "left").where("a < z OR better IS NOT NULL").select("stretch", "a", "there", "better")


def held_before(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """``id, digest, a, spans, size``: the byte ranges of a text that are aligned with blocks of ``a``, a < id."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    links = written(shared_links(source, min_words), "line-links")
    own = source.join(broadcast_if_few(links.select("id")), "id", "left_semi") if links.count() <= 500_000 else source
    rows = stretches(own.join(links, "id").select("id", F.xxhash64("text").alias("digest"), "text", "links"), min_words)
    rows = written(rows, "line-rows")
    later = rows.drop("windows", "link").join(written(holders(rows), "line-holders"), "stretch").where("a < id OR better IS NOT NULL")
    grouped = later.groupBy("id", "digest").agg(F.collect_list(F.struct("place", "starts", "stops", "a", "there", "better")).alias("held"))

    @frugal
    def aligned_blocks(batches):
        for batch in batches:
            rows, holding, spans, sizes = [], [], [], []
            for k in range(batch.num_rows):
                place, start, stop, a, there = expanded(batch.column(2)[k].values)
                earlier = np.flatnonzero(a < batch.column(0)[k].as_py())
                earlier = earlier[np.argsort(place[earlier])]
                if not len(earlier):
                    continue
                kept = earlier[without_edges(place[earlier], a[earlier], min_words)]
                kept = kept[np.argsort(a[kept], kind="stable")]
                pairs = np.flatnonzero(np.concatenate([[True], np.diff(a[kept]) != 0]))
                for own in np.split(kept, pairs[1:]):
                    begins = blocks(place[own], there[own])
                    starts = start[own[begins]].tolist()
                    stops = stop[own[np.concatenate([begins[1:], [len(own)]]) - 1]].tolist()
                    aligned = sorted(b for chain in patience(there[own[begins]].tolist()) for b in chain)
                    joined: list = []
                    for b in aligned:
                        if joined and starts[b] <= joined[-1]["stop"]:
                            joined[-1]["stop"] = max(stops[b], joined[-1]["stop"])
                        else:
                            joined.append({"start": starts[b], "stop": stops[b]})
                    rows.append(k)
                    holding.append(int(a[own[0]]))
                    spans.append(joined)
                    sizes.append(sum(x["stop"] - x["start"] for x in joined))
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(holding, pa.int64())]
            columns += [pa.array(spans, _SPANS), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "a", "spans", "size"])

    return grouped.mapInArrow(aligned_blocks, f"id long, digest long, a long, spans {_SPANS_SQL}, size long")


def spared(held: DataFrame, docs: DataFrame, id_col: str, text: str, percent: int, shingle: int) -> DataFrame:
    """``id, digest, a``: texts to be left whole as to ``a``, as near-duplicate removal drops them whole.

    ``a`` is the earlier document that holds most of the text. Their similarity is taken exactly, on what line
    deduplication leaves of both: ``a`` without all its repeats, the later text without what others than ``a`` hold. It
    holds good only where ``a`` is not spared itself, so a text next to a spared one is cut.
    """
    top = held.groupBy("id", "digest").agg(F.max_by("a", F.struct("size", -F.col("a"))).alias("top"))
    parts = held.join(top, ["id", "digest"])
    both = parts.groupBy("id", "digest", "top").agg(
        F.flatten(F.collect_list("spans")).alias("every"),
        F.flatten(F.collect_list(F.when(F.col("a") != F.col("top"), F.col("spans")))).alias("others"),
    )
    both = written(both, "line-tops")
    wanted = both.select("id").union(both.select(F.col("top").alias("id"))).distinct()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    texts = source.join(broadcast_if_few(written(wanted, "line-ids")), "id", "left_semi").withColumn("digest", F.xxhash64("text")).distinct()
    texts = texts.join(both, ["id", "digest"], "left")
    nothing = F.array().cast(_SPANS_SQL)
    left = texts.select(
        "id", "digest", "top", cut(F.col("text"), F.coalesce("every", nothing)).alias("text_a"),
        F.when(F.col("top").isNotNull(), cut(F.col("text"), F.coalesce("others", nothing))).alias("text_b"),
    )
    left = written(left, "line-texts")
    later = left.where("top IS NOT NULL").select("id", "digest", F.col("top").alias("a"), "text_b")
    pairs = later.join(left.select(F.col("id").alias("a"), "text_a"), "a").select("id", "digest", "a", "text_a", "text_b")

    @frugal
    def run(batches):
        for batch in batches:
            for part in H.pieces(batch, "text_a", 1_000_000):
                one, two = (H.shingles(*H.words(part.column(i)), shingle) for i in (3, 4))
                alike = []
                for x, y in zip(one, two):
                    union = len(np.unique(np.concatenate([x, y])))
                    alike.append(bool(len(x) and len(y)) and 100 * (len(x) + len(y) - union) >= percent * union)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(alike, pa.bool_())], ["id", "digest", "a", "alike"])

    tested = pairs.mapInArrow(run, "id long, digest long, a long, alike boolean")
    # of an id with several texts each must be alike
    alike = written(tested.groupBy("id", "digest", "a").agg(F.bool_and("alike").alias("alike")).where("alike"), "line-alike")
    return alike.join(alike.select(F.col("id").alias("a")), "a", "left_anti").select("id", "digest", "a")


def repeated_blocks(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, spare: float | None = None
) -> DataFrame:
    """``id, digest, spans``: for each document what is to be deleted, as byte ranges of its UTF-8 text.

    ``digest`` is ``xxhash64`` of the text the spans belong to. With ``spare`` set, a pair is left alone if the
    Jaccard similarity of its five-word shingles is ``spare`` or more: whole copies are then for near-duplicate
    removal at that similarity, which drops them in one piece.
    """
    held = written(held_before(docs, id_col, text, min_words), "line-held")
    if spare is not None:
        held = held.join(spared(held, docs, id_col, text, round(100 * spare), 5), ["id", "digest", "a"], "left_anti")
    return held.groupBy("id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut(text: Column, spans: Column) -> Column:
    """The text without the bytes of its spans, and without white space left over at its end."""
    raw = text.cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("kept"))

    def step(done, span):
        gap = F.greatest(span["start"] - done["at"], F.lit(0))
        return F.struct(
            F.greatest(done["at"], span["stop"]).alias("at"),
            F.concat(done["kept"], raw.substr((done["at"] + 1).cast("int"), gap.cast("int"))).alias("kept"),
        )

    def end(done):
        return F.concat(done["kept"], raw.substr((done["at"] + 1).cast("int"), F.lit(2147483647)))

    return F.rtrim(F.decode(F.aggregate(F.array_sort(spans), start, step, end), "utf-8"), F.lit(" \t\n\r\v\f"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, spare: float | None = None
) -> DataFrame:
    """``docs`` with blocks that an earlier document holds deleted from ``text``, and ``words_before`` (a
    column of this name is replaced).

    The earlier document is the one with the smaller id. ``words_before`` is the number of words a changed text
    had, null for texts left as they are, among them null and empty ones and rows without an id. Rows
    that repeat an id and a text are one document and are not cut because of each other.
    """
    blocks = written(repeated_blocks(docs, id_col, text, min_words, spare), "line-blocks")
    own = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest")
    )
    if blocks.count() <= 500_000:  # texts that stay as they are stay where they are
        ids = F.broadcast(blocks.select("id", "digest"))
        rest = own.join(ids, ["id", "digest"], "left_anti").withColumn("spans", F.lit(None).cast(_SPANS_SQL))
        own = own.join(ids, ["id", "digest"], "left_semi")
        marked = own.join(blocks, ["id", "digest"]).unionByName(rest)
    else:
        marked = own.join(blocks, ["id", "digest"], "left")
    changed, before = F.col("spans").isNotNull(), F.col("row").getField(text)
    words = F.regexp_count(before, F.lit(r"[^\x20\x09-\x0D]+"))
    after = F.when(changed, cut(before, F.col("spans"))).otherwise(before)
    kept = [after.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != "words_before"]
    return marked.select(*kept, F.when(changed, words).alias("words_before"))


def op10_line_dedup(spark, sf_dir):
    """Delete from every document the blocks of 40 words or more that an earlier one holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    after = without_repeats(docs).withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))

    @frugal
    def counted(batches):
        for batch in batches:
            for part in H.pieces(batch, "text", PIECE):
                own = pa.array(H.word_counts(part.column(1)))
                deleted = pc.subtract(pc.coalesce(part.column(2).cast(pa.int64()), own), own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), deleted, own, part.column(3)], ["doc_id", "words_deleted", "n_words", "text_crc32"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return after.mapInArrow(counted, f"doc_id {kind}, words_deleted long, n_words long, text_crc32 long")
