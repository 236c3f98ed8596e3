"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all norms equal; nearest in the plane is then largest in inner
product, and queries get a zero there. A bounded sample of vectors is halved again and again at the median
between two means until parts are small: the means of the parts, put on the vectors' sphere, are the centroids, and as parts are alike in
size, so are the posting lists. The centroids form an in-memory graph (each with its nearest and a few far
ones) which every worker searches with a beam.

Every vector goes to its nearest list and, if it lies on a boundary, also to lists that are at most
``NEAR`` times as far; a list is left out if a chosen centroid is much closer to its centroid than the vector is
(``APART``), as it would be searched along with that one. A query takes the lists that are at most ``REACH`` times as far as the
nearest, and in any case lists with several times as many vectors as it is to return. Scores are computed on the original vectors in double precision.

Equal vectors are one until the end, with the smallest ids that a result can hold, so copies of one vector, be
they a third of all rows, cost as much as one. Long lists and lists that many queries want are dealt over
blocks; a task sees one block of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from msgsieve.llm.common import read, written

SAMPLE = 20_000
LIST_SIZE = 256
SMALLEST_PART = 16
DEGREE = 12
REPLICAS = 4
NEAR = 1.12
APART = 0.5
REACH = 1.19
#: Up to so many centroids are simply all looked at.
FEW = 48
POSTING_BLOCK = 4096
QUERY_BLOCK = 1024


@dataclass(frozen=True)
class Lists:
    """Centroids, their graph (a row of neighbours each) and the square of the largest norm."""

    centroids: np.ndarray
    graph: np.ndarray
    top: float


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))])


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of equal size: every part is halved at the median until there are ``lists``."""
    parts, rounds = [np.arange(len(x))], int(np.ceil(np.log2(max(lists, 1))))
    for _ in range(rounds):
        halves = []
        for part in parts:
            if len(part) < 2 * SMALLEST_PART:
                halves.append(part)
                continue
            own = x[part]
            mean = own.mean(axis=0)
            a = own[np.argmax(((own - mean) ** 2).sum(axis=1))]
            b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
            for _ in range(6):
                side = own @ (a - b)
                low = np.argsort(side, kind="stable")
                half = len(low) // 2
                b, a = own[low[:half]].mean(axis=0), own[low[half:]].mean(axis=0)
            halves += [part[low[:half]], part[low[half:]]]
        parts = halves
    means = np.array([x[p].mean(axis=0) for p in parts])
    lengths = np.linalg.norm(means, axis=1, keepdims=True)
    return means * (np.sqrt((x * x).sum(axis=1).max()) / np.where(lengths > 0, lengths, 1.0))


def neighbour_graph(centroids: np.ndarray) -> np.ndarray:
    """For each centroid its nearest others and, so that all can be reached, some spread over the rest."""
    n = len(centroids)
    near, far = min(DEGREE - 2, n - 1), min(2, n - 1)
    if n == 1:
        return np.zeros((1, 1), dtype=np.int64)
    d = squared(centroids, centroids)
    np.fill_diagonal(d, np.inf)
    nearest = np.argsort(d, axis=1, kind="stable")[:, :near]
    jumps = (np.arange(n)[:, None] + (np.arange(1, far + 1) * max(1, n // (far + 1)))[None, :]) % n
    return np.concatenate([nearest, jumps], axis=1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :], 0.0)


def search_graph(lists: Lists, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for all rows of ``x`` at once: centroid numbers and squared distances, nearest first."""
    n, rows = len(lists.centroids), np.arange(len(x))
    if n <= FEW or n == beam:
        d = squared(x, lists.centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(d, order, axis=1)
    known = np.full((len(x), n), np.inf)
    done = np.zeros((len(x), n), dtype=bool)
    entries = np.linspace(0, n - 1, 8).astype(np.int64)
    known[:, entries] = squared(x, lists.centroids[entries])
    norms, own = (lists.centroids**2).sum(axis=1), (x * x).sum(axis=1)
    for _ in range(n):
        best = np.argpartition(known, beam - 1, axis=1)[:, :beam]
        open_best = np.where(np.take_along_axis(done, best, axis=1), np.inf, np.take_along_axis(known, best, axis=1))
        # expand the few nearest open ones of every row
        step = np.take_along_axis(best, np.argsort(open_best, axis=1)[:, :4], axis=1)
        live = np.isfinite(np.sort(open_best, axis=1)[:, 0])
        if not live.any():
            break
        active = rows[live]
        done[active[:, None], step[live]] = True
        to = lists.graph[step[live]].reshape(len(active), -1)
        d = own[active][:, None] - 2 * np.einsum("rkd,rd->rk", lists.centroids[to], x[active]) + norms[to]
        known[active[:, None], to] = np.maximum(d, 0.0)
    best = np.argpartition(known, beam - 1, axis=1)[:, :beam]
    d = np.take_along_axis(known, best, axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(best, order, axis=1), np.take_along_axis(d, order, axis=1)


def posting_lists(lists: Lists, x: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and others nearly as near in other directions."""
    at, d = search_graph(lists, x, min(32, len(lists.centroids)))
    out = []
    for numbers, far in zip(at, np.sqrt(d)):
        chosen = [int(numbers[0])]
        for number, distance in zip(numbers[1:].tolist(), far[1:].tolist()):
            if len(chosen) == REPLICAS or distance > NEAR * far[0]:
                break
            between = np.sqrt(((lists.centroids[chosen] - lists.centroids[number]) ** 2).sum(axis=1))
            if (between >= APART * distance).all():
                chosen.append(number)
        out.append(np.array(chosen))
    return out


def query_lists(lists: Lists, q: np.ndarray, reach: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """The lists of each query: those within ``reach``, and the nearest that hold ``least`` vectors."""
    n = len(lists.centroids)
    at, d = search_graph(lists, q, n if n <= FEW else max(FEW, 3 * n // 4))
    far = np.sqrt(d)
    before = np.cumsum(sizes[at], axis=1) - sizes[at]
    return [numbers[(row <= reach * row[0]) | (held < least)] for numbers, row, held in zip(at, far, before)]


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def taking_part(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, vector``: rows with an id whose vector is of the commonest length and finite, and not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).where(
        "id IS NOT NULL AND vector IS NOT NULL"
    )
    rows = rows.where(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (common["n"] if common else 0)).distinct()


def fit(distinct: DataFrame, sample: int = SAMPLE, list_size: int = LIST_SIZE) -> Lists:
    """Centroids and graph from at most ``sample`` vectors, drawn by hash."""
    rows = distinct.orderBy(F.xxhash64("vector"), "rep").limit(sample).select("vector").toArrow()
    n, top = distinct.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    x = lifted(matrix(rows.column(0)), top)
    lists = min(max(1, n // list_size), max(1, len(x) // SMALLEST_PART))
    centroids = balanced_centroids(x, lists)
    return Lists(centroids, neighbour_graph(centroids), float(top))


def _listed(df: DataFrame, columns: list[str], choose, lists: Lists, is_query: bool) -> DataFrame:
    """``df`` with a row for each of its lists."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema) + ", list int"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = matrix(part.column(columns.index("vector")))
                x = np.column_stack([x, np.zeros(len(x))]) if is_query else lifted(x, lists.top)
                chosen = choose(lists, x)
                rows = pa.array(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in part.columns), pa.array(np.concatenate(chosen), pa.int32())], [*columns, "list"]
                )

    return df.select(*columns).mapInArrow(run, schema)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then smallest id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def nearest(
    vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", reach: float = REACH
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest inner product that are found.

    ``queries`` is a condition on the id. A query does not find rows with its own id; with fewer candidates all are returned that
    its lists hold. Null, zero and non-finite vectors, vectors of another length than most and
    rows without an id take no part; rows alike in id and vector count once. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = written(taking_part(vectors, id_col, vector), "vectors")
    place = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= k + 1)
    distinct = written(
        few.groupBy("vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")), "distinct-vectors"
    )
    empty = "query_id long, rank int, vec_id long, score double"
    if distinct.isEmpty():
        return spark.createDataFrame([], empty)
    lists = fit(distinct)
    postings = written(_listed(distinct, ["rep", "vector", "ids"], posting_lists, lists, False), "posting-lists")
    sizes = np.zeros(len(lists.centroids), dtype=np.int64)  # a number for each list, which the sample bounds
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    asking = rows.where(queries(F.col("id"))).join(distinct.select("vector", "rep"), "vector").select("id", "rep", "vector")
    asking = written(asking, "queries")
    wanted = written(
        _listed(
            asking.select("rep", "vector").distinct(), ["rep", "vector"],
            lambda m, x: query_lists(m, x, reach, sizes, 16 * (k + 1)), lists, True,
        ),
        "query-lists",
    )
    blocks = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("q")).join(
        postings.groupBy("list").agg(F.count(F.lit(1)).alias("p")), "list"
    ).select("list", F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qs"), F.ceil(F.col("p") / POSTING_BLOCK).cast("int").alias("ps"))
    left = wanted.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("rep"), F.col("qs")).cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("x"),
        F.col("rep").alias("q"), F.col("vector").alias("q_vector"),
    )
    right = postings.join(blocks, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("y"), F.pmod(F.xxhash64("rep"), F.col("ps")).cast("int").alias("x"),
        "vector", "ids",
    )

    def search(key, a, b):
        q, x = matrix(a.column("q_vector")), matrix(b.column("vector"))
        names = a.column("q").to_pylist()
        ids = b.column("ids").combine_chunks() if isinstance(b.column("ids"), pa.ChunkedArray) else b.column("ids")
        sizes = np.diff(np.asarray(ids.offsets))
        flat, of = np.asarray(ids.flatten()), np.repeat(np.arange(len(sizes)), sizes)
        out = []
        scores = q @ x.T if len(x) and len(q) else np.zeros((len(q), 0))
        for row in scores:
            own = row[of]
            at = best(own, flat, k + 1)
            out.append((flat[at], own[at]))
        return pa.Table.from_arrays(
            [pa.array(names, pa.int64()), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.float64()))],
            ["q", "ids", "scores"],
        )

    found = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(search, "q long, ids array<long>, scores array<double>")

    def merge(key, table):
        """The best of what the lists of a query gave, each id once."""
        ids, score = (np.concatenate([x.values.to_numpy() for x in table.column(c)]) for c in ("ids", "scores"))
        ids, first = np.unique(ids, return_index=True)
        at = best(score[first], ids, k + 1)
        return pa.Table.from_arrays([pa.array(np.full(len(at), key[0].as_py())), pa.array(ids[at]), pa.array(score[first][at])], ["q", "vec_id", "score"])

    # A group has k + 1 rows for each list of one query.
    kept = written(found.where(F.size("ids") > 0).groupBy("q").applyInArrow(merge, "q long, vec_id long, score double"), "found")
    of_query = W.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id")
    return (
        asking.select(F.col("id").alias("query_id"), "rep")
        .join(kept.withColumnRenamed("q", "rep"), "rep")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(of_query))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_nearest(spark, sf_dir):
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
