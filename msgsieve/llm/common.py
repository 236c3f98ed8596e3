"""What several operators share: reading, held-out marks, written tables, ranks and components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from msgsieve.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with no lineage to recompute."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which the worker gives back to the system what it has freed.

    A worker outlives its task and idles beside the stages that follow: what its allocators keep would be missing there.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return freed memory that Arrow and the C library keep for later; of other libraries than glibc, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def broadcast_if_few(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored table of short rows, to be broadcast if it has at most ``rows`` of them; beyond, it is joined
    like any other. Meant for lists of ids that select texts: the texts then stay where they are."""
    return F.broadcast(table) if table.count() <= rows else table


def rank_within(df: DataFrame, key: str, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Add ``name``: the row's place (from 0) within its key, in any fixed order of hash buckets.

    Rows of a key are dealt over hash buckets, counted per (key, bucket), and ranked within a bucket on
    top of the counts before it, so one key may hold most rows. ``order`` must tell rows apart; rows
    alike in all of it are interchangeable. The input is read twice: pass a written table.
    """
    own_key = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    marked = df.withColumns({"_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"), "_key": own_key})
    counts = marked.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_key").orderBy("_bucket")) - F.col("_n")
    base = counts.select("_key", "_bucket", before.alias("_base"))
    here = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy(*order)) - 1
    return (
        marked.withColumn("_here", here)
        .join(base, ["_key", "_bucket"])
        .withColumn(name, (F.col("_base") + F.col("_here")).cast("long"))
        .select(*df.columns, name)
    )


def ordered_rank(df: DataFrame, key: str, order: list[str], name: str, total: str) -> DataFrame:
    """Add ``name``, the row's place (from 0) within its key in the order of ``order``, and ``total``, the rows of the key.

    Rows are dealt by ranges of (key, order) and sorted there, so one key may hold most rows and fills several
    ranges. One row for each (key, range) says how many rows of the key stand before it. Nulls come
    first; rows alike in key and order are interchangeable. The input is read twice: pass a written table.
    """
    sort = [key, *order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "ranges").withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    own = W.partitionBy(key)
    before = F.sum("_n").over(own.orderBy("_part")) - F.col("_n") - F.col("_first")
    starts = written(runs.select(key, "_part", before.alias("_base"), F.sum("_n").over(own).alias("_total")), "starts")
    return placed.join(broadcast_if_few(starts), [key, "_part"]).select(
        *df.columns, (F.col("_base") + F.col("_place")).alias(name), F.col("_total").alias(total)
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the component its smallest node.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes:
    then every node hangs on the smallest one. Nodes without an edge to another node do not appear.
    """
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = (
            both.join(least.withColumn("m", F.least("u", "m")), F.col("a") == F.col("u"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            large.join(least, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        now = written(small, "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.selectExpr("a AS node", "b AS component").union(
                now.selectExpr("b AS node", "b AS component").distinct()
            )
        seen = mark
