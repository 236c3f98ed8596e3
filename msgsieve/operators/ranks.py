"""Exact cuts of an ordered table without sorting the table.

Both operators here answer "which row is the q-th of its group" for a few q. They count rows per
(group, bucket), find the one bucket each cut falls in from prefix sums of that bounded count table,
and rank only the rows of those buckets. Everything else is decided by comparing with the cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from msgsieve.schema import FOLDS, SEED, TEST_SHARE

# Four hex digits of the hash: at most 65,536 count rows per stratum.
BUCKET_DIGITS = 4
# Up to so many strata the cut keys are broadcast; beyond, they are joined like any table.
FEW_STRATA = 10_000


def shuffled_order(id_col: str, seed: int) -> Column:
    """A reproducible random order: the hash of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def assign_blocks(
    df: DataFrame, strata: list[str], cuts_of, block_col: str, id_col: str = "row_id", seed: int = SEED
) -> DataFrame:
    """Number the contiguous blocks of each stratum in hash order.

    ``cuts_of(totals)`` takes ``(strata..., n)`` and returns ``(strata..., cut, upto)``: block ``cut``
    ends after the ``upto``-th row. The rows themselves are not shuffled: each meets the cut keys of
    its stratum in a join whose small side, of strata x cuts rows, is broadcast if there are few strata. A missing value is a stratum like any
    other.
    """
    # Strata as one text that is never missing, so that every join is an equality.
    key = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})
    keys = df.select(
        *strata, key.alias("_key"), F.col(id_col).alias("_id"), shuffled_order(id_col, seed).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    totals = keys.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    cuts = cuts_of(totals).withColumn("_key", key).drop(*strata)
    small = F.broadcast if totals.limit(FEW_STRATA + 1).count() <= FEW_STRATA else lambda table: table
    keys = keys.drop(*strata)
    counts = keys.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    upto = F.sum("_n").over(W.partitionBy("_key").orderBy("_bucket"))
    prefix = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    # A cut at 0 or beyond the last row has no bucket; it is handled below by its own key.
    cut_buckets = (
        prefix.join(small(cuts), "_key")
        .where((F.col("upto") > F.col("_before")) & (F.col("upto") <= F.col("_upto")))
        .select("_key", "_bucket", "cut", (F.col("upto") - F.col("_before")).alias("_rank"))
    )
    wanted = cut_buckets.groupBy("_key", "_bucket").agg(
        F.collect_list(F.struct("_rank", "cut")).alias("_wanted")
    )
    in_bucket = W.partitionBy("_key", "_bucket").orderBy("_hash", "_id")
    cut_keys = (
        keys.join(small(wanted), ["_key", "_bucket"])
        .withColumn("_row", F.row_number().over(in_bucket))
        .select("_key", "_hash", "_id", "_row", F.inline("_wanted"))
        .where(F.col("_row") == F.col("_rank"))
        .select("_key", "_hash", "_id")
    )
    empty_cuts = cuts.where(F.col("upto") <= 0).select(
        "_key", F.lit("").alias("_hash"), F.lit(None).cast(df.schema[id_col].dataType).alias("_id")
    )
    thresholds = (
        cut_keys.unionByName(empty_cuts)
        .groupBy("_key")
        .agg(F.collect_list(F.struct("_hash", "_id")).alias("_cuts"))
    )
    here = F.struct(shuffled_order(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))
    passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda cut: cut < here))
    return (
        df.withColumn("_key", key)
        .join(small(thresholds), "_key", "left")
        .withColumn(block_col, passed)
        .select(*df.columns, block_col)
    )


def pick_position(df: DataFrame, group: list[str], block: str, order: str, position: int) -> DataFrame:
    """The row at ``position`` (from 1) of each group, groups with fewer rows having none.

    ``block`` cuts a group's order into contiguous parts, for example the splits of a file or the beginnings of names: rows
    of a smaller block stand before those of a larger one. Blocks are counted, and only the one block that holds the
    position is ranked by ``order``. A missing group is a group like any other.
    """
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_key", key)
    counts = keyed.groupBy("_key", block).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("_key").orderBy(block))
    placed = counts.withColumn("_upto", upto).withColumn("_rank", position - (F.col("_upto") - F.col("_n")))
    holding = placed.where((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n"))).select("_key", F.col(block).alias("_block"), "_rank")
    here = keyed.join(holding, (keyed["_key"] == holding["_key"]) & keyed[block].eqNullSafe(holding["_block"])).drop(holding["_key"])
    ranked = here.withColumn("_row", F.row_number().over(W.partitionBy("_key", "_block").orderBy(order)))
    return ranked.where(F.col("_row") == F.col("_rank")).select(*df.columns)


def train_quotas(totals: DataFrame, strata: list[str], test_share: float = TEST_SHARE) -> DataFrame:
    """Training rows per stratum by largest remainder, ties by stratum name.

    The test set has ceil(share x n) rows. Integer arithmetic keeps the remainders exact. The input
    has one row per stratum, so the single-partition windows see a handful of rows.
    """
    everything = W.partitionBy(F.lit(1))
    with_n = totals.withColumn("_total", F.sum("n").over(everything)).withColumn(
        "_train", F.col("_total") - F.ceil(F.lit(float(test_share)) * F.col("_total"))
    ).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("_total", "_train")})
    shares = with_n.withColumn(
        "_floor", F.expr("(CAST(n AS decimal(38,0)) * _train) DIV _total")
    ).withColumn("_rest", F.expr("CAST(n AS decimal(38,0)) * _train - CAST(_floor AS decimal(38,0)) * _total"))
    by_rest = everything.orderBy(F.col("_rest").desc(), *strata)
    return (
        shares.withColumn("_missing", F.col("_train") - F.sum("_floor").over(everything))
        .withColumn("_place", F.row_number().over(by_rest))
        .select(
            *strata,
            "n",
            (F.col("_floor") + (F.col("_place") <= F.col("_missing")).cast("long")).cast("long").alias("train_rows"),
        )
    )


def stratified_split(
    df: DataFrame,
    strata=("label", "channel"),
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    id_col: str = "row_id",
) -> DataFrame:
    """Add ``split``: an exact train/test split of every stratum."""
    strata = list(strata)

    def cuts(totals):
        quotas = train_quotas(totals, strata, test_share)
        return quotas.select(*strata, F.lit(0).alias("cut"), F.col("train_rows").alias("upto"))

    blocks = assign_blocks(df, strata, cuts, "_block", id_col, seed)
    split = F.when(F.col("_block") == 0, "train").otherwise("test")
    return blocks.withColumn("split", split).drop("_block")


def kfold(
    df: DataFrame, strata=("label",), folds: int = FOLDS, seed: int = SEED, id_col: str = "row_id"
) -> DataFrame:
    """Add ``fold`` 0..folds-1; the folds of a stratum differ by at most one row."""
    strata = list(strata)

    def cuts(totals):
        ends = [
            F.struct(
                F.lit(f).alias("cut"),
                reduce(
                    lambda a, b: a + b,
                    [F.floor((F.col("n") + (folds - 1 - g)) / folds) for g in range(f + 1)],
                )
                .cast("long")
                .alias("upto"),
            )
            for f in range(folds - 1)
        ]
        return totals.select(*strata, F.inline(F.array(*ends)))

    return assign_blocks(df, strata, cuts, "fold", id_col, seed)


def exact_quantiles(
    df: DataFrame, col: str, probs, low: float | None = None, high: float | None = None, buckets: int = 4096
) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``(prob, value)``.

    Rows are first counted per distinct value, so a value held by a third of all rows becomes one
    row. ``low`` and ``high`` only size the buckets, by default to the range of the data; values outside go
    to the first or last one.
    """
    if low is None or high is None:
        low, high = (float(x) if x is not None else 0.0 for x in df.agg(F.min(col), F.max(col)).first())
    width = (high - low) / buckets or 1.0
    bucket = F.greatest(
        F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col("_v") - low) / width).cast("int"))
    )
    values = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", bucket)
    )
    counts = values.groupBy("_bucket").agg(F.sum("_n").alias("_bn"))
    ordered = W.partitionBy(F.lit(1)).orderBy("_bucket")
    prefix = counts.withColumn("_upto", F.sum("_bn").over(ordered)).withColumn(
        "_total", F.sum("_bn").over(W.partitionBy(F.lit(1)))
    )
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    ranks = prefix.withColumn("_before", F.col("_upto") - F.col("_bn")).withColumn(
        "_rank",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(float(p)).alias("prob"),
                        (f(place(p)) + 1).cast("long").alias("rank"),
                        F.lit(side).alias("side"),
                        (place(p) - F.floor(place(p))).alias("part"),
                    )
                    for p in probs
                    for side, f in (("low", F.floor), ("high", F.ceil))
                ]
            )
        ),
    )
    wanted = ranks.where(
        (F.col("_rank.rank") > F.col("_before")) & (F.col("_rank.rank") <= F.col("_upto"))
    ).groupBy("_bucket", "_before").agg(F.collect_list("_rank").alias("_wanted"))
    inside = W.partitionBy("_bucket").orderBy("_v")
    found = (
        values.join(F.broadcast(wanted), "_bucket")
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .select("_v", "_n", "_end", F.inline("_wanted"))
        .where((F.col("rank") <= F.col("_end")) & (F.col("rank") > F.col("_end") - F.col("_n")))
    )
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("_v")))
    return found.groupBy("prob").agg(
        (at("low") + (at("high") - at("low")) * F.max("part")).alias("value")
    )
