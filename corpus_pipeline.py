"""From raw documents to packed training sequences.

Every stage takes all that the stage before it kept, and is written as Parquet and read again, so a lost
executor costs one stage's tasks and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from msgsieve.llm.common import broadcast_if_few, ordered_rank, read, written
from msgsieve.llm.line_dedup import without_repeats
from msgsieve.llm.mixing import mixed
from msgsieve.llm.near_dedup import near_duplicates
from msgsieve.llm.packing import packed, tokenized
from msgsieve.llm.toxicity import CATEGORIES, THRESHOLD, categories_of, fit_chain, scored

#: Near dedup's own test. Line dedup leaves documents alone that meet it: near dedup drops them whole.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. It learns from those that ``labels`` covers."""
    chain = fit_chain(docs, categories_of(read(spark, sf_dir, "labels")), CATEGORIES)
    return scored(docs, chain).where(F.col("p_toxic") < THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; one of which nothing is left goes."""
    changed = F.col("words_before").isNotNull()
    after = without_repeats(docs, spare=PERCENT / 100).where(~changed | (F.col("text") != ""))
    return after.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group: five-word shingles, 0.8 or more.

    Of rows that repeat an id one stays; rows without an id stay.
    """
    groups = near_duplicates(docs, shingle=SHINGLE, percent=PERCENT)
    copies = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    kept = docs.join(broadcast_if_few(copies), "doc_id", "left_anti")
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    once = kept.join(broadcast_if_few(repeated), "doc_id", "left_anti")
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one_of = kept.join(broadcast_if_few(repeated), "doc_id", "left_semi").withColumn("_first", first).where("_first = 1")
    return once.select(*docs.columns).union(one_of.select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the interleaved order of their sources: file after file, row after row."""
    order = mixed(docs)
    return order.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens, in the order of ``docs``, a stored table.

    Pieces of one length take the planned places in that order, file after file and row after row, and sequences are numbered by
    the first document in them: so training reads the sources interleaved as ``mixing`` has them.
    """
    import public_tokenizers

    place = {"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")}
    order = ["_file", "_row", "piece"]
    ordered = tokenized(docs.withColumns(place), public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "_file", "_row"])
    pieces = packed(written(ordered, "pieces"), order, ranked=in_order)
    pieces = written(pieces, "packed")
    first = F.min(F.struct(*order)).alias("first")
    sequences = written(pieces.groupBy("sequence_id").agg(first).select("sequence_id", "first.*"), "sequences")
    numbered = ordered_rank(sequences.withColumn("_all", F.lit(0)), "_all", order, "_number", "_total").select("sequence_id", "_number")
    columns = [F.col("_number").alias(c) if c == "sequence_id" else F.col(c) for c in pieces.columns if c not in place]
    return pieces.join(numbered, "sequence_id").select(*columns)


def in_order(pieces: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``pieces`` with their rank ``name`` within ``key``, in that order."""
    return ordered_rank(pieces, key, order, name, "_of").drop("_of")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained chain nor the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
