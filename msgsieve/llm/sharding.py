"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in built-in functions only.

The shard of a key is the last jump below the number of shards. Jumps depend on the key alone: from shard
b the next one goes to ``(b + 1) * 2**31 / (r + 1)``, r being the upper 31 bits of a linear congruential generator
seeded with the key. So no table of shards is kept, every shard gets an equal share of the keys, and of n + 1 shards
only the last one receives rows, from all others alike.

Spark's whole numbers refuse to overflow, so the generator's 64 bits are held as two halves of 32 and multiplied
by 16 bits at a time.

Edge cases. Null ids count as one more id, 0 to the generator, and so share a shard; rows that repeat an id do too. Null
texts have 0 bytes and the checksum of the empty text. Other columns of the input pass through ``sharded``, whose own
columns replace those of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from msgsieve.llm.common import ordered_rank, read, written
from msgsieve.llm.crcsql import CRC_TABLE, crc32_sql

SHARDS = 40
#: Bytes a row takes besides its text.
ROW_BYTES = 16
#: Fixed value: the generator's multiplier.
MULTIPLIER = 2862933555777941757
#: Jumps that are tried for every row. A key that has not passed the last shard by then, about one in 10**9 of 40
#: shards, goes on for as many as there are shards, which always suffices.
USUAL_JUMPS = 24

_LOW32 = (1 << 32) - 1
_A0, _A1, _A2, _A3 = ((MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48))


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of ``key * MULTIPLIER + 1`` modulo 2**64; no sum here exceeds 2**52."""
    upper = lambda half, limb: F.shiftleft((half * limb).bitwiseAND(0xFFFF), 16)
    low = lo * _A0 + upper(lo, _A1) + 1
    high = F.shiftright(low, 32) + F.shiftright(lo * _A1, 16) + hi * _A0 + upper(hi, _A1) + lo * _A2 + upper(lo, _A3)
    return high.bitwiseAND(_LOW32), low.bitwiseAND(_LOW32)


def _next_jump(state: Column) -> Column:
    """Where the jump from the state's shard goes."""
    drawn = F.shiftright(state["hi"], 1) + 1
    return F.floor((state["shard"] + 1) * (F.lit(float(1 << 31)) / drawn))


def _state(shard: Column, hi: Column, lo: Column) -> Column:
    return F.struct(shard.cast("long").alias("shard"), hi.alias("hi"), lo.alias("lo"))


def _jumps(state: Column, shards: int, most: int) -> Column:
    def step(s, _):
        jump = _next_jump(s)
        return F.when(jump < shards, _state(jump, *_advance(s["hi"], s["lo"]))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step)


def with_jump(df: DataFrame, key: Column, shards: int, name: str, grown: str | None = None) -> DataFrame:
    """Add ``name``, the shard of the 64-bit integer ``key`` among ``shards``; and ``grown``, that among one more.

    Hash other kinds of keys first, for example with ``xxhash64``.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = _state(F.lit(0), *_advance(F.shiftrightunsigned(key, 32), key.bitwiseAND(_LOW32)))
    usual = df.withColumn("_jump", _jumps(start, shards, min(USUAL_JUMPS, shards)))
    state = F.col("_jump")
    passed = _next_jump(state) >= shards
    ended = usual.withColumn("_jump", F.when(passed, state).otherwise(_jumps(state, shards, shards)))
    out = ended.withColumn(name, F.col("_jump.shard").cast("int"))
    if grown:
        # The next jump is past the last shard; with one more it may land on that one.
        out = out.withColumn(grown, F.when(_next_jump(state) == shards, shards).otherwise(F.col(name)).cast("int"))
    return out.drop("_jump")


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``, the shard once one more is appended. Nothing is shuffled."""
    rest = docs.drop("shard", "grown_shard")
    return with_jump(rest, F.col(id_col), shards, "shard", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", files: int = 1) -> None:
    """Write the rows to ``path/shard=N``, each shard in ``files`` files dealt by a hash of the id.

    A shard may be as large as its keys make it; more files keep a task's share small.
    """
    placed = sharded(docs, shards, id_col).drop("grown_shard")
    file = F.pmod(F.xxhash64(id_col), F.lit(files))
    placed.repartition(shards * files, "shard", file).write.partitionBy("shard").parquet(path)


def moved(docs: DataFrame, old: int, new: int, id_col: str = "doc_id") -> DataFrame:
    """``id, shard, new_shard`` of the rows that change places when ``old`` shards become ``new``."""
    keys = docs.select(F.col(id_col).alias("id"))
    both = with_jump(with_jump(keys, F.col("id"), old, "shard"), F.col("id"), new, "new_shard")
    return both.where("shard <> new_shard")


def op13_sharding(spark, sf_dir):
    """Every document's shard of 40, its slot there in the order of ids, and its shard of 41."""
    docs = read(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    measured = docs.select("doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = written(sharded(measured), "shards")
    ranked = ordered_rank(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", "rows")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The published loop itself, on unsigned 128-bit numbers.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
sized AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32
    FROM documents, crc_table
),
states AS (
    SELECT id, 0 AS b, (id * {MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k
    FROM (SELECT DISTINCT coalesce(doc_id, 0)::UHUGEINT AS id FROM documents)
    UNION ALL
    SELECT id, j, (k * {MULTIPLIER}::UHUGEINT + 1) % 18446744073709551616::UHUGEINT
    FROM (SELECT *, floor((b + 1) * (2147483648::DOUBLE / (k // 8589934592 + 1)::DOUBLE))::BIGINT AS j FROM states)
    WHERE j <= {SHARDS}
),
placed AS (
    SELECT id, max(b) FILTER (b < {SHARDS})::INT AS shard, max(b)::INT AS grown_shard FROM states GROUP BY id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM sized JOIN placed ON id = coalesce(doc_id, 0)
"""
