"""Interleaving sources by target weights with Pfair scheduling.

The rows of a source are cut into blocks. Under weights a_s with sum W, block i (from 1) of source s may take a
slot from ``floor((i - 1) W / a_s)`` on and must have one before ``ceil(i W / a_s)``. Each slot goes to the
released block with the earliest deadline. On one line of slots this always succeeds, so after every
slot each source is less than one block away from its share.

Weights are taken exactly as given: a float is a fraction, and releases and deadlines are computed in whole
numbers. The plan is one number for each block, made on the driver from the row counts of the sources. Its
size is bounded by MOST_SLOTS: a block has BLOCK_ROWS rows or, in a larger table, so many that the plan fits, so a
source is never more than one block, nor more than BLOCK_ROWS rows or a millionth of the table, away from its share.
When a slot falls to a source that is used up, the others go on with their weights among themselves, from a lag
of zero: a new phase. Every row is kept and gets its slot by its rank within the source.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from msgsieve.llm.common import rank_within, read

BLOCK_ROWS = 16
#: Blocks of a plan, but for the short last block of each source.
MOST_SLOTS = 1 << 20
#: More sources are refused.
MOST_SOURCES = 1000
#: Rows of a source that are ranked in one window.
RANKED_ROWS = 50_000


def whole_weights(target: dict) -> dict:
    """Target weights, which must be positive and finite, as whole numbers in exactly the same proportions."""
    if any(not 0 < w < math.inf for w in target.values()):
        raise ValueError("target weights must be positive and finite")
    exact = {s: Fraction(w) for s, w in target.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def earliest_deadline_first(weights: dict):
    """The source of each slot, without end. ``weights`` are whole."""
    total, names = sum(weights.values()), list(weights)
    waiting = [(0, k, 1) for k in range(len(names))]
    ready: list = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // weights[names[k]]), k, i))
        _, k, i = heapq.heappop(ready)
        heapq.heappush(waiting, (i * total // weights[names[k]], k, i + 1))
        yield names[k]
        slot += 1


def schedule(blocks: dict, weights: dict) -> dict:
    """The slots of each source's blocks in order: ``blocks`` are their numbers of blocks, ``weights`` whole numbers."""
    left = {s: n for s, n in blocks.items() if n > 0}
    slots: dict = {s: [] for s in left}
    slot = 0
    while left:
        for s in earliest_deadline_first({s: weights[s] for s in left}):
            if not left[s]:
                break
            slots[s].append(slot)
            slot += 1
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    return {s: np.array(x, dtype=np.int64) for s, x in slots.items()}


def mixed(
    docs: DataFrame,
    weights: dict | None = None,
    id_col: str = "doc_id",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with ``block, slot, position``: its source's block, the slot of this block, and the row's
    place in the whole order, from 0 without a gap. Columns of these names are replaced.

    ``weights`` has a positive number for each source, and is refused if one is missing; by default the square root
    of its rows. A null source is a source (key None). ``block_rows`` is the least number of rows in a block. The order
    within a source is a fixed random one, by the hash of id and, where there is one, text; rows alike in both are
    interchangeable and get a place each. An empty table gives none.
    ``docs`` is read twice: pass a stored table.
    """
    text = [c for c, kind in docs.dtypes if kind == "string" and c != id_col]
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),  # so that no column can clash with those below
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("of"),
        F.xxhash64(*text).alias("digest") if text else F.lit(0).alias("digest"),
    )
    counts = rows.groupBy("of", "source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights and (missing := {r["source"] for r in counts} - set(weights)):
        raise ValueError(f"no weight for the sources {sorted(map(str, missing))}")
    target = {r["of"]: weights[r["source"]] if weights else r["n"] ** 0.5 for r in counts}
    sizes = {r["of"]: r["n"] for r in counts}
    total = sum(sizes.values())
    block_rows = max(block_rows, -(-total // MOST_SLOTS))
    slots = schedule({s: -(-n // block_rows) for s, n in sizes.items()}, whole_weights(target)) if sizes else {}
    # The last block of a source may be short: later rows move up by what it lacks.
    short = sorted((int(slots[s][-1]), -n % block_rows) for s, n in sizes.items() if n % block_rows)
    short_slot = np.array([s for s, _ in short], dtype=np.int64)
    lacking = np.concatenate([[0], np.cumsum([k for _, k in short], dtype=np.int64)])
    ranked = rank_within(rows.drop("source"), "of", ["id", "digest"], "rank", max(1024, total // RANKED_ROWS))
    made = ["block", "slot", "position"]
    columns = [c for c in docs.columns if c not in made]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", block long, slot long, position long"

    def run(batches):
        for batch in batches:
            field = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rank = np.asarray(field["rank"])
            block = rank // block_rows
            codes = field["of"].dictionary_encode()
            own = np.asarray(codes.indices)
            slot = np.zeros(len(rank), dtype=np.int64)
            for k, name in enumerate(codes.dictionary.to_pylist()):
                slot[own == k] = slots[name][block[own == k]]
            position = slot * block_rows + rank % block_rows - lacking[np.searchsorted(short_slot, slot)]
            yield pa.RecordBatch.from_arrays(
                [*(field["row"].field(c) for c in columns), pa.array(block), pa.array(slot), pa.array(position)],
                [*columns, *made],
            )

    return ranked.mapInArrow(run, schema)


def op9_mixing(spark, sf_dir):
    """Interleave all documents by source, weights by the square root of the sources' sizes."""
    return mixed(read(spark, sf_dir, "documents").select("doc_id", "source"))
