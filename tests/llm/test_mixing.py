import random
from fractions import Fraction

import pytest

from conftest import SF
from msgsieve.llm import mixing as M


def order(blocks, weights):
    at = {}
    for s, slots in M.schedule(blocks, weights).items():
        assert len(slots) == blocks[s] and sorted(slots) == list(slots)
        for slot in slots.tolist():
            assert slot not in at
            at[slot] = s
    assert sorted(at) == list(range(sum(blocks.values())))
    return [at[k] for k in range(len(at))]


@pytest.mark.parametrize("seed", range(60))
def test_less_than_one_block_away(seed):
    rnd = random.Random(seed)
    weights = {s: rnd.randint(1, 40) for s in range(rnd.randint(1, 9))}
    rounds, total = rnd.randint(1, 4), sum(weights.values())
    got = dict.fromkeys(weights, 0)
    for t, s in enumerate(order({s: rounds * a for s, a in weights.items()}, weights), 1):
        got[s] += 1
        assert all(abs(got[u] - t * a / total) < 1 for u, a in weights.items())


@pytest.mark.parametrize("seed", range(60))
def test_until_a_source_is_used_up(seed):
    rnd = random.Random(seed)
    weights = {s: rnd.randint(1, 30) for s in range(rnd.randint(2, 8))}
    blocks = {s: rnd.randint(1, 200) for s in weights}
    got, total = dict.fromkeys(weights, 0), sum(weights.values())
    for t, s in enumerate(order(blocks, weights), 1):
        got[s] += 1
        assert all(abs(got[u] - t * a / total) < 1 for u, a in weights.items())
        if got[s] == blocks[s]:
            break


def plain_order(blocks, target):
    """Slot by slot: of the next blocks that are released, the one with the earliest deadline, in exact fractions."""
    left, taken, out, start = dict(blocks), {}, [], 0
    while any(left.values()):
        taken = taken or {s: 0 for s in left if left[s]}
        whole = sum(Fraction(target[s]) for s in taken)
        share = {s: Fraction(target[s]) / whole for s in taken}
        at = len(out) - start
        released = [s for s in taken if taken[s] / share[s] // 1 <= at]
        s = min(released, key=lambda s: (-(-(taken[s] + 1) / share[s] // 1), list(taken).index(s)))
        if not left[s]:
            taken, start = {}, len(out)
            continue
        out.append(s)
        taken[s] += 1
        left[s] -= 1
    return out


@pytest.mark.parametrize("target", [{"a": 0.99995, "b": 0.00005}, {"a": 1 / 3, "b": 2**0.5, "c": 1e-4, "d": 3333333**0.5}])
def test_given_weights_are_met_to_less_than_a_block(target):
    total, whole = 10_000, sum(map(Fraction, target.values()))
    got = dict.fromkeys(target, 0)
    for t, s in zip(range(1, total + 1), order(dict.fromkeys(target, total), M.whole_weights(target))):
        got[s] += 1
        assert all(abs(got[u] - t * Fraction(w) / whole) < 1 for u, w in target.items())


@pytest.mark.parametrize("seed", range(20))
def test_order_equals_the_plain_rule(seed):
    rnd = random.Random(seed)
    target = {s: rnd.random() + 1e-3 for s in "abcde"[: rnd.randint(1, 5)]}
    blocks = {s: rnd.randint(1, 60) for s in target}
    assert order(blocks, M.whole_weights(target)) == plain_order(blocks, target)


def check_rows(got, sizes, target, block_rows):
    """Every row against the plain rule: its slot is of its source, its position counts the rows before it."""
    names = sorted(sizes, key=str)
    plan = M.whole_weights({s: target[s] for s in names})
    turn = {s: [] for s in names}
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert sorted(r.position for r in got) == list(range(sum(sizes.values()))) and sorted(slots) == list(range(len(slots)))
    before = 0
    for slot in range(len(slots)):
        rows = slots[slot]
        (s,) = {r.source for r in rows}
        turn[s].append(len(rows))
        assert {r.block for r in rows} == {len(turn[s]) - 1}
        assert sorted(r.position for r in rows) == list(range(before, before + len(rows)))
        before += len(rows)
    for s, lengths in turn.items():
        assert sum(lengths) == sizes[s] and set(lengths[:-1]) <= {block_rows}
    left, share, t = {s: len(x) for s, x in turn.items()}, dict.fromkeys(names, 0), 0
    for slot in range(len(slots)):
        s, t = slots[slot][0].source, t + 1
        share[s] += 1
        assert all(abs(share[u] - Fraction(t * plan[u], sum(plan.values()))) < 1 for u in names)
        if share[s] == left[s]:
            break


def test_query_row_by_row(spark):
    got = M.op9_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((r.doc_id, r.source or "") for r in docs)
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    check_rows(got, sizes, {s: n**0.5 for s, n in sizes.items()}, M.BLOCK_ROWS)


def test_blocks_grow_so_that_the_plan_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_SLOTS", 50)
    rows = [(i, "a" * 100_000 if i == 5 else "x", "s0" if i % 10 else "s1") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {"s0": 0.9, "s1": 0.1}
    check_rows(M.mixed(docs, weights=target, block_rows=4).collect(), {"s0": 900, "s1": 100}, target, 20)
    with pytest.raises(ValueError):
        M.mixed(docs, weights={"s0": 1.0})


def test_rows(spark):
    rows = [(i, f"t{i}", None if i % 3 == 0 else f"s{i % 2}", "z") for i in range(500)] + [(7, "t7", "s1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _bucket string").repartition(4)
    got = M.mixed(docs, block_rows=10).collect()
    assert sorted(r.position for r in got) == list(range(501))
    assert sorted((r.doc_id, r.text, r.source) for r in got if r.source) == sorted(x[:3] for x in rows if x[2])
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, []).append(r)
    assert all(len({(r.source, r.block) for r in x}) == 1 and len(x) <= 10 for x in by_slot.values())
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)
    again = M.mixed(docs.repartition(9), block_rows=10).collect()
    assert sorted((r.doc_id, r.position) for r in again if r.doc_id != 7) == sorted((r.doc_id, r.position) for r in got if r.doc_id != 7)


def test_edges(spark):
    kind = "doc_id long, source string"
    assert M.mixed(spark.createDataFrame([], kind)).count() == 0
    assert [r.position for r in M.mixed(spark.createDataFrame([(None, None)], kind)).collect()] == [0]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], kind)
    with pytest.raises(ValueError):
        M.mixed(docs, weights={"a": 1.0, "b": 0.0})
