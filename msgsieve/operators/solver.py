"""Many linear models fitted in step: one pass over the rows serves all of them.

A fit minimises ``|w|**2 / 2 + c * sum(weight * loss)`` by Newton steps. The step comes from conjugate gradients, whose
products of curvature and direction are sums over rows, like loss, gradient and diagonal; a line search tries all its
step lengths in one pass. So each fit is a sequence of questions, and a pass answers the open questions of all fits: every
row adds to the sums of the fits on its own feature space (its ``space``), tasks add up what they read, and one
aggregate over the tasks' sums follows. The driver holds coefficients, and of each feature space a bounded number of
rows whose curvature shapes the directions: they decide how many passes a fit takes, not where it ends.

Fits end by tolerance: when the gradient has shrunk to ``TOLERANCE`` of what it was at zero, or when no step length lowers
the objective any more in double precision. There is no limit on steps.
"""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

TOLERANCE = 1e-4
#: Entries of vectors that a task reads, on average, if there are more tasks than cores.
TASK_ENTRIES = 4_000_000
#: Products of curvature and direction that are kept to shape later directions.
PAIRS = 60
#: Rows of a space whose curvature shapes directions, and the cells that they may have on the driver.
SHAPING_ROWS, SHAPING_CELLS = 700, 10_000_000
#: Bytes on the driver, over all fits, of the products kept and of the inverses of the rows' curvature: many fits keep fewer
#: and use fewer rows.
DRIVER_BYTES = 40_000_000
#: Of the mean curvature of these rows, what directions that they do not have are taken to have.
UNSEEN = 0.5
#: Features are spread out to a dense matrix if at least one in so many rows of a batch has them.
CELLS_AN_ENTRY = 8
#: Cells of a matrix that a task holds at a time: few enough for a processor's cache.
CELLS = 600_000
#: Rows that are packed or unpacked at a time.
PACKED_ROWS = 1000
STEPS = 0.5 ** np.arange(40)


@dataclass(frozen=True)
class Fit:
    """One model: ``loss`` is ``logistic`` (all classes) or ``squared_hinge`` (class ``target`` against the rest).

    ``weights`` are by class. The intercept is penalised with the hinge and free with the logistic loss.
    """

    loss: str
    size: int
    weights: tuple[float, ...]
    c: float = 1.0
    target: int = 0
    space: int = 0

    @property
    def outputs(self) -> int:
        return len(self.weights) if self.loss == "logistic" else 1

    def terms(self, z: np.ndarray, y: np.ndarray):
        """Of margins ``(rows, outputs)``: the loss of each row, its slope in the margins, its curvature's diagonal."""
        weight = np.asarray(self.weights)[y]
        if self.loss == "logistic":
            top = z.max(axis=1, keepdims=True)
            e = np.exp(z - top)
            total = e.sum(axis=1, keepdims=True)
            p = e / total
            every = np.arange(len(y))
            loss = weight * (top[:, 0] + np.log(total[:, 0]) - z[every, y])
            slope = p.copy()
            slope[every, y] -= 1
            return loss, weight[:, None] * slope, weight[:, None] * p * (1 - p)
        side = np.where(y == self.target, 1.0, -1.0)
        gap = np.maximum(0.0, 1 - side * z[:, 0])
        return weight * gap**2, (-2 * weight * side * gap)[:, None], (2 * weight * (gap > 0))[:, None]

    def tried(self, z: np.ndarray, dz: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The loss of all rows after each of ``STEPS`` along ``dz``."""
        weight = np.asarray(self.weights)[y]
        if self.loss == "logistic":
            # Margins against the row's own class, so its loss is the logarithm of the sum of their exponentials.
            every = np.arange(len(y))
            z, dz = (np.ascontiguousarray((m - m[every, y][:, None]).T) for m in (z, dz))
            out = []
            for t in STEPS:
                m = z + t * dz
                top = m.max(axis=0)
                m -= top
                out.append(weight @ (top + np.log(np.exp(m, out=m).sum(axis=0))))
            return np.array(out)
        side = np.where(y == self.target, 1.0, -1.0)
        return np.array([weight @ np.maximum(0.0, 1 - side * (z[:, 0] + t * dz[:, 0])) ** 2 for t in STEPS])

    def bend(self, z: np.ndarray, dz: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How the slope changes along ``dz``."""
        weight = np.asarray(self.weights)[y][:, None]
        if self.loss == "logistic":
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            return weight * p * (dz - (p * dz).sum(axis=1, keepdims=True))
        side = np.where(y == self.target, 1.0, -1.0)[:, None]
        return 2 * weight * (side * z < 1) * dz


    def roots(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``(rows, outputs, rank)`` whose products over the rank are how each row's slope changes with its margins."""
        weight = np.asarray(self.weights)[y]
        if self.loss == "logistic":
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            bends = weight[:, None, None] * (np.eye(self.outputs) * p[:, :, None] - p[:, :, None] * p[:, None, :])
            values, vectors = np.linalg.eigh(bends)  # the same shift of all margins changes nothing: one value is 0
            return (vectors * np.sqrt(np.maximum(values, 0))[:, None, :])[:, :, 1:]
        side = np.where(y == self.target, 1.0, -1.0)
        return np.sqrt(2 * weight * (side * z[:, 0] < 1))[:, None, None]


class Rows:
    """Rows of a batch: margins of coefficient rows, and sums of entries by feature.

    Entries come sparse. Products with features that many rows have are taken on a dense matrix, one product for all fits;
    the other entries stay sparse.
    """

    def __init__(self, y: np.ndarray, indices: np.ndarray, values: np.ndarray, sizes: np.ndarray):
        self.y, self.indices, self.values, self.sizes = y, indices, values, sizes
        self.filled = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]
        #: The dense part of the rows and its features.
        self.matrix: np.ndarray | None = None
        self.columns: np.ndarray | None = None

    def parts(self, size: int):
        """The same rows in blocks whose matrix, or without one about whose entries, are bounded in number."""
        n, total = len(self.y), len(self.values)
        columns = np.flatnonzero(np.bincount(self.indices, minlength=size) * CELLS_AN_ENTRY > n)
        width = len(columns)
        place = np.full(size, -1)
        place[columns] = np.arange(width)
        place = place[self.indices]
        dense = place >= 0
        place, seen = place[dense], self.values[dense]
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        dense_ends = np.concatenate([[0], np.cumsum(dense)])[ends]
        np.logical_not(dense, out=dense)
        indices, values, sparse_ends = self.indices[dense], self.values[dense], ends - dense_ends
        step = max(1, CELLS // width if width else CELLS * n // max(total, 1))
        for a in range(0, n, step):
            b = min(a + step, n)
            own, sizes = slice(sparse_ends[a], sparse_ends[b]), np.diff(sparse_ends[a : b + 1])
            part = Rows(self.y[a:b], indices[own], values[own], sizes)
            if width:
                own, sizes = slice(dense_ends[a], dense_ends[b]), np.diff(dense_ends[a : b + 1])
                part.columns, part.matrix = columns, np.zeros((b - a, width))
                part.matrix.ravel()[np.repeat(np.arange(b - a) * width, sizes) + place[own]] = seen[own]
            yield part

    def margins(self, w: np.ndarray) -> np.ndarray:
        if self.matrix is not None:
            out = self.matrix @ w[:, self.columns].T + w[:, -1]
        else:
            out = np.tile(w[:, -1], (len(self.y), 1))
        if len(self.filled):
            for k, row in enumerate(w):
                out[self.filled, k] += np.add.reduceat(self.values * row[self.indices], self.starts)
        return out

    def back(self, slope: np.ndarray, size: int, power: int = 1) -> np.ndarray:
        """For each output the sum of slope times entry, by feature, and of the slope alone."""
        out = np.zeros((slope.shape[1], size + 1))
        out[:, size] = slope.sum(axis=0)
        if len(self.values):
            entries = self.values**power
            for k in range(slope.shape[1]):
                out[k, :size] = np.bincount(self.indices, entries * np.repeat(slope[:, k], self.sizes), minlength=size)
        if self.matrix is not None:
            out[:, self.columns] += slope.T @ (self.matrix if power == 1 else self.matrix**power)
        return out

    def answers(self, asked: list[tuple[Fit, tuple]]) -> list[list[np.ndarray]]:
        """The sums that answer each fit's question; all fits are on the features of these rows."""
        size = asked[0][0].size
        sent = [w for _, question in asked for w in question[1:]]
        margins = iter(np.split(self.margins(np.concatenate(sent)), np.cumsum([len(w) for w in sent])[:-1], axis=1))
        losses, slopes, diagonals = [], [], []
        for fit, (kind, *_) in asked:
            z = next(margins)
            dz = next(margins) if kind != "value" else 0.0
            if kind == "curve":
                slopes.append(fit.bend(z, dz, self.y))
                continue
            loss, slope, diagonal = fit.terms(z + dz, self.y)
            losses.append(fit.tried(z, dz, self.y) if kind == "line" else np.array([loss.sum()]))
            slopes.append(slope)
            diagonals.append(diagonal)
        first = iter(self.back(np.hstack(slopes), size))
        second = iter(self.back(np.hstack(diagonals), size, 2) if diagonals else ())
        value, out = iter(losses), []
        for fit, (kind, *_) in asked:
            own = [next(first) for _ in range(fit.outputs)]
            out.append(own if kind == "curve" else [next(value), *own, *(next(second) for _ in range(fit.outputs))])
        return out


class Shaping:
    """Some rows of a space: their curvature stands for that of all ``total`` rows when directions are shaped."""

    def __init__(self, block: Rows, size: int, total: int):
        n = len(block.y)
        self.block, self.y, self.size, self.total = block, block.y, size, total
        matrix = np.zeros((n, size + 1), np.float32)  # for this product only: the rows stay sparse
        matrix[np.repeat(np.arange(n), block.sizes), block.indices] = block.values
        matrix[:, size] = 1
        self.products = (matrix @ matrix.T).astype(float)

    def inverse(self, fit: Fit, w: np.ndarray):
        """Gradients to steps: the inverse of a multiple of the identity plus the rows' curvature at ``w``."""
        roots = fit.roots(self.block.margins(w), self.y) * math.sqrt(fit.c * self.total / len(self.y))
        n, _, rank = roots.shape
        inner = np.empty((n, rank, n, rank))
        for a in range(rank):
            for b in range(rank):
                inner[:, a, :, b] = self.products * (roots[:, :, a] @ roots[:, :, b].T)
        inner = inner.reshape(n * rank, n * rank)
        unseen = 1 + UNSEEN * np.trace(inner) / len(inner)
        inner[np.diag_indices(n * rank)] += unseen
        solved = np.linalg.inv(inner).astype(np.float32)

        def apply(gradient: np.ndarray) -> np.ndarray:
            scale = np.abs(gradient).max() or 1.0  # small numbers would be lost in single precision
            seen = np.einsum("nk,nkr->nr", self.block.margins(gradient / scale), roots).ravel()
            part = np.einsum("nr,nkr->nk", (solved @ seen.astype(np.float32)).reshape(n, rank), roots)
            return (gradient - scale * self.block.back(part, self.size)) / unseen

        return apply


def _newton(fit: Fit, tolerance: float, shaping: Shaping | None = None, pairs: int = PAIRS) -> Generator:
    """Asks ``(kind, w[, direction])`` and is sent the sums over all rows; returns the coefficients.

    Without rows for ``shaping`` the diagonal of the curvature shapes directions. At most ``pairs`` products of a step are
    kept, in single precision: they decide how many passes a fit takes, not where it ends.
    """
    k = fit.outputs
    w = np.zeros((k, fit.size + 1))
    kept = np.ones_like(w)
    kept[:, -1] = 0.0 if fit.loss == "logistic" else 1.0

    def state(w, parts):
        gradient = kept * w + fit.c * np.stack(parts[1 : 1 + k])
        diagonal = kept + fit.c * np.stack(parts[1 + k :])
        return 0.5 * (kept * w * w).sum() + fit.c * parts[0][0], gradient, np.maximum(diagonal, 1e-12)

    now, gradient, diagonal = state(w, (yield ("value", w)))
    first = np.linalg.norm(gradient)
    known: list[tuple[np.ndarray, np.ndarray]] = []
    while (size := np.linalg.norm(gradient)) > tolerance * first:
        bound = min(0.3, math.sqrt(size / first)) * size
        step, rest, met, taken = np.zeros_like(w), -gradient, [], 0
        shaped = shaping.inverse(fit, w) if shaping is not None else lambda v: v / diagonal
        toward = _scaled(rest, shaped, known)
        along = (rest * toward).sum()
        gained = 0.0
        while np.linalg.norm(rest) > bound:
            bent = kept * toward + fit.c * np.stack((yield ("curve", w, toward)))
            curvature = (toward * bent).sum()
            if curvature <= 0 or along <= 0:  # rounding only: the objective is convex
                break
            met = [*met, (toward.astype(np.float32), bent.astype(np.float32))][-pairs:]
            taken += 1
            step += along / curvature * toward
            rest -= along / curvature * bent
            # Directions that hardly lower the quadratic model any more are not worth a pass (Nash and Sofer, 1990).
            gain = 0.5 * along**2 / curvature
            gained += gain
            if taken * gain < 0.1 * gained:
                break
            scaled = _scaled(rest, shaped, known)
            before, along = along, (rest * scaled).sum()
            toward = scaled + along / before * toward
        known = met
        slope = (gradient * step).sum()
        if not slope < 0:
            break
        parts = yield ("line", w, step)
        penalty = np.array([0.5 * (kept * (w + t * step) ** 2).sum() for t in STEPS])
        lower = np.flatnonzero(penalty + fit.c * parts[0] < now + 1e-4 * STEPS * slope)
        if not len(lower):
            break
        w = w + STEPS[lower[0]] * step
        # The pass that tried the steps has the sums of a whole one.
        now, gradient, diagonal = state(w, parts if lower[0] == 0 else (yield ("value", w)))
    return w


def _scaled(rest: np.ndarray, shaped, known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``rest`` times about the inverse curvature: ``shaped``, corrected by products met in earlier steps."""
    out, shares = rest.copy(), []
    for s, y in reversed(known):
        share = (s * out).sum() / (s * y).sum()
        out -= share * y
        shares.append(share)
    out = shaped(out)
    for (s, y), share in zip(known, reversed(shares)):
        out += (share - (y * out).sum() / (s * y).sum()) * s
    return out


def entries() -> list[Column]:
    """``indices`` and ``values`` of a vector that was read as a struct: unpacked natively, and still sparse."""
    dense = F.sequence(F.lit(0), F.size("features.values") - 1)
    every = F.when(F.size("features.values") > 0, dense).otherwise(F.array().cast("array<int>"))
    return [F.coalesce("features.indices", every).alias("indices"), F.col("features.values").alias("values")]


@dataclass(frozen=True)
class Weighing:
    """How vectors of a space were weighed: the weight of each feature that is a count times its weight, over a number that the
    row's features of one block share; and the block of each. Further features are plain numbers."""

    weight: np.ndarray
    block: np.ndarray


def even_rows(stored: DataFrame, weighings: dict[int, Weighing] | None = None) -> DataFrame:
    """``space, y, indices, counts, units, values`` of a stored table ``space, y, features``, dealt evenly and persisted; the
    caller unpersists.

    All are bytes, which every pass hands to Python as they are: two or four bytes an index; of weighed features, which
    come first in a row, the count (one byte) and the row's unit of each block; of other entries the number.
    """
    rows = stored.select("space", "y", *entries(), "features.size")
    told = rows.agg(F.sum(F.size("values")), F.max(F.coalesce("size", F.size("values")))).first()
    total, kind = told[0] or 0, np.uint16 if (told[1] or 0) <= 2**16 else np.int32
    tasks = max(stored.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ENTRIES))
    schema = "space int, y int, indices binary, counts binary, units binary, values binary"
    packed = rows.drop("size").mapInArrow(lambda batches: _packed(batches, kind, weighings or {}), schema)
    # Rows are packed before they are exchanged: a weighed entry is 3 bytes in place of 12.
    placed = packed.repartition(tasks, F.xxhash64("indices", "counts", "values", "y")).sortWithinPartitions("space")
    return placed.persist(StorageLevel.MEMORY_AND_DISK)


def _packed(batches, kind, weighings: dict[int, Weighing]):
    for whole in batches:
        for start in range(0, whole.num_rows, PACKED_ROWS):
            batch = whole.slice(start, PACKED_ROWS)
            indices, values = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy().astype(np.int64))])
            columns = [[], [], [], []]
            for space, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                counts, units = _counts(indices[a:b], values[a:b], weighings.get(space))
                rest = np.ascontiguousarray(values[a + len(counts) : b], np.float64)
                for column, part in zip(columns, (indices[a:b].astype(kind), counts, units, rest)):
                    column.append(part.tobytes())
            made = [pa.array(column, pa.binary()) for column in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["space", "y", "indices", "counts", "units", "values"])


_NO_COUNTS = np.zeros(0, np.uint8), np.zeros(0)


def _counts(indices: np.ndarray, values: np.ndarray, weighing: Weighing | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts and units that give the weighed entries of a row but for rounding; none if there are no such counts."""
    n = int(np.searchsorted(indices, len(weighing.weight))) if weighing is not None else 0
    if not n:
        return _NO_COUNTS
    weight, block = weighing.weight[indices[:n]], weighing.block[indices[:n]]
    shares = values[:n] / weight
    units = np.full(int(weighing.block[-1]) + 1, np.inf)
    np.minimum.at(units, block, shares)
    counts = np.rint(shares / units[block])
    if not (units > 0).all() or not (counts <= 255).all() or not (np.abs(counts * units[block] - shares) <= 1e-14 * shares).all():
        return _NO_COUNTS
    return counts.astype(np.uint8), units


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    """The numbers of all rows of a column of bytes, one after the other, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _rows(batch: pa.RecordBatch, weighing: Weighing | None) -> Rows:
    """The rows of one space, as ``even_rows`` packs them."""
    counted, plain = (pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) for i in (3, 5))
    plain //= 8
    sizes = counted + plain
    total = int(sizes.sum())
    kind = np.uint16 if pc.sum(pc.binary_length(batch.column(2))).as_py() == 2 * total else np.int32
    indices, values = _unpacked(batch.column(2), kind), _unpacked(batch.column(5), np.float64)
    if counted.any():
        by_count = np.repeat(np.tile([True, False], len(sizes)), np.stack([counted, plain], axis=1).ravel())
        own = indices[by_count]
        blocks = int(weighing.block[-1]) + 1
        units = np.zeros((len(sizes), blocks))
        units[counted > 0] = _unpacked(batch.column(4), np.float64).reshape(-1, blocks)
        each = units.ravel()[np.repeat(np.arange(len(sizes)) * blocks, counted) + weighing.block[own]]
        every = np.empty(total)
        every[by_count] = _unpacked(batch.column(3), np.uint8) * each * weighing.weight[own]
        every[~by_count] = values
        values = every
    return Rows(batch.column(1).to_numpy(), indices, values, sizes)


def _pass(rows: DataFrame, fits: dict[int, Fit], asked: dict[int, tuple], weighings: dict[int, Weighing] | None = None) -> dict[int, list[np.ndarray]]:
    """The sums that answer all open questions."""
    sent = rows.sparkSession.sparkContext.broadcast((fits, asked, weighings or {}))

    def run(batches):
        fits, asked, weighings = sent.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            space = batch.column(0).to_numpy()
            cuts = np.flatnonzero(space[1:] != space[:-1]) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(space)]):
                mine = [n for n in asked if stop > start and fits[n].space == space[start]]
                if not mine:
                    continue
                for at in range(start, stop, PACKED_ROWS):
                    block = _rows(batch.slice(at, min(PACKED_ROWS, stop - at)), weighings.get(int(space[start])))
                    for rows in block.parts(fits[mine[0]].size):
                        for n, answer in zip(mine, rows.answers([(fits[n], asked[n]) for n in mine])):
                            for k, added in enumerate(answer):
                                if (n, k) in sums:
                                    sums[n, k] += added
                                else:
                                    sums[n, k] = added
        for (n, k), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([k], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["fit", "part", "sums"]
            )

    # A task's sums are as long as the coefficients; they are added up in Spark, by fit and part.
    partial = rows.mapInArrow(run, "fit int, part int, sums array<double>")
    total = partial.groupBy("fit", "part").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(total.collect(), key=lambda r: (r["fit"], r["part"])):
        out.setdefault(r["fit"], []).append(r["sums"].toArray())
    sent.unpersist()
    return out


def _shaping(rows: DataFrame, fits: list[Fit], weighings: dict[int, Weighing]) -> dict[int, Shaping]:
    """For each space as many of its rows as the limits allow, the first by hash; none if these are too few to help."""
    sizes, out = {fit.space: fit.size for fit in fits}, {}
    outputs = max((fit.outputs for fit in fits), default=1)
    # An inverse has at most outputs - 1 lines (one, if there is but one output) for each row, of four bytes a number.
    bounded = math.isqrt(DRIVER_BYTES // (4 * max(len(fits), 1))) // max(outputs - 1, 1)
    totals = {r["space"]: r["count"] for r in rows.groupBy("space").count().collect()}
    for space, size in sizes.items():
        many = min(SHAPING_ROWS, SHAPING_CELLS // (size + 1), bounded)
        if space not in totals or many < 50:
            continue
        own = rows.where(F.col("space") == space)
        first = own.orderBy(F.xxhash64("indices", "counts", "units", "values", "y", F.lit(1)), "y").limit(many).toArrow().combine_chunks()
        out[space] = Shaping(_rows(first.to_batches()[0], weighings.get(space)), size, totals[space])
    return out


def fit_all(rows: DataFrame, fits: list[Fit], tolerance: float = TOLERANCE, weighings: dict[int, Weighing] | None = None) -> list[np.ndarray]:
    """Coefficients ``(outputs, size + 1)``, intercepts last, of every fit on the rows that ``even_rows`` gives with the same
    ``weighings``.

    A fit without rows stays at zero.
    """
    numbered = dict(enumerate(fits))
    shaping = _shaping(rows, fits, weighings or {})
    kept = sum(8 * fit.outputs * (fit.size + 1) for fit in fits)
    pairs = max(1, min(PAIRS, DRIVER_BYTES // max(kept, 1)))
    solvers = {n: _newton(fit, tolerance, shaping.get(fit.space), pairs) for n, fit in numbered.items()}
    asked = {n: next(solver) for n, solver in solvers.items()}
    done: dict[int, np.ndarray] = {}
    while asked:
        answers = _pass(rows, numbered, asked, weighings)
        for n in list(asked):
            try:
                if n not in answers:
                    raise StopIteration(asked[n][1])
                asked[n] = solvers[n].send(answers[n])
            except StopIteration as end:
                done[n] = end.value
                del asked[n]
    return [done[n] for n in numbered]
