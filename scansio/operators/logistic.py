"""Logistic regressions of several 0/1 labels over the same sparse features, fitted side by side.

Rows are packed once into blocks of bounded size.  A pass over the blocks gives
the losses and gradients of all labels: each task sums its blocks, the sums of
tasks are added piece by piece, and the driver sees the total, which has a number
for each feature and label.  It takes the steps: an L-BFGS for each label, with a
line search of its own, all of them asking for their next point in the same pass.

Loss, penalty and scaling are those of Spark ML's binary ``LogisticRegression``
with ``standardization=False``: the mean log loss and ``reg / 2`` times the squared
weights, none for the intercept, with steps taken by features of mean 0 and
deviation 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.session import shuffles_deleted, stage

BLOCK_ROWS = 4096
BLOCK_TERMS = 1 << 16
#: Weights that are fitted together at most; the driver holds some twenty times as many numbers.
FITTED = 1 << 22
#: Numbers of a total that one group adds.
PIECE = 1 << 13
#: Steps that an L-BFGS remembers, points that a line search tries, and the gradient, by the loss, that ends a fit.
MEMORY, TRIES, TOLERANCE = 10, 10, 1e-6
NAMES = ["counts", "keys", "place", "held", "row", "odd", "turned", "sizes", "labels"]
PACKED = ", ".join(f"{name} binary" for name in NAMES)


def packed(rows: DataFrame, features: str, labels: Sequence[str]) -> DataFrame:
    """Blocks of rows, staged.  ``features`` holds sparse vectors; a null label is an error."""
    def made(batches):
        for batch in batches:
            vectors, y = batch.column(0), batch.column(1).flatten()
            if vectors.null_count or y.null_count:
                raise ValueError("rows to fit on have no null features and no null labels")
            ids, sizes = (vectors.field(name).flatten().to_numpy() for name in ("indices", "values"))
            counts = vectors.field("indices").value_lengths().to_numpy().astype(np.int32)
            y = y.to_numpy().reshape(-1, len(labels))
            ends, low = np.append(0, np.cumsum(counts, dtype=np.int64)), 0
            while low < len(counts):
                full = np.searchsorted(ends, ends[low] + BLOCK_TERMS, "right") - 1
                high = min(len(counts), low + BLOCK_ROWS, max(low + 1, full))
                keys, place, held = np.unique(ids[ends[low]:ends[high]], return_inverse=True, return_counts=True)
                order = np.argsort(place, kind="stable")
                row = np.repeat(np.arange(high - low, dtype=np.uint16), counts[low:high])[order]
                some = sizes[ends[low]:ends[high]]
                odd = np.flatnonzero(some != 1)
                turned = np.empty(len(order), np.int32)
                turned[order] = np.arange(len(order))
                block = [counts[low:high], keys.astype(np.int32), place.astype(np.uint16 if len(keys) <= 1 << 16 else np.int32),
                         held.astype(np.int32), row, odd.astype(np.int32), turned[odd], some[odd], y[low:high].astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], NAMES)
                low = high

    chosen = rows.select(features, F.array(*[F.col(x).cast("double") for x in labels]).alias("labels"))
    return stage(chosen.mapInArrow(made, PACKED), "blocks")


class Block:
    """Rows of a block.  Its terms are held twice: by row, with their place among the block's features, and by feature, with their row.

    Few terms have another size than 1: only these have their size, and where they are in either order.
    """

    def __init__(self, values: Sequence[pa.Scalar], labels: int):
        read = lambda name, kind: np.frombuffer(values[NAMES.index(name)].as_buffer(), kind)
        counts, held = read("counts", np.int32), read("held", np.int32)
        self.rows, self.keys, self.row = len(counts), read("keys", np.int32), read("row", np.uint16).astype(np.intp)
        self.place = read("place", np.uint16 if len(self.keys) <= 1 << 16 else np.int32).astype(np.intp)
        self.odd, self.turned, self.sizes = read("odd", np.int32), read("turned", np.int32), read("sizes", np.float64)
        self.able = np.flatnonzero(counts)  # rows that have any term
        self.starts, self.first = (np.cumsum(counts) - counts)[self.able], np.cumsum(held) - held
        self.y = read("labels", np.int8).reshape(self.rows, labels).T

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The product of each row with the weights ``w`` of one label."""
        out = np.zeros(self.rows)
        if len(self.able):
            terms = w[self.keys].take(self.place)
            terms[self.odd] *= self.sizes
            out[self.able] = np.add.reduceat(terms, self.starts)
        return out

    def sums(self, x: np.ndarray, power: int = 1) -> np.ndarray:
        """By feature of the block, the sum of the numbers ``x`` of its rows, each times its size in the row to a power."""
        if not len(self.keys):
            return np.zeros(0)
        terms = x.take(self.row)
        terms[self.turned] *= self.sizes ** power
        return np.add.reduceat(terms, self.first)


def summed(blocks: DataFrame, labels: int, width: int, add: Callable[[Block, np.ndarray], None]) -> np.ndarray:
    """The sum, over all blocks, of what ``add`` puts into an array of ``width`` numbers; always in the same order."""
    names = ["piece", "task", "numbers"]

    def ran(batches) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width), False
        for batch in batches:
            for i in range(batch.num_rows):
                add(Block([column[i] for column in batch.columns], labels), total)
                seen = True
        for piece in range(-(-width // PIECE) if seen else 0):
            numbers = total[piece * PIECE:(piece + 1) * PIECE].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([numbers], pa.binary())], names)

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = 0
        for numbers in rows.column("numbers"):
            total = total + np.frombuffer(numbers.as_buffer(), np.float64)
        return pa.table([rows.column("piece").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["piece", "numbers"])

    parts = blocks.mapInArrow(ran, "piece int, task int, numbers binary")
    found = parts.groupBy("piece").applyInArrow(added, "piece int, numbers binary").toArrow().sort_by("piece")
    if not found.num_rows:
        raise ValueError("there are no rows to fit on")
    return np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in found.column("numbers")])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("kd,kd->k", a, b)


def downhill(g: np.ndarray, past: list) -> np.ndarray:
    """The L-BFGS direction of each row of ``g``; ``past`` holds steps, changes of gradients and one over their products."""
    d, shares = -g, []
    for s, y, r in reversed(past):
        shares.append(r * dots(s, d))
        d -= shares[-1][:, None] * y
    if past:
        s, y, r = past[-1]
        d *= np.where(r > 0, dots(s, y) / np.maximum(dots(y, y), 1e-300), 1.0)[:, None]
    for (s, y, r), share in zip(past, reversed(shares), strict=True):
        d += (share - r * dots(y, d))[:, None] * s
    return np.where((dots(g, d) < 0)[:, None], d, -g)


def minimised(loss: Callable, x: np.ndarray, max_iter: int) -> np.ndarray:
    """The least points of several functions, one for each row of ``x``.

    ``loss(points, which)`` gives the values and gradients of the functions
    ``which``, each at its own point.  A step that does not go down enough is
    halved; the first one, whose scale is not known, is also doubled while the
    function still falls as steeply (the weak Wolfe conditions).
    """
    f, g = loss(x, np.arange(len(x)))
    live, past = np.ones(len(x), bool), []
    for _ in range(max_iter):
        live = live & (np.sqrt(dots(g, g)) > np.maximum(TOLERANCE * np.abs(f), 1e-8))
        if not live.any():
            break
        d = downhill(g, past)
        slope = dots(g, d)
        t = np.ones(len(x)) if past else 1 / np.maximum(np.sqrt(dots(d, d)), 1e-300)
        low, high = np.zeros(len(x)), np.full(len(x), np.inf)
        best_x, best_f, best_g, searching = x.copy(), f.copy(), g.copy(), live.copy()
        for _ in range(TRIES):
            which = np.flatnonzero(searching)
            if not len(which):
                break
            points = x[which] + t[which, None] * d[which]
            value, gradient = loss(points, which)
            far = ~(value <= f[which] + 1e-4 * t[which] * slope[which])
            near = ~far & (not past) & (dots(gradient, d[which]) < 0.9 * slope[which])
            better = ~far & (value < best_f[which])
            best_x[which[better]], best_f[which[better]], best_g[which[better]] = points[better], value[better], gradient[better]
            high[which[far]], low[which[near]] = t[which[far]], t[which[near]]
            searching[which[~far & ~near]] = False
            t[which] = np.where(np.isinf(high[which]), 2 * t[which], (low[which] + high[which]) / 2)
        live = live & (best_f < f)
        s, y = best_x - x, best_g - g
        product = dots(s, y)
        past = [*past, (s, y, np.where(product > 1e-300, 1 / np.maximum(product, 1e-300), 0.0))][-MEMORY:]
        x, f, g = best_x, best_f, best_g
    return x


def fit(blocks: DataFrame, labels: int, size: int, max_iter: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights, one row of ``size`` numbers for each label, and intercepts.

    A label that all rows share has no weights and an infinite intercept, as in Spark ML.
    """
    spark = blocks.sparkSession

    def moments(block: Block, total: np.ndarray) -> None:
        total[block.keys] += block.sums(np.ones(block.rows))
        total[size + block.keys] += block.sums(np.ones(block.rows), 2)
        total[2 * size:-1] += block.y.sum(axis=1)
        total[-1] += block.rows

    def fitted(chosen: np.ndarray) -> np.ndarray:
        def loss(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = points[:, :-1] * scale
            sent = spark.sparkContext.broadcast((w, points[:, -1] - w @ mean, chosen[which]))
            many = len(which)

            def add(block: Block, total: np.ndarray) -> None:
                w, b, columns = sent.value
                for i, column in enumerate(columns):
                    z, y = block.scores(w[i]) + b[i], block.y[column]
                    e = np.exp(-np.abs(z))
                    miss = np.where(z >= 0, 1, e) / (1 + e) - y
                    total[i * size + block.keys] += block.sums(miss)
                    total[many * size + i] += miss.sum()
                    total[many * (size + 1) + i] += (np.maximum(z, 0) + np.log1p(e) - y * z).sum()

            total = summed(blocks, labels, many * (size + 2), add) / count
            sent.destroy()
            by_w, by_b = total[:many * size].reshape(many, size), total[many * size:many * (size + 1)]
            v = points[:, :-1]
            penalty = reg * v * scale ** 2
            gradient = np.column_stack([(by_w - np.outer(by_b, mean)) * scale + penalty, by_b])
            return total[many * (size + 1):] + dots(v, penalty) / 2, gradient

        first = np.zeros((len(chosen), size + 1))
        first[:, -1] = np.log(ones[chosen] / (count - ones[chosen]))
        return minimised(loss, first, max_iter)

    with shuffles_deleted(spark):
        total = summed(blocks, labels, 2 * size + labels + 1, moments)
        count, ones = total[-1], total[2 * size:-1]
        mean = total[:size] / count
        variance = np.maximum(total[size:2 * size] - count * mean ** 2, 0) / max(count - 1, 1)
        # a feature that all rows share alike has no weight; what is left of its variance is rounding
        varied = variance > 1e-12 * total[size:2 * size] / count
        scale = np.where(varied, 1 / np.sqrt(np.where(varied, variance, 1)), 0.0)
        weights, intercepts = np.zeros((labels, size)), np.where(ones > 0, np.inf, -np.inf)
        open_ = np.flatnonzero((ones > 0) & (ones < count))
        for low in range(0, len(open_), max(1, FITTED // size)):
            chosen = open_[low:low + max(1, FITTED // size)]
            found = fitted(chosen)
            weights[chosen] = found[:, :-1] * scale
            intercepts[chosen] = found[:, -1] - weights[chosen] @ mean
    return weights, intercepts
