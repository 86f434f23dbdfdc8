"""Text models over words and hashed n-grams, fitted by full gradients on a table of parameters.

The parameters of a model are a table with one vector for each feature, dealt
out by feature; no task and no driver holds them all.  Rows lie in parts of
bounded size, one packed row each, stored by part as the parameters are by
feature: neither moves again.  An iteration is two moves:

1. what a part needs to know of the vectors that its rows name is sent to it, and
   one pass over its rows gives the gradient by that, summed inside the part;
2. the sums are brought to their feature, which takes its step (Adagrad: each
   number divides its step by the root of its squared gradients so far).

What is sent goes packed: a shard of parameters and a part of rows exchange one message each way, or a few of
bounded size, by routes that are found once.  It is one number for each label, not the vector: a score of ``LowRank``
is a mean of products of a vector and a label's vector, which are taken where the
vector lies, and so is the gradient, from the sums by label.  ``Linear`` sends the
columns of the choices that still take steps.  All labels, and all choices of a
sweep, are columns of the same vectors, so an iteration costs one scan however
many there are.  Sums are taken in the order of parts, so a fit repeats exactly.

``Linear`` is a logistic regression for each position and choice; ``LowRank`` is
one model for all positions: the mean of the vectors of a line's words and
n-grams, which may start from given word vectors, and a vector for each label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.functions.binding import once
from scansio.functions.meter import encode_meter
from scansio.session import forget, new_path, shuffles_deleted, stage, stored, stored_by

# The published settings of the n-gram baseline.
DIM = 300
RATE = 0.25
EPOCHS = 10
NGRAMS = 3
BUCKETS = 2_000_000
#: The mark that ends every line: a feature that all rows have.
LINE_END = "</s>"
#: Keys of the labels' vectors and of the loss; word features are not negative and n-gram features above these.
LABELS, LOSS = -(1 << 62), -(1 << 62) + 1
PART_ROWS = 1 << 17
PART_TERMS = 1 << 22
LEAST_ROWS = 256
STRIP_ROWS = 4096
SHARD_BYTES = 64 << 20
#: Vectors that a row of the parameter table holds, and features that a message is about at most.
BLOCK_BYTES, ROUTE = 256 << 10, 1 << 13
#: Occurrences of which gradients are summed together: what they need stays in a core's cache.
SUMMED = 1 << 16
TINY = 1e-12
STATE = "feature bigint, w array<double>, s array<double>"
#: Between iterations vectors are bytes: they are read and written whole, not number by number.
HELD = "feature bigint, w binary, s binary"
PLACES = "places array<struct<part: bigint, at: int>>"
PACKED = "part bigint, keys array<bigint>, named int, ids binary, labels binary, counts binary, place binary, feature binary, size binary, uses binary, back binary"
#: In rows of bytes: a block of parameters, and under block -1 what a shard adds to the loss and to the gradient by labels.
BLOCKS = "shard bigint, block int, keys binary, w binary, s binary, extra binary"
ROUTES = "shard bigint, part bigint, at binary, place binary"
MESSAGES = "to bigint, shard bigint, at binary, place binary, z binary"
REPLIES = "shard bigint, part bigint, place binary, g binary"


# features

def word_feature(word: Column | str) -> Column:
    """A word's own feature: its hash without the sign."""
    return F.shiftrightunsigned(F.xxhash64(F.col(word) if isinstance(word, str) else word), 1)


def term_words(text: Column) -> Column:
    return F.concat(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""), F.array(F.lit(LINE_END)))


def term_features(text: Column, n: int, buckets: int) -> Column:
    """The features of all words, the line's end and all n-grams up to ``n``, by size; n-grams share ``buckets``."""
    # the words of a line are found once, not once for each n-gram
    def grams(w: Column, size: int) -> Column:
        # from each word that has enough words behind it, by place: no array is made for an n-gram
        firsts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(0)))
        return F.transform(firsts, lambda word, i: -1 - F.pmod(
            F.xxhash64(F.concat_ws(" ", word, *[F.get(w, i + k) for k in range(1, size)])), F.lit(buckets)))

    return once(term_words(text), lambda w: F.concat(F.transform(w, word_feature), *[grams(w, size) for size in range(2, n + 1)]))


def sizes_of(counts: np.ndarray, n: int) -> np.ndarray:
    """How many words each term of rows with so many terms has, as ``term_features`` orders them."""
    # the words of a row, from the number of its terms
    least = np.arange(int(counts.max(initial=0)) + 1)
    terms = sum(np.maximum(least - k, 0) for k in range(n))
    words = np.searchsorted(terms, counts)
    assert np.array_equal(terms[words], counts)
    each = np.repeat(words, counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return sum((within >= sum(np.maximum(each - i, 0) for i in range(k))).astype(np.int8) for k in range(1, n)) + np.ones(len(each), np.int8)


@dataclass
class Features:
    """Rows ``id, part, features, sizes, labels``, the same packed by part, and what each part needs: ``part, feature, at``."""

    rows: DataFrame
    packed: DataFrame
    needs: DataFrame
    count: int
    parts: int


def spread_numbers(spark, n: int) -> list[int]:
    """``n`` numbers that a hash exchange deals to ``n`` partitions, one each, as far as a few draws find them."""
    found = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect() if n <= 1024 else []
    return sorted(r["id"] for r in found) if len(found) == n else list(range(n))


def dealt(key: str, names: Sequence[int]) -> Column:
    """One of the numbers ``names`` for each key."""
    number = F.pmod(F.xxhash64(key), F.lit(len(names)))
    return (number if list(names) == list(range(len(names))) else F.get(F.array(*[F.lit(x) for x in names]), number)).cast("bigint")


def packed_rows(rows: pa.Table, n: int) -> pa.Table:
    """The rows of a part as one row.

    A term is a feature with a size; terms are numbered by how often they occur, so
    that what most rows need lies together.  Rows are in the order of their number
    of terms, in strips: the first terms of the strip's rows, their second ones, and
    so on, which are added up one such piece after another.  ``back`` has the rows
    of each term, as differences, which take less room.
    """
    features, offsets = rows_of(rows.column("features"))
    ids, counts = rows.column("id").to_numpy(), np.diff(offsets)
    keys, place = np.unique(features, return_inverse=True)
    code = place * n + (sizes_of(counts, n) - 1)
    uses = np.bincount(code, minlength=len(keys) * n)
    terms = np.argsort(-uses, kind="stable")[:np.count_nonzero(uses)]
    number = np.zeros(len(uses), np.int32)
    number[terms] = np.arange(len(terms), dtype=np.int32)
    number = number[code]
    order = np.lexsort((ids, counts))
    counts, starts = counts[order], offsets[:-1][order]
    laid = [starts[low + first:low + STRIP_ROWS] + j for low, firsts in strips_of(counts) for j, first in enumerate(firsts)]
    laid = number[np.concatenate(laid)] if laid else number[:0]
    at = np.repeat(np.argsort(order).astype(np.int32), np.diff(offsets))
    back = at[np.lexsort((at, number))]
    labels = matrix_of(rows.column("labels"), rows.num_rows)[order]
    raw = [ids[order], labels.astype(np.int8), counts.astype(np.int32), laid, (terms // n).astype(np.int32), (terms % n + 1).astype(np.int32),
           uses[terms].astype(np.int32), np.diff(back, prepend=np.int32(0))]
    return pa.table([rows.column("part").slice(0, 1), pa.array([keys], pa.list_(pa.int64())), pa.array([len(keys)], pa.int32()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in raw]],
                    names=["part", "keys", "named", "ids", "labels", "counts", "place", "feature", "size", "uses", "back"])


def strips_of(counts: np.ndarray):
    """For rows in the order of their counts: where each strip starts, and its first row that has a j-th term, for each j."""
    for low in range(0, len(counts), STRIP_ROWS):
        strip = counts[low:low + STRIP_ROWS]
        yield low, np.searchsorted(strip, np.arange(strip[-1]), side="right")


def featurise(rows: DataFrame, text: str, pattern: str, positions: Sequence[int], n: int = NGRAMS, buckets: int = BUCKETS,
              part_rows: int = PART_ROWS) -> Features:
    """Features and 0/1 labels of ``rows`` (with a column ``id``), which should be a stored table."""
    spark = rows.sparkSession
    words = F.size(F.split(F.coalesce(F.col(text), F.lit("")), " ")) + 1
    count, terms = rows.agg(F.count("*"), F.coalesce(F.sum(words * n), F.lit(0))).first()
    # small tables are dealt to all cores, large ones into parts of ``part_rows`` rows and ``PART_TERMS`` terms
    parts = max(1, -(-count // part_rows), -(-terms // PART_TERMS), min(spark.sparkContext.defaultParallelism, -(-count // LEAST_ROWS)))
    labels = encode_meter(F.coalesce(F.col(pattern), F.lit("")), max(positions))
    sizes = once(F.size(term_words(F.col(text))), lambda m: F.concat(*[F.array_repeat(F.lit(k + 1), F.greatest(m - k, F.lit(0))) for k in range(n)]))
    found = rows.select("id", dealt("id", spread_numbers(spark, parts)).alias("part"), term_features(F.col(text), n, buckets).alias("features"), sizes.alias("sizes"),
                        F.array(*[F.get(labels, F.lit(p - 1)) for p in positions]).alias("labels"))
    packed = stored_by(found.drop("sizes").repartition(parts, "part").groupBy("part").applyInArrow(lambda part: packed_rows(part, n), PACKED), "part", parts,
                       new_path(spark, "features"), "zstd")
    needs = stage(packed.select("part", F.posexplode("keys").alias("at", "feature")), "needs")
    return Features(found, packed, needs, count, parts)


# models

@dataclass
class Linear:
    """Weights for each choice and position; a choice may set ``n``, ``reg``, ``rate`` and ``max_iter``.

    ``damping`` is the mean gradient below which a number's steps are short: what
    few rows ask for moves less than what many ask for.
    """

    positions: Sequence[int]
    choices: Sequence[dict] = field(default_factory=lambda: [{}])
    rate: float = 1.0
    reg: float = 1e-6
    max_iter: int = EPOCHS
    n: int = NGRAMS
    damping: float = 0.1
    #: A row's score is the sum of what its terms have.
    mean = False

    def __post_init__(self):
        of = lambda name: np.repeat([c.get(name, getattr(self, name)) for c in self.choices], len(self.positions))
        self.rates, self.regs, self.ends, self.sizes = of("rate"), of("reg"), of("max_iter"), of("n")
        self.iterations = int(self.ends.max())
        self.width = len(self.rates)

    def first(self, features: np.ndarray, given: list) -> np.ndarray:
        return np.zeros((len(features), self.width))

    def shared(self) -> np.ndarray | None:
        return None

    def forward(self, vectors: np.ndarray, labels: np.ndarray | None, sizes: np.ndarray, starts: np.ndarray):
        """Probabilities; ``vectors`` are those of the occurrences of some rows."""
        shown = vectors * (sizes[:, None] <= self.sizes)
        return 1 / (1 + np.exp(-np.clip(np.add.reduceat(shown, starts, axis=0), -40, 40)))

    def backward(self, vectors, labels, sizes, starts, y):
        p = self.forward(vectors, labels, sizes, starts)
        miss = p - np.tile(y, len(self.choices))
        counts = np.diff(np.append(starts, len(sizes)))
        return loss_of(p, np.tile(y, len(self.choices))), np.repeat(miss, counts, axis=0) * (sizes[:, None] <= self.sizes), None

    def live(self, iteration: int) -> np.ndarray:
        return iteration < self.ends

    def sent(self, iteration: int | None) -> np.ndarray:
        """Columns whose choices take a step, and all of them for scores (no iteration) and for the last loss."""
        return self.live(iteration) if iteration is not None and iteration < self.iterations - 1 else np.ones(self.width, bool)

    def narrow(self, w: np.ndarray, labels: None, iteration: int | None) -> np.ndarray:
        return w[:, self.sent(iteration)]

    def limits(self, iteration: int | None) -> np.ndarray:
        """The size of terms up to which each column that is sent counts them."""
        return self.sizes[self.sent(iteration)]

    def taking(self, iteration: int) -> np.ndarray:
        """Which of the columns that are sent take a step."""
        return self.live(iteration)[self.sent(iteration)]

    def truth(self, y: np.ndarray, iteration: int) -> np.ndarray:
        return np.tile(y, len(self.choices))[:, self.sent(iteration)]

    def widened(self, sums: np.ndarray, w: np.ndarray, labels: None, iteration: int) -> tuple[np.ndarray, None]:
        """The gradient by whole vectors, and that by the labels' vectors."""
        out = np.zeros_like(w)
        out[:, self.live(iteration)] = sums
        return out, None

    def step(self, w: np.ndarray, gradient: np.ndarray, iteration: int) -> tuple[np.ndarray, np.ndarray]:
        """The gradient with its penalty, and the rate of each column (none once its choice has ended)."""
        return gradient + self.regs * w, self.rates * (iteration < self.ends)


@dataclass
class LowRank:
    """One vector for each word and n-gram and one for each label; a line is the mean of its vectors.

    ``damping`` as in ``Linear``, for the vectors of words and n-grams; gradients are smaller here, by the mean.
    """

    positions: Sequence[int]
    dim: int = DIM
    rate: float = RATE
    max_iter: int = EPOCHS
    seed: int = 1
    damping: float = 0.003
    mean = True

    def __post_init__(self):
        self.iterations, self.width = self.max_iter, self.dim

    def first(self, features: np.ndarray, given: list) -> np.ndarray:
        """Given vectors where there are any, else even draws between -1/dim and 1/dim that depend on the feature alone."""
        out = drawn(features, self.dim, self.seed) / self.dim
        for i, vector in enumerate(given):
            if vector is not None:
                if len(vector) != self.dim:
                    raise ValueError(f"a given vector has {len(vector)} numbers, the model {self.dim}")
                out[i] = vector
        return out

    def shared(self) -> np.ndarray:
        return np.zeros(len(self.positions) * self.dim)

    def lines(self, vectors, starts):
        counts = np.diff(np.append(starts, len(vectors)))
        return np.add.reduceat(vectors, starts, axis=0) / counts[:, None], counts

    def forward(self, vectors, labels, sizes, starts):
        line, _ = self.lines(vectors, starts)
        return 1 / (1 + np.exp(-np.clip(line @ labels.reshape(len(self.positions), self.dim).T, -40, 40)))

    def backward(self, vectors, labels, sizes, starts, y):
        line, counts = self.lines(vectors, starts)
        p = self.forward(vectors, labels, sizes, starts)
        back = (p - y) @ labels.reshape(len(self.positions), self.dim) / counts[:, None]
        return loss_of(p, y), np.repeat(back, counts, axis=0), ((p - y).T @ line).ravel()

    def live(self, iteration: int) -> np.ndarray:
        return np.ones(len(self.positions), bool)

    def narrow(self, w, labels, iteration):
        """The products of vectors and labels' vectors: a line's score is the mean of those of its terms."""
        return w @ labels.reshape(len(self.positions), self.dim).T

    def limits(self, iteration):
        return None

    def taking(self, iteration):
        return self.live(iteration)

    def truth(self, y, iteration):
        return y

    def widened(self, sums, w, labels, iteration):
        return sums @ labels.reshape(len(self.positions), self.dim), (sums.T @ w).ravel()

    def step(self, w, gradient, iteration):
        return gradient, np.float64(self.rate)


def loss_of(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-300)).sum())


def drawn(features: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Even draws between -1 and 1, the same for a feature wherever it is asked for."""
    x = (features.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
         + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) / float(1 << 52) - 1


# the parameter table

def rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column and where each list starts."""
    values = column.combine_chunks()
    offsets = values.offsets.to_numpy()
    return values.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def matrix_of(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """The vectors of ``n`` rows, which are lists or bytes."""
    if pa.types.is_binary(column.type):
        return numbers_in(column).reshape(n, -1)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def arrays(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())


def packed_numbers(rows: np.ndarray, counts: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as bytes, which cross to a task and back as they are; ``counts`` says how many come together."""
    rows = np.ascontiguousarray(rows, np.float64)
    ends = np.arange(len(rows) + 1) if counts is None else np.append(0, np.cumsum(counts))
    ends = pa.py_buffer((ends * (rows.shape[1] * 8)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows) if counts is None else len(counts), [None, ends, pa.py_buffer(rows)])


def numbers_in(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    whole = [np.frombuffer(x.buffers()[2], np.uint8, *span(x)).view(kind) for x in getattr(column, "chunks", [column]) if len(x)]
    return whole[0] if len(whole) == 1 else np.concatenate(whole) if whole else np.zeros(0, kind)


def lengths_in(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """How many numbers of so many bytes each value has."""
    return pc.binary_length(column).to_numpy().astype(np.int64) // size


def unpacked_numbers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return numbers_in(column).reshape(-1, width)


def span(x: pa.Array) -> tuple[int, int]:
    """How many bytes the values of a binary array have, and where they start."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
    return int(ends[-1] - ends[0]), int(ends[0])


class Part:
    """The rows of a part, and for each of its features what was sent of its vector: ``table``."""

    def __init__(self, rows: pa.Table, width: int, labels: int):
        held = lambda name, kind=np.int32: np.frombuffer(rows.column(name)[0].as_py(), kind)
        self.ids, self.counts, self.place = held("ids", np.int64), held("counts"), held("place")
        self.y = held("labels", np.int8).reshape(len(self.ids), labels)
        self.feature, self.size = held("feature"), held("size")
        self.rows = rows
        self.table = np.zeros((rows.column("named")[0].as_py(), width))
        self.known = np.zeros(len(self.table), bool)

    def learn(self, at: np.ndarray, z: np.ndarray) -> None:
        self.table[at], self.known[at] = z, True

    def sums(self, terms: np.ndarray):
        """For each strip of rows where it starts and the sums of its rows over their terms."""
        done = 0
        for low, firsts in strips_of(self.counts):
            total = np.zeros((min(STRIP_ROWS, len(self.counts) - low), terms.shape[1]))
            strip = self.place[done:done + int(self.counts[low:low + len(total)].sum())].astype(np.intp)
            held, at = np.empty_like(total), 0
            for first in firsts.tolist():
                some = held[first:]
                np.take(terms, strip[at:at + len(some)], axis=0, out=some, mode="clip")
                total[first:] += some
                at += len(some)
            done += at
            yield low, total

    def answers(self, model, iteration: int | None):
        """For each strip of rows where it starts, how many terms count and the probabilities."""
        terms, limits = self.table[self.feature], model.limits(iteration)
        if limits is not None and len(limits) and self.size.max(initial=0) > limits.min():
            terms *= self.size[:, None] <= limits
        # features that the model does not have are left out
        some = [np.rint(x) for _, x in self.sums(self.known[self.feature][:, None].astype(np.float64))] if model.mean and not self.known.all() else None
        for i, (low, x) in enumerate(self.sums(terms)):
            counts = self.counts[low:low + len(x), None] if some is None else some[i]
            if model.mean:
                x /= np.maximum(counts, 1)
            yield low, counts, 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def gradient(self, model, iteration: int) -> tuple[float, np.ndarray]:
        """The loss, and for each feature its gradient by what was sent, in the columns that take a step."""
        taking, limits = model.taking(iteration), model.limits(iteration)
        loss, miss = 0.0, np.empty((int(taking.sum()), len(self.ids)))
        for low, counts, p in self.answers(model, iteration):
            y = model.truth(self.y[low:low + len(p)], iteration)
            loss += loss_of(p, y)
            miss[:, low:low + len(p)] = (((p - y) / counts) if model.mean else p - y)[:, taking].T
        # terms are summed by their rows, some terms at a time
        back = np.cumsum(np.frombuffer(self.rows.column("back")[0].as_py(), np.int32), dtype=np.int32)
        ends = np.append(0, np.cumsum(np.frombuffer(self.rows.column("uses")[0].as_py(), np.int32), dtype=np.int64))
        found = np.empty((len(miss), len(ends) - 1))
        cuts = np.unique(np.append(np.searchsorted(ends[:-1], np.arange(0, len(back), SUMMED)), len(ends) - 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = back[ends[a]:ends[b]].astype(np.intp)
            held, starts = np.empty(len(rows)), ends[a:b] - ends[a]
            for label in range(len(miss)):
                np.take(miss[label], rows, out=held, mode="clip")
                np.add.reduceat(held, starts, out=found[label, a:b])
        found = np.ascontiguousarray(found.T)
        if limits is not None and self.size.max(initial=0) > limits[taking].min():
            found *= self.size[:, None] <= limits[taking]
        total = np.zeros((len(self.table), len(miss)))
        for size in range(1, self.size.max(initial=0) + 1):  # a feature has one term of a size at most
            of = self.size == size
            total[self.feature[of]] += found[of]
        return loss, total


def initial(features: Features, model, vectors: DataFrame | None) -> DataFrame:
    """The parameters before the first step, and the places that each is needed in."""
    known = features.needs.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("part", "at"))).alias("places"))
    if vectors is None:
        known = known.select("feature", F.lit(None).cast("array<double>").alias("given"), "places")
    else:
        given = vectors.select(word_feature("word").alias("feature"), F.col("vector").cast("array<double>").alias("given"))
        known = known.join(given.dropDuplicates(["feature"]), "feature", "left").select("feature", "given", "places")

    def made(batches):
        for rows in batches:
            if rows.num_rows:
                first = model.first(rows.column(0).to_numpy(), rows.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), packed_numbers(first), packed_numbers(np.zeros_like(first)), rows.column(2)],
                                                 ["feature", "w", "s", "places"])

    none = bytes(8 * model.width)
    first = features.rows.sparkSession.createDataFrame([(LOSS, none, none, [])], f"{HELD}, {PLACES}")
    return known.mapInArrow(made, f"{HELD}, {PLACES}").unionByName(first)


def as_lists(state: DataFrame) -> DataFrame:
    """The parameters of words and n-grams, from blocks, with their vectors as lists."""
    def made(batches):
        for rows in batches:
            for row in rows.to_pylist():
                keys = np.frombuffer(row["keys"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *[arrays(np.frombuffer(row[c]).reshape(len(keys), -1)) for c in ("w", "s")]],
                                                 ["feature", "w", "s"])

    return state.filter(F.col("block") >= 0).select("keys", "w", "s").mapInArrow(made, STATE)


def narrowed(state: DataFrame, model, labels: np.ndarray | None, iteration: int | None) -> DataFrame:
    """``feature``, or the places it is needed in, with ``z``: what parts need to know of its vector."""
    key = "places" if "places" in state.columns else "feature"

    def made(batches):
        for rows in batches:
            if rows.num_rows:
                w = matrix_of(pa.chunked_array([rows.column(1)]), rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column(0), packed_numbers(model.narrow(w, labels, iteration))], [key, "z"])

    return state.filter(F.col("feature") > LOSS).select(key, "w").mapInArrow(made, f"{PLACES if key == 'places' else 'feature bigint'}, z binary")


#: Columns of a part's row that its sums need.
USED = ["part", "named", "ids", "labels", "counts", "place", "feature", "size", "uses", "back"]


def gradients(state: DataFrame, features: Features, model, labels: np.ndarray | None, iteration: int) -> DataFrame:
    """``of, part, g``: the sums of each part, by what they belong to; the loss stands under ``LOSS``.

    The same as ``replies``, feature by feature.
    """
    width = model.narrow(np.zeros((0, model.width)), labels, iteration).shape[1]

    def summed(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())], names=["of", "part", "g"])
        part = Part(rows, width, len(model.positions))
        part.learn(sent.column("at").to_numpy(), unpacked_numbers(sent.column("z"), width))
        loss, total = part.gradient(model, iteration)
        keys = np.append(rows_of(rows.column("keys"))[0][part.known], LOSS)
        found = pa.chunked_array([packed_numbers(total[part.known]), packed_numbers(np.eye(1, total.shape[1]) * loss)])
        return pa.table([pa.array(keys), pa.array(np.full(len(keys), rows.column("part")[0].as_py())), found], names=["of", "part", "g"])

    placed = narrowed(state, model, labels, iteration).select(F.explode("places").alias("p"), "z").select(
        F.col("p.part").alias("to"), F.col("p.at").alias("at"), "z")
    return (features.packed.select("keys", *USED).groupBy("part").cogroup(placed.groupBy("to"))
            .applyInArrow(summed, "of bigint, part bigint, g binary"))


def step(model, w: np.ndarray, s: np.ndarray, g: np.ndarray, labels: np.ndarray | None, iteration: int):
    """Vectors and their squared gradients after a step, and the gradient by labels."""
    wide, more = model.widened(g, w, labels, iteration)
    wide, rate = model.step(w, wide, iteration)
    s = s + wide * wide
    return w - rate * wide / (np.sqrt(s) + model.damping), s, more


def stepped(state: DataFrame, sums: DataFrame, model, labels: np.ndarray | None, iteration: int, count: int, names: Sequence[int]) -> DataFrame:
    """The parameters after a step along the mean gradient; under ``LABELS`` what each shard adds to the gradient by labels.

    The same as ``moved``, feature by feature.
    """
    live = int(model.live(iteration).sum())
    schema = pa.schema([("shard", pa.int64()), ("feature", pa.int64()), ("w", pa.binary()), ("s", pa.binary()),
                        ("places", pa.list_(pa.struct([("part", pa.int64()), ("at", pa.int32())])))])

    def moved(held: pa.Table, found: pa.Table) -> pa.Table:
        if not held.num_rows or not found.num_rows:
            return schema.empty_table()
        # sums by feature, in the order of parts
        of, by_part = (found.column(c).to_numpy() for c in ("of", "part"))
        order = np.lexsort((by_part, of))
        firsts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        g = np.add.reduceat(unpacked_numbers(found.column("g"), live)[order], firsts, axis=0) / count
        held = held.sort_by("feature").combine_chunks()
        keys = held.column("feature").to_numpy()
        assert np.array_equal(keys, of[order][firsts])
        lost = keys == LOSS
        w, s, more = step(model, *(matrix_of(held.column(c), held.num_rows) for c in ("w", "s")), np.where(lost[:, None], 0.0, g), labels, iteration)
        w[lost, 0] = g[lost, 0]
        out = [pa.table([held.column("shard"), held.column("feature"), packed_numbers(w), packed_numbers(s), held.column("places")],
                        names=schema.names).cast(schema)]
        if more is not None:
            out.append(pa.table([held.column("shard").slice(0, 1).combine_chunks(), [LABELS], [more.tobytes()], [b""], [[]]], schema=schema))
        return pa.concat_tables(out)

    # the sums come to where the parameters lie, which stay there
    here = sums.withColumn("shard", dealt("of", names)).repartition(len(names), "shard")
    return (state.filter(F.col("feature") >= LOSS).groupBy("shard").cogroup(here.groupBy("shard"))
            .applyInArrow(moved, f"shard bigint, {HELD}, {PLACES}"))


# the same in blocks of parameters, with one message for many features

def blocks_of(rows: pa.Table, size: int) -> pa.Table:
    """The parameters of a shard in the order of their features, ``size`` of them to a row."""
    rows = rows.sort_by("feature").combine_chunks()
    ends = np.minimum(np.arange(0, rows.num_rows + size, size), rows.num_rows)
    ends = ends[:len(ends) - (len(ends) > 1 and ends[-1] == ends[-2])]
    counts = np.diff(ends)
    keys = rows.column("feature").to_numpy()
    return pa.table([np.full(len(counts), rows.column("shard")[0].as_py()), pa.array(np.arange(len(counts)), pa.int32()),
                     pa.array([keys[a:a + n].tobytes() for a, n in zip(ends, counts)], pa.binary()),
                     *[packed_numbers(matrix_of(rows.column(c), rows.num_rows), counts) for c in ("w", "s")], pa.nulls(len(counts), pa.binary())],
                    names=["shard", "block", "keys", "w", "s", "extra"])


def routes_of(rows: pa.Table) -> pa.Table:
    """For each part what it needs of a shard: places in the part's table, and in the shard in the order of its features."""
    rows = rows.sort_by("feature").combine_chunks()
    places = rows.column("places").combine_chunks()
    place = np.repeat(np.arange(rows.num_rows, dtype=np.int32), np.diff(places.offsets.to_numpy()))
    part, at = (x.to_numpy(zero_copy_only=False) for x in places.flatten().flatten())
    order = np.lexsort((at, part))
    part, at, place = part[order], at[order], place[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    cuts = [(a + low, min(a + low + ROUTE, b)) for a, b in zip(starts, np.append(starts[1:], len(part))) for low in range(0, b - a, ROUTE)]
    return pa.table([np.full(len(cuts), rows.column("shard")[0].as_py()), pa.array([part[a] for a, _ in cuts], pa.int64()),
                     *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (at, place)]], names=["shard", "part", "at", "place"])


def messages(state: DataFrame, routes: DataFrame, model, labels: np.ndarray | None, iteration: int) -> DataFrame:
    """What each part needs to know of the vectors of each shard, with the places that it is for."""
    names = ["to", "shard", "at", "place", "z"]

    def sent(held: pa.Table, routes: pa.Table) -> pa.Table:
        if not held.num_rows or not routes.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 3, names=names)
        held = held.sort_by("block")
        z = model.narrow(numbers_in(held.column("w")).reshape(-1, model.width), labels, iteration)
        z = z[numbers_in(routes.column("place"), np.int32)]
        return pa.table([routes.column("part"), routes.column("shard"), routes.column("at"), routes.column("place"),
                         packed_numbers(z, lengths_in(routes.column("place"), 4))], names=names)

    return (state.filter(F.col("block") >= 0).select("shard", "block", "w").groupBy("shard").cogroup(routes.groupBy("shard"))
            .applyInArrow(sent, MESSAGES))


def replies(asked: DataFrame, features: Features, model, labels: np.ndarray | None, iteration: int, names: Sequence[int]) -> DataFrame:
    """The sums of each part, for each message one with the same places; one without places holds the loss."""
    width = model.narrow(np.zeros((0, model.width)), labels, iteration).shape[1]
    titles = ["shard", "part", "place", "g"]

    def summed(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 2, names=titles)
        part = Part(rows, width, len(model.positions))
        at = numbers_in(sent.column("at"), np.int32)
        part.learn(at, unpacked_numbers(sent.column("z"), width))
        loss, total = part.gradient(model, iteration)
        found = packed_numbers(total[at], lengths_in(sent.column("at"), 4))
        number = rows.column("part")[0].as_py()
        own = pa.table([[names[0]], [number], [b""], [np.float64(loss).tobytes()]],
                       schema=pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("place", pa.binary()), ("g", pa.binary())]))
        return pa.concat_tables([own, pa.table([sent.column("shard"), pa.array(np.full(len(found), number)), sent.column("place"), found], schema=own.schema)])

    return features.packed.select(*USED).groupBy("part").cogroup(asked.groupBy("to")).applyInArrow(summed, REPLIES)


def moved(state: DataFrame, found: DataFrame, model, labels: np.ndarray | None, iteration: int, count: int, shards: int) -> DataFrame:
    """The parameters after a step along the mean gradient, and what each shard adds to the loss and to the gradient by labels."""
    live = int(model.live(iteration).sum())

    schema = pa.schema([("shard", pa.int64()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("keys", "w", "s", "extra")]])

    def taken(held: pa.Table, found: pa.Table) -> pa.Table:
        shard = (held if held.num_rows else found).column("shard")[0].as_py()
        held = held.sort_by("block").combine_chunks()
        counts = lengths_in(held.column("keys"), 8)
        total, loss, by_labels = np.zeros((int(counts.sum()), live)), 0.0, None
        # in the order of parts; the messages of a part are about different features
        found = found.sort_by([("part", "ascending")])
        for place, g in zip(found.column("place"), found.column("g")):
            place, g = np.frombuffer(place.as_buffer(), np.int32), np.frombuffer(g.as_buffer())
            if len(place):
                total[place] += g.reshape(-1, live)
            else:
                loss += g[0]
        total /= count
        low, out = 0, []
        for n, w, s in zip(counts.tolist(), held.column("w"), held.column("s")):
            w, s = (np.frombuffer(x.as_buffer()).reshape(n, model.width) for x in (w, s))
            w, s, more = step(model, w, s, total[low:low + n], labels, iteration)
            if more is not None:
                by_labels = more if by_labels is None else by_labels + more
            out.append((w, s))
            low += n
        extra = np.append(loss / count, [] if by_labels is None else by_labels)
        own = pa.table([[shard], [-1], [None], [None], [None], [extra.tobytes()]], schema=schema)
        if not out:
            return own
        both = [packed_numbers(np.concatenate(x), counts) for x in zip(*out)]
        return pa.concat_tables([own, pa.table([held.column("shard"), held.column("block"), held.column("keys"), *both,
                                                pa.nulls(len(out), pa.binary())], schema=schema)])

    here = found.repartition(shards, "shard")
    return state.filter(F.col("block") >= 0).groupBy("shard").cogroup(here.groupBy("shard")).applyInArrow(taken, BLOCKS)


def fit(features: Features, model, vectors: DataFrame | None = None) -> DataFrame:
    """The parameter table after the model's iterations: ``feature, w, s``.

    ``vectors`` (word, vector) are where words start from in ``LowRank``.  Each
    iteration writes the table to the shared folder and deletes the one before.
    No rows give a table without features.
    """
    spark = features.rows.sparkSession
    known, named = features.needs.agg(F.count_distinct("feature"), F.count("*")).first()
    # a shard is one task's: its vectors, and what all parts send for them
    sent = named * (16 + 8 * len(model.positions) * len(getattr(model, "choices", [0])))
    shards = max(spark.sparkContext.defaultParallelism, -(-known * model.width * 8 // SHARD_BYTES), -(-sent // SHARD_BYTES))
    names = spread_numbers(spark, shards)
    first, ways, path = (new_path(spark, name) for name in ("first", "routes", "parameters"))
    size = max(1, BLOCK_BYTES // (8 * model.width))
    with shuffles_deleted(spark):
        start = initial(features, model, vectors).filter(F.col("feature") > LOSS).withColumn("shard", dealt("feature", names))
        start = stored_by(start.repartition(shards, "shard"), "shard", shards, first).groupBy("shard")
        routes = stored_by(start.applyInArrow(routes_of, ROUTES), "shard", shards, ways)
        state = stored_by(start.applyInArrow(lambda rows: blocks_of(rows, size), BLOCKS), "shard", shards, path)
        forget(spark, first)
        labels, squares, lost = model.shared(), 0.0, 0.0
        for iteration in range(model.iterations if features.count else 0):
            after, here = new_path(spark, "parameters"), stored(spark, path)
            found = replies(messages(here, routes, model, labels, iteration), features, model, labels, iteration, names)
            state = stored_by(moved(here, found, model, labels, iteration, features.count, shards), "shard", shards, after)
            # one row of the width of all labels for each shard
            more = state.filter(F.col("block") < 0).select("shard", "extra").collect()
            added = [np.frombuffer(r["extra"]) for r in sorted(more, key=lambda r: r["shard"])]
            lost = sum(x[0] for x in added)
            if labels is not None:
                g = sum(x[1:] for x in added if len(x) > 1)
                squares = squares + g * g
                labels = labels - model.rate * g / (np.sqrt(squares) + TINY)
            forget(spark, path)
            path = after
        forget(spark, ways)
    special = [(LOSS, [float(lost)], [0.0])]
    if labels is not None:
        special.append((LABELS, labels.tolist(), (labels * 0 + squares).tolist()))
    return as_lists(state).unionByName(spark.createDataFrame(special, STATE))


def loss(state: DataFrame) -> float:
    """The mean loss of a row before the last step."""
    return state.filter(F.col("feature") == LOSS).first()["w"][0]


def scores(state: DataFrame, features: Features, model, vectors: DataFrame | None = None) -> DataFrame:
    """``id, scores``: the probability of every label, for ``Linear`` position by position for each choice.

    Words that no training row had count where ``vectors`` has them; other
    features that the model does not have are left out, and a row without any
    known feature has scores of one half.
    """
    shared = None if model.shared() is None else np.array(state.filter(F.col("feature") == LABELS).first()["w"])
    if vectors is not None:
        asked = features.needs.select("feature").distinct().join(state, "feature", "left_anti")
        more = vectors.select(word_feature("word").alias("feature"), F.col("vector").cast("array<double>").alias("w"))
        state = state.select("feature", "w").unionByName(more.dropDuplicates(["feature"]).join(asked, "feature", "left_semi"))
    width = model.width if isinstance(model, Linear) else len(model.positions)

    def scored(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], names=["id", "scores"])
        part = Part(rows, width, len(model.positions))
        part.learn(sent.column("at").to_numpy(), unpacked_numbers(sent.column("z"), width))
        out = np.empty((len(part.ids), width))
        for low, _, p in part.answers(model, None):
            out[low:low + len(p)] = p
        return pa.table([pa.array(part.ids), arrays(out)], names=["id", "scores"])

    placed = features.needs.join(narrowed(state.select("feature", "w"), model, shared, None), "feature").select(F.col("part").alias("to"), "at", "z")
    return (features.packed.select(*USED[:-2]).groupBy("part").cogroup(placed.groupBy("to"))
            .applyInArrow(scored, "id bigint, scores array<double>"))
