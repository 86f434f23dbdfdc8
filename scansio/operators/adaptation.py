"""Few-shot classification by a head that learns to adapt: gradient meta-learning on frozen vectors.

The head is a hidden layer with rectified units and a softmax over the classes
of an episode.  An episode adapts a copy of the shared start by a few gradient
steps on its support rows, and its loss is that of the adapted copy on its query
rows.  The shared start follows the gradient of that loss *through* the steps
(second order), or of the adapted copy alone (first order).

Episodes are dealt to tasks; a task holds one episode at a time and returns the
sum over its episodes, so an iteration is one job and the driver adds one row
for each task.  The head itself is small: it grows with the width of the
vectors and not with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.operators.metrics import arg_max
from scansio.session import new_path

# The published settings of the few-shot experiment.
HIDDEN = 200
META_RATE = 0.005
RATE = 0.01
TASKS_PER_STEP = 32
STEPS = 5
ITERATIONS = 1000
#: Tasks of one iteration, and so rows of sums that reach the driver.
TASKS = 32
#: Files of one iteration.
SLICES = 8
SUMS = "loss double, hits bigint, asked bigint, episodes bigint, gradient binary"


@dataclass
class Head:
    """Parameters of the head, or anything of their shape: a gradient, a direction."""

    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @classmethod
    def new(cls, width: int, hidden: int, ways: int, seed: int = 1) -> Head:
        """Uniform draws of the usual width, the inverse root of a layer's inputs."""
        draw = np.random.default_rng(seed)
        a, b = 1 / np.sqrt(max(1, width)), 1 / np.sqrt(hidden)
        return cls(draw.uniform(-a, a, (width, hidden)), draw.uniform(-a, a, hidden),
                   draw.uniform(-b, b, (hidden, ways)), draw.uniform(-b, b, ways))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def plus(self, other: Head, times: float) -> Head:
        return Head(*[a + times * b for a, b in zip(self.parts(), other.parts())])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Head:
        """A head of this one's shape with the given numbers."""
        edges = np.cumsum([0, *[p.size for p in self.parts()]])
        return Head(*[flat[a:b].reshape(p.shape) for a, b, p in zip(edges, edges[1:], self.parts())])


@dataclass
class Pass:
    """One look at some rows: the scores, the mean loss and what its gradient needs."""

    rows: np.ndarray
    head: Head
    labels: np.ndarray

    def __post_init__(self):
        z = self.rows @ self.head.inner + self.head.inner_bias
        self.open = z > 0
        self.hidden = np.where(self.open, z, 0.0)
        logits = self.hidden @ self.head.outer + self.head.outer_bias
        self.scores = logits - logits.max(1, keepdims=True)
        self.scores -= np.log(np.exp(self.scores).sum(1, keepdims=True))
        self.share = np.exp(self.scores)

    @property
    def loss(self) -> float:
        return float(-self.scores[np.arange(len(self.labels)), self.labels].mean())

    @property
    def hits(self) -> int:
        return int((self.scores.argmax(1) == self.labels).sum())

    def miss(self) -> np.ndarray:
        """The loss by the logits."""
        out = self.share.copy()
        out[np.arange(len(self.labels)), self.labels] -= 1
        return out / len(self.labels)

    def gradient(self) -> Head:
        miss = self.miss()
        back = miss @ self.head.outer.T * self.open
        return Head(self.rows.T @ back, back.sum(0), self.hidden.T @ miss, miss.sum(0))

    def curved(self, way: Head) -> Head:
        """The change of the gradient along ``way``: the Hessian times a direction, without the Hessian."""
        moved = (self.rows @ way.inner + way.inner_bias) * self.open
        logits = moved @ self.head.outer + self.hidden @ way.outer + way.outer_bias
        turned = self.share * (logits - (self.share * logits).sum(1, keepdims=True)) / len(self.labels)
        miss = self.miss()
        back = (turned @ self.head.outer.T + miss @ way.outer.T) * self.open
        return Head(self.rows.T @ back, back.sum(0), moved.T @ miss + self.hidden.T @ turned, turned.sum(0))


def adapted(start: Head, rows: np.ndarray, labels: np.ndarray, rate: float, steps: int) -> tuple[Head, list[Pass]]:
    """The head after ``steps`` gradient steps on the support rows, and the pass of each step."""
    head, passes = start, []
    for _ in range(steps):
        passes.append(Pass(rows, head, labels))
        head = head.plus(passes[-1].gradient(), -rate)
    return head, passes


def episode_gradient(start: Head, support: tuple, query: tuple, rate: float, steps: int,
                     second_order: bool = True) -> tuple[Pass, Head]:
    """The query pass of the adapted head, and the gradient of its loss by the shared start."""
    head, passes = adapted(start, *support, rate, steps)
    asked = Pass(query[0], head, query[1])
    gradient = asked.gradient()
    if second_order:
        for one in reversed(passes):
            gradient = gradient.plus(one.curved(gradient), -rate)
    return asked, gradient


@dataclass
class Adam:
    """The usual moving averages of the gradient and of its square."""

    rate: float
    slow: float = 0.9
    slower: float = 0.999
    floor: float = 1e-8

    def __post_init__(self):
        self.mean = self.square = 0.0
        self.steps = 0

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = self.slow * self.mean + (1 - self.slow) * gradient
        self.square = self.slower * self.square + (1 - self.slower) * gradient ** 2
        mean, square = self.mean / (1 - self.slow ** self.steps), self.square / (1 - self.slower ** self.steps)
        return at - self.rate * mean / (np.sqrt(square) + self.floor)


def episodes_of(rows: DataFrame, vector: str) -> DataFrame:
    """One row for each episode and part: ``asked, slots, keys`` of its rows, support first, and their vectors end to end.

    An episode is a few rows by construction, and as one row no split of a file can part it.
    """
    plain = F.transform(F.col(vector), lambda x: x.cast("double"))
    held = rows.select("episode", "part", F.struct(
        (F.col("role") == "query").alias("asked"), "slot", F.col("row_key").cast("bigint").alias("row_key"), plain.alias("v")).alias("r"))
    rows_ = F.array_sort(F.collect_list("r"))
    return held.groupBy("episode", "part").agg(rows_.alias("r")).select(
        "episode", "part", F.col("r.asked").alias("asked"), F.col("r.slot").cast("array<bigint>").alias("slots"),
        F.col("r.row_key").alias("keys"), F.flatten("r.v").alias("vectors"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The episodes of ``episodes_of``: slots, keys and vectors of their support and their query rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = {}
        for name in ("asked", "slots", "keys", "vectors"):
            column = batch.column(batch.schema.get_field_index(name))
            offsets = column.offsets.to_numpy()
            held[name] = column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]
        names = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("episode", "part")]
        for i, key in enumerate(zip(*names)):
            asked, slots, keys, vectors = (x[at[i]:at[i + 1]] for x, at in held.values())
            vectors, query = vectors.reshape(len(slots), -1), asked.astype(bool)
            yield {"key": key, "support": (vectors[~query], slots[~query]), "query": (vectors[query], slots[query]),
                   "query_keys": keys[query].tolist()}


def episode_table(rows: DataFrame, vector: str, tasks_per_step: int, iterations: int) -> tuple[DataFrame, list[int]]:
    """Episodes in a stored table with a folder for each of the first iterations, and the numbers of these."""
    spark = rows.sparkSession
    number = F.floor(F.col("episode") / tasks_per_step).cast("bigint")
    # one number for each iteration that there is, at most ``iterations``
    found = [r[0] for r in rows.select(number.alias("iteration")).distinct().orderBy("iteration").limit(iterations).collect()]
    path = new_path(spark, "episodes")
    table = episodes_of(rows.filter(number <= found[-1]) if found else rows, vector).withColumn("iteration", number)
    # a few files for each iteration: a step reads one stage of them
    slices = F.pmod(F.xxhash64("episode", "part"), F.lit(SLICES))
    table.repartition("iteration", slices).sortWithinPartitions("iteration", "episode", "part").write.partitionBy("iteration").parquet(path)
    return spark.read.schema(table.schema).parquet(path), found


def meta_step(table: DataFrame, start: Head, rate: float, steps: int, second_order: bool, tasks: int) -> tuple[dict, Head]:
    """Sums over the episodes of one iteration: loss, hits, rows asked and episodes, and the mean gradient."""
    shared = table.sparkSession.sparkContext.broadcast(start.flat())
    shape = Head(*[np.zeros(p.shape) for p in start.parts()])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = shape.like(shared.value), shape.flat()
        loss, hits, asked, episodes = 0.0, 0, 0, 0
        for one in gathered(batches):
            seen, gradient = episode_gradient(head, one["support"], one["query"], rate, steps, second_order)
            total += gradient.flat()
            loss, hits = loss + seen.loss, hits + seen.hits
            asked, episodes = asked + len(seen.labels), episodes + 1
        if episodes:
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([hits]), pa.array([asked]), pa.array([episodes]), pa.array([total.tobytes()])],
                ["loss", "hits", "asked", "episodes", "gradient"])

    # at most ``tasks`` rows; sorted, as the order in which tasks end must not change a sum
    rows = sorted(table.coalesce(tasks).mapInArrow(summed, SUMS).collect(), key=lambda r: bytes(r["gradient"]))
    shared.unpersist()
    sums = {name: sum(r[name] for r in rows) for name in ("loss", "hits", "asked", "episodes")}
    total = sum((np.frombuffer(bytes(r["gradient"])) for r in rows), np.zeros(shape.flat().size))
    return sums, start.like(total / max(1, sums["episodes"]))


def meta_fit(rows: DataFrame, vector: str, ways: int, iterations: int = ITERATIONS, tasks_per_step: int = TASKS_PER_STEP,
             rate: float = RATE, steps: int = STEPS, meta_rate: float = META_RATE, hidden: int = HIDDEN,
             second_order: bool = True, seed: int = 1, tasks: int = TASKS) -> tuple[Head, DataFrame]:
    """The shared start after meta-learning, and ``iteration, episodes, loss, accuracy`` of each iteration.

    ``rows`` are those of ``episode_rows`` with ``row_key``: an iteration takes the
    ``tasks_per_step`` episodes whose number falls into it, as far as there are
    any.  Losses are means over an episode's rows; accuracies are those of the
    adapted heads before the start moves.
    """
    spark = rows.sparkSession
    table, found = episode_table(rows, vector, tasks_per_step, iterations)
    curve = []
    if not found:
        return Head.new(0, hidden, ways, seed), spark.createDataFrame([], CURVE)
    first = table.filter(F.col("iteration") == found[0]).first()
    head = Head.new(len(first["vectors"]) // len(first["slots"]), hidden, ways, seed)
    adam = Adam(meta_rate)
    for iteration in found:
        sums, gradient = meta_step(table.filter(F.col("iteration") == iteration), head, rate, steps, second_order, tasks)
        curve.append((iteration, sums["episodes"], sums["loss"] / sums["episodes"], sums["hits"] / max(1, sums["asked"])))
        head = head.like(adam.step(head.flat(), gradient.flat()))
    return head, spark.createDataFrame(curve, CURVE)


CURVE = "iteration bigint, episodes bigint, loss double, accuracy double"


def adapted_scores(start: Head, rows: DataFrame, vector: str, rate: float = RATE, steps: int = STEPS,
                   tasks: int | None = None) -> DataFrame:
    """``episode, part, slot, row_key, scores, predicted`` of every query row, each episode with its own adapted head."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(start)
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in gathered(batches):
            head, _ = adapted(shared.value, *one["support"], rate, steps)
            seen = Pass(one["query"][0], head, one["query"][1])
            n = len(seen.labels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one["key"][0]] * n, pa.int64()), pa.array([one["key"][1]] * n, pa.string()),
                 pa.array(seen.labels, pa.int32()), pa.array(one["query_keys"], pa.int64()), pa.array(seen.scores.tolist())],
                ["episode", "part", "slot", "row_key", "scores"])

    placed = episodes_of(rows, vector)
    found = (placed.repartition(tasks, "episode", "part") if tasks else placed).mapInArrow(
        scored, "episode bigint, part string, slot int, row_key bigint, scores array<double>")
    return found.withColumn("predicted", arg_max("scores"))
