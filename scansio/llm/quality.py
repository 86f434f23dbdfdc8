"""Quality classifier: a factorisation machine on hashed words and structure.

A document's features are its hashed words (counts, scaled to length one) and
statistics of its structure and metadata, among them its length; all come from
the whole text.  The score is::

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so pairwise interactions of all features cost one pass over them.  The machine
is fitted on a bounded sample of labelled rows, in one task; scoring is a scan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import by_slice, extended

#: Labelled rows that are fitted on, at most; drawn by a hash of doc_id.
TRAIN_ROWS = 16_000
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 6
BATCH = 128
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3
FOLDS = 5

STRUCTURE = ("one", "letters", "upper", "digits", "blanks", "marks", "bars", "bangs", "other", "lines", "words",
             "distinct", "repeated", "top_word", "word_length", "marked_words", "upper_words", "barred_lines",
             "loud_lines", "repeated_lines", "length", "blank")
#: Byte classes in the order of the counts below.
UPPER, LETTER, DIGIT, BLANK, BAR, BANG, STOP, OTHER, WIDE = range(9)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = UPPER, LETTER, DIGIT, WIDE
    kinds[[9, 10, 11, 12, 13, 32]], kinds[ord("|")], kinds[ord("!")] = BLANK, BAR, BANG
    kinds[[ord(c) for c in ".,;:?'-\"()"]] = STOP
    return kinds


CLASSES = _classes()


def structure(raw: bytes, text: str, words: list[str], counts: Counter) -> list[float]:
    """The values of ``STRUCTURE``, each about between 0 and 1."""
    n, m = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=9) / n
    lines = text.split("\n")
    many = max(1, len(lines))
    repeated = sum(a == b for a, b in zip(words, words[1:])) / m
    marked = sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\"-)|") / m
    upper = sum(k for w, k in counts.items() if w.isupper() and len(w) > 1) / m
    return [1.0, kinds[LETTER] + kinds[WIDE], kinds[UPPER], kinds[DIGIT], kinds[BLANK], kinds[STOP], kinds[BAR],
            kinds[BANG], kinds[OTHER], min(1.0, many / m), min(1.0, np.log1p(m) / 12), len(counts) / m, repeated,
            max(counts.values(), default=0) / m, min(2.0, n / m / 10), marked, upper,
            sum("|" in x for x in lines) / many, sum(x.isupper() for x in lines) / many,
            1 - len(set(lines)) / many, min(1.0, np.log1p(len(raw)) / 16), float(not words)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    stats = structure(text.encode(), text, words, counts)
    hashed: Counter = Counter()
    for word, k in counts.items():
        hashed[zlib.crc32(word.lower().encode()) & (BUCKETS - 1)] += k
    values = np.fromiter(hashed.values(), np.float64, len(hashed))
    if len(values):
        values /= np.sqrt((values * values).sum())
    number = np.concatenate([np.arange(len(stats)), np.fromiter(hashed, np.int64, len(hashed)) + len(stats)])
    return number, np.concatenate([np.array(stats), values])


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, values and first positions of several documents' features."""
    sizes = np.array([len(r[0]) for r in rows])
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Machine:
        size = len(STRUCTURE) + BUCKETS
        draw = np.random.default_rng(seed)
        return cls(0.0, np.zeros(size), draw.normal(0, 0.05, (size, FACTORS)))

    def margins(self, number: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins by the sum-of-squares identity, and the sums that its gradient needs."""
        scaled = self.factors[number] * value[:, None]
        sums = np.add.reduceat(scaled, first)
        squares = np.add.reduceat((scaled * scaled).sum(1), first)
        linear = np.add.reduceat(self.weights[number] * value, first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), scaled, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return sigmoid(self.margins(*stacked(rows))[0])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
        """Adaptive gradient steps on the logistic loss."""
        draw = np.random.default_rng(seed)
        size = len(self.weights)
        sum_w, sum_v, sum_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = draw.permutation(len(rows))
            for start in range(0, len(order), BATCH):
                picked = order[start:start + BATCH]
                number, value, first = stacked([rows[i] for i in picked])
                margin, scaled, sums = self.margins(number, value, first)
                slope = (sigmoid(margin) - labels[picked]) / len(picked)
                each = np.repeat(np.arange(len(picked)), np.diff(np.append(first, len(number))))
                step = slope[each] * value
                used, place = np.unique(number, return_inverse=True)
                g = np.bincount(place, step) + DECAY * self.weights[used]
                sum_w[used] += g * g
                self.weights[used] -= RATE * g / np.sqrt(sum_w[used])
                push = step[:, None] * (sums[each] - scaled)
                g = np.column_stack([np.bincount(place, push[:, f]) for f in range(FACTORS)]) + DECAY * self.factors[used]
                sum_v[used] += g * g
                self.factors[used] -= RATE * g / np.sqrt(sum_v[used])
                b = slope.sum()
                sum_b += b * b
                self.bias -= RATE * b / np.sqrt(sum_b)
        return self

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.weights, self.factors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Machine:
        flat = np.frombuffer(raw, "<f8")
        size = len(STRUCTURE) + BUCKETS
        return cls(float(flat[0]), flat[1:size + 1].copy(), flat[size + 1:].reshape(size, FACTORS).copy())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from fitting; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """The machine fitted on at most ``rows`` labelled documents that are not held out.

    The rows are those of least hash of doc_id, so they do not depend on the
    order of the table.  Of several labels of an id the least counts; null labels
    do not.  Without labelled rows the machine scores by chance.
    """
    sample = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def extract(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*part.columns[:2], pa.array([n.astype("<i4").tobytes() for n, _ in found], pa.binary()),
             pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "quality", "number", "value"])

    def train(parts):
        got = [r for part in parts for r in zip(*(c.to_pylist() for c in part.columns))]
        got.sort(key=lambda r: (r[0], r[2], r[3]))
        machine = Machine.new()
        if got:
            known = [(np.frombuffer(n, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for _, _, n, v in got]
            machine.fit(known, np.array([float(r[1] > 0) for r in got]))
        yield pa.RecordBatch.from_arrays([pa.array([machine.to_bytes()], pa.binary())], ["machine"])

    # ``rows`` ids at most: a bound that does not grow with the input
    drawn = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
             .mapInArrow(by_slice(extract), "doc_id bigint, quality int, number binary, value binary"))
    fitted = drawn.repartition(1).mapInArrow(train, "machine binary").first()
    return Machine.from_bytes(bytes(fitted["machine"])) if fitted else Machine.new()


def scored(docs: DataFrame, machine: Machine, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score between 0 and 1; null and empty texts are scored by their structure alone."""
    schema = extended(docs, f"`{score}` double")
    at = docs.columns.index(text)
    names = schema.names

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = machine.scores([features(t) for t in rows.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], names)

    return docs.mapInArrow(by_slice(batch), schema)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    machine = fit(docs, labels)
    rows = scored(docs.select("doc_id", "text"), machine)
    return rows.select("doc_id", held_out().alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
