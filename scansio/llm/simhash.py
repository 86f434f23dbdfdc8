"""SimHash fingerprints and their near-duplicates by a self-join of a binary trie.

Equal fingerprints are one node.  The trie is walked in pairs of subtrees: two
subtrees whose prefixes differ in more bits than allowed hold no link and are
left.  The pairs of the first ``depth`` bits are dealt out as tasks, so a task
holds two subtrees of bounded average size; inside it the walk goes on bit by
bit, all pairs of a level side by side, and small subtrees are compared whole.
A task returns a spanning forest of the links it found, not the links, so a
large family of near copies stays as large as its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import by_slice, extended
from scansio.llm.components import components
from scansio.session import stage

SEED = 42
#: Fingerprints of a subtree that one task holds, on average.
SUBTREE = 1 << 15
#: Two subtrees with at most this many pairs are compared whole.
WHOLE = 256
#: Pairs of subtrees, or of fingerprints, in one step.
STEP = 1 << 18
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes_of(text: str | None, words: int) -> bytes:
    """The hashes of all shingles, eight bytes each; a text of fewer words is one shingle."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    digest = xxhash.xxh64_digest
    spans = zip(starts[:len(parts) - width + 1].tolist(), ends[width - 1:].tolist())
    return b"".join([digest(joined[a:b], SEED) for a, b in spans])


def fingerprint(text: str | None, words: int) -> bytes:
    """Eight bytes; a bit is set if more than half of all shingles' hashes have it."""
    hashes = np.frombuffer(hashes_of(text, words), np.uint8)
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65_280):  # bits of a part add up below 2^16
        bits = np.unpackbits(hashes[8 * k:8 * (k + 65_280)].reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """The frame's ``text`` replaced by ``hash``, the fingerprint as a signed long. Null text is empty."""
    keep = [c for c in docs.columns if c != "text"]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join([fingerprint(t, words) for t in rows.column(len(keep)).to_pylist()])
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.frombuffer(raw, ">i8").astype(np.int64))],
                                          [*keep, "hash"])

    return docs.select(*keep, "text").mapInArrow(by_slice(batch), extended(docs.select(*keep), "hash bigint"))


# the trie

def masks(depth: int, errors: int) -> list[int]:
    """All numbers of ``depth`` bits with at most ``errors`` of them set."""
    found, last = {0}, {0}
    for _ in range(min(errors, depth)):
        last = {m | 1 << b for m in last for b in range(depth)}
        found |= last
    return sorted(found)


def _pairs_of(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Positions (i, j) of all members of pairs of ranges, in steps."""
    width = high2 - low2
    sizes = (high - low) * width
    edges = np.searchsorted(np.cumsum(sizes), np.arange(STEP, int(sizes.sum()) + STEP, STEP), "right") + 1
    start = 0
    for end in np.unique(np.minimum(edges, len(sizes))).tolist():
        n = sizes[start:end]
        if n.sum():
            which = np.repeat(np.arange(start, end), n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield low[which] + inside // width[which], low2[which] + inside % width[which]
        start = end


def trie_join(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs that differ in at most ``errors`` bits: of two subtrees, or of one with itself.

    ``a`` and ``b`` are sorted, and each shares its first ``depth`` bits.
    """
    own = b is None
    other = a if own else b
    if not len(a) or not len(other):
        return
    spent = int(np.bitwise_count((a[0] ^ other[0]) >> np.uint64(64 - depth))) if depth else 0
    if spent > errors:
        return
    todo = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(other), spent)))]
    while todo:
        d, low, high, low2, high2, spent_ = todo.pop()
        if len(low) > STEP:
            half = len(low) // 2
            todo += [(d, *(x[:half] for x in (low, high, low2, high2, spent_))),
                     (d, *(x[half:] for x in (low, high, low2, high2, spent_)))]
            continue
        small = ((high - low) * (high2 - low2) <= WHOLE) | (d >= 64)
        for i, j in _pairs_of(*(x[small] for x in (low, high, low2, high2))):
            if own:
                i, j = i[i < j], j[i < j]
            near = np.bitwise_count(a[i] ^ other[j]) <= errors
            if near.any():
                yield i[near], j[near]
        low, high, low2, high2, spent_ = (x[~small] for x in (low, high, low2, high2, spent_))
        if not len(low):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        split = np.searchsorted(a, (a[low] & ~(bit | (bit - np.uint64(1)))) | bit)
        split2 = np.searchsorted(other, (other[low2] & ~(bit | (bit - np.uint64(1)))) | bit)
        split, split2 = np.clip(split, low, high), np.clip(split2, low2, high2)
        parts = [(low, split, low2, split2, spent_), (split, high, split2, high2, spent_),
                 (low, split, split2, high2, spent_ + 1), (split, high, low2, split2, spent_ + 1)]
        if own:  # a subtree with itself: each pair of its halves once
            same = low == low2
            one, two, three, four = parts
            parts = [one, two, three, tuple(x[~same] for x in four)]
        level = [np.concatenate(x) for x in zip(*parts)]
        live = (level[4] <= errors) & (level[1] > level[0]) & (level[3] > level[2])
        todo.append((d + 1, *(x[live] for x in level)))


class Forest:
    """Sets of positions, joined by links; keeps the least position of each set as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root[:] = above

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


def links(hashes: DataFrame, errors: int, count: int) -> DataFrame:
    """``a, b``: a forest that links what the near pairs of distinct ``hash`` values link.

    ``count`` sizes the subtrees and changes no result.
    """
    depth = max(0, (max(1, count) // SUBTREE).bit_length())
    prefix = F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")
    near = F.array(*[F.lit(m).cast("long") for m in masks(depth, errors)])
    dealt = (hashes.select("hash", prefix.alias("prefix")).withColumn("mask", F.explode(near))
             .select("hash", F.least("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).alias("one"),
                     F.greatest("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).alias("two")))

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        one, two = key[0].as_py(), key[1].as_py()
        values = np.sort(rows.column("hash").to_numpy().view(np.uint64))
        if one == two:
            a, b = values, None
        else:
            border = int(np.searchsorted(values, np.uint64(two) << np.uint64(64 - depth)))
            a, b = values[:border], values[border:]
        forest = Forest(len(values))
        for i, j in trie_join(a, b, depth, errors):
            forest.join(i, j if b is None else j + len(a))
        child, root = forest.edges()
        return pa.table([pa.array(values[child].view(np.int64)), pa.array(values[root].view(np.int64))], names=["a", "b"])

    return dealt.groupBy("one", "two").applyInArrow(task, "a bigint, b bigint")


def near_duplicates(rows: DataFrame, errors: int = 3) -> DataFrame:
    """``hash, component, component_id`` for every distinct hash of ``rows`` (doc_id, hash), a stored table.

    A component is named by its least hash; its id is the smallest doc_id
    reachable over hashes that differ in at most ``errors`` bits.  Null ids count
    as greater than all others; a component of rows without ids has none.
    """
    nodes = stage(rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")), "hashes")
    found = components(links(nodes.select("hash"), errors, nodes.count()))
    grouped = nodes.join(found.withColumnRenamed("node", "hash"), "hash", "left").select(
        "hash", "doc_id", F.coalesce("component", "hash").alias("component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "component").select("hash", "component", "component_id")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    rows = stage(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    return rows.join(near_duplicates(rows), "hash").select(
        "doc_id", hexadecimal(F.col("hash")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``marked`` (doc_id, text_hash, component).

    The smallest doc_id stays.  Of documents with equal ids in a component the one
    whose text has the smallest hash stays, of repeated rows one.  Rows without an
    id stay only in a component without ids.  Only keys are grouped; the texts move
    once, by their key.
    """
    text_hash = F.xxhash64("text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = marked.groupBy("component").agg(F.min(key).alias("first"))
    gone = stage(marked.join(first, "component").filter(key != F.col("first")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text_hash == gone["gone_hash"]), "left_anti")
    repeated = marked.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def keep_one(docs: DataFrame, errors: int = 3) -> DataFrame:
    """``docs`` with one document of each component of near fingerprints; all columns stay."""
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").transform(fingerprints), "fingerprints")
    marked = rows.join(near_duplicates(rows.select("doc_id", "hash"), errors).drop("component_id"), "hash")
    return first_of_each(docs, marked)
