"""Best-fit packing of token pieces after a dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram:
at most ``capacity`` counts, however many pieces there are.  The histogram is
all that the driver sees.  On it

1. sets of up to three lengths that provably dominate every alternative are
   fixed, as often as the counts allow (Martello and Toth);
2. what remains is packed by best-fit decreasing, many equal sequences at once.

The outcome is a list of segments: pieces number ``low`` to ``high`` of a length
go, ``each`` to a sequence, to a run of sequences at one offset.  Pieces get
their number inside their length from counts per cell and a window inside each
cell, so a length that most pieces share is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.llm.bpe import packed
from scansio.llm.common import by_slice
from scansio.session import stage

CELL_ROWS = 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


# pieces

def letters() -> dict[int, str]:
    """The letter by which the tokenizer's vocabulary writes each byte.

    Visible Latin-1 characters stand for themselves, the other bytes follow from
    256 on in their order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


class Words:
    """Ids of a text by a tokenizer file.

    The file's merges are in the order of the ids they make (checked), so the ids
    are those of byte-level BPE by rank, and the ranks encode whole texts without
    a cache.  With ``added``, the file's added tokens are tokens wherever a text
    names one, as in the library's default setting: such a text is left to the
    library that the file is written for, as is one that the fast path refuses.
    """

    def __init__(self, path: str, pattern: str, added: bool = False):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        names = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.named = regex.compile("|".join(map(regex.escape, sorted(names)))).search if added and names else None
        tokenizer.encode_special_tokens = not added
        self.whole = tokenizer.encode
        byte = {letter: b for b, letter in letters().items()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if t not in names}
        with open(path, encoding="utf-8") as file:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(file)["model"]["merges"]]
        made = [ranks[bytes(map(byte.__getitem__, a + b))] for a, b in merges]
        if made != sorted(set(made)) or {r for t, r in ranks.items() if len(t) > 1} != set(made):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def ids(self, text: str) -> bytes:
        if not (self.named and self.named(text)):
            try:
                return self.encode(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # a run of white space too long for that pattern engine
                pass
        return packed(self.whole(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def words(path: str, pattern: str, added: bool = False) -> Words:
    """One tokenizer for each file in a Python worker."""
    return Words(path, pattern, added)


def cut(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which takes the rest."""
    rest = tokens % capacity
    return [rest] * (rest > 0) + [capacity] * (tokens // capacity)


def tokenise(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2,
             added: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids``.

    A document is its ids and the end id (a null or empty text is the end id
    alone); ids are little-endian unsigned 32-bit.  Only documents longer than
    ``capacity`` are cut, and their first piece may be shorter.  ``added`` is said at ``Words``.
    """
    tail = end.to_bytes(4, "little")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        encoder = words(path, pattern, added)
        out: list[tuple] = []
        for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            ids = encoder.ids(text or "") + tail
            start = 0
            for number, length in enumerate(cut(len(ids) // 4, capacity)):
                out.append((doc, number, start, length, ids[4 * start:4 * (start + length)]))
                start += length
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                          ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(by_slice(batch), PIECES)


# the histogram

@dataclass
class Bins:
    """``count`` equal sequences: how many of each length they hold."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)


class Sizes:
    """Counts of lengths, with the distinct lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {w: n for w, n in counts.items() if n}
        self.order = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.order[bisect_left(self.order, size)]

    def largest(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        found: list[int] = []
        for w in self.order:
            found += [w] * min(n - len(found), self.counts[w])
            if len(found) == n:
                break
        return found


def dominating(sizes: Sizes, w: int, room: int) -> list[int] | None:
    """Lengths to put next to one of length ``w`` so that no choice can be better; None if none is provable.

    ``sizes`` holds all other pieces and ``room`` is what ``w`` leaves.  A set
    dominates another if the other's pieces can be parted into groups, each no
    longer than a piece of the set of its own: exchanging them costs nothing.
    """
    best = sizes.largest(room)
    if best is None:
        return []
    small = sizes.smallest(3)
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return [best]
    if len(small) == 3 and sum(small) <= room:
        return None
    # at most two pieces fit: the longest pair, and the longest shorter piece of any pair
    pair = shorter = 0
    i, j = 0, bisect_right(sizes.order, room) - 1
    order = sizes.order
    while i <= j:
        a, b = order[i], order[j]
        if a + b > room:
            j -= 1
            continue
        if i < j or sizes.counts[a] > 1:
            pair, shorter = max(pair, a + b), max(shorter, a)
        i += 1
    if best >= pair:
        return [best]
    sizes.take(best, 1)
    second = sizes.largest(room - best)
    restore(sizes, best)
    return [best, second] if second is not None and second >= shorter else None


def restore(sizes: Sizes, size: int) -> None:
    if size not in sizes.counts:
        insort(sizes.order, size)
    sizes.counts[size] = sizes.counts.get(size, 0) + 1


def reduce(sizes: Sizes, capacity: int) -> list[Bins]:
    """Fix dominating sets until none is left; ``sizes`` keeps the rest."""
    fixed: list[Bins] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(sizes.counts, reverse=True):
            while w in sizes.counts:
                sizes.take(w, 1)
                with_it = dominating(sizes, w, capacity - w)
                restore(sizes, w)
                if with_it is None:
                    break
                need = {s: ([w, *with_it]).count(s) for s in {w, *with_it}}
                # taking pieces away leaves every proof true while these pieces last
                times = min(sizes.counts[s] // n for s, n in need.items())
                for s, n in need.items():
                    sizes.take(s, n * times)
                fixed.append(Bins(times, sorted(need.items(), reverse=True)))
                changed = True
    return fixed


def best_fit(sizes: Sizes, capacity: int) -> list[Bins]:
    """Best-fit decreasing over counts: an open sequence is filled on as long as the length fits."""
    open_: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(room: int, bins: Bins) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(bins)

    for w in sorted(sizes.counts, reverse=True):
        left = sizes.counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                bins = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, bins = capacity, Bins(-(-left // (capacity // w)))
            each = room // w
            full = min(bins.count, left // each)
            rest = bins.count - full
            left -= full * each
            if full:
                put(room - each * w, Bins(full, [*bins.items, (w, each)]))
            if rest and left:
                put(room - left * w, Bins(1, [*bins.items, (w, left)]))
                rest, left = rest - 1, 0
            if rest:
                put(room, Bins(rest, bins.items))
    return [b for bins in open_.values() for b in bins]


def segments(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first sequence, each, offset) for runs of pieces of one length."""
    bad = [w for w in counts if not 1 <= w <= capacity]
    if bad:
        raise ValueError(f"lengths must lie between 1 and {capacity}: {bad[:3]}")
    sizes = Sizes(counts)
    used = dict.fromkeys(counts, 0)
    out, sequence = [], 0
    for bins in [*reduce(sizes, capacity), *best_fit(sizes, capacity)]:
        offset = 0
        for w, each in bins.items:
            low = used[w]
            used[w] = low + each * bins.count
            out.append((w, low, used[w], sequence, each, offset))
            offset += each * w
        sequence += bins.count
    return out


# the pieces again

def numbered(pieces: DataFrame, order: Iterable[str], total: int) -> DataFrame:
    """``pieces`` with their number ``rank`` among those of their length, from 0."""
    order = list(order)
    cells = max(1, -(-total // CELL_ROWS))
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "cell").orderBy(*order)
    return (celled.withColumn("number", F.row_number().over(inside) - 1).join(base, ["length", "cell"])
            .withColumn("rank", F.col("base") + F.col("number")).drop("base", "number", "cell"))


def pack(pieces: DataFrame, capacity: int = 1024, order: Iterable[str] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: few sequences of at most ``capacity`` tokens.

    ``pieces`` should be a stored table: it is read for the histogram and again
    for the placement.  Repeated rows are pieces of their own.  An empty table
    gives an empty one.
    """
    spark = pieces.sparkSession
    # at most ``capacity`` rows, whatever the input
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = segments(counts, capacity)
    placed = spark.createDataFrame(
        [tuple(map(int, s)) for s in plan],
        "length bigint, low bigint, high bigint, first bigint, each bigint, base bigint")
    rows = numbered(pieces, order, sum(counts.values()))
    inside = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # segments: a few for each length, bounded by the capacity
    return (rows.alias("p").join(F.broadcast(placed).alias("s"), inside)
            .select(*[f"p.{c}" for c in pieces.columns],
                    F.expr("first + (rank - low) div each").alias("sequence_id"),
                    F.expr("base + (rank - low) % each * p.length").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``length`` and the joined ``ids``; each holds at most one capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))


def packed_digests(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2,
                   added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = tokenise(docs, path, pattern, capacity, end, added)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stage(narrow, "pieces"), capacity)
