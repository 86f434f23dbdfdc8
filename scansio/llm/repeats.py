"""Repeated strings over all documents, by suffixes sorted at anchors.

A byte goes if a string of ``width`` bytes over it also starts earlier (in a
smaller doc_id, or before in the same document).  Steps:

1. Every window of ``width`` bytes belongs to one anchor (``anchors``), and equal
   windows to equal anchors.  A row is an anchor with its run of windows and a
   hash of the run's bytes.  Rows whose run equals an earlier one in the same
   slice of documents are settled before the shuffle, so a passage that a third
   of all documents share does not meet whole in one task.
2. Rows are partitioned by the anchor's hash.  Anchors that occur once are
   dropped.  Of equal runs all but the first are repeats.  First runs whose
   anchor has different runs are compared byte by byte: their text is fetched.
3. For each anchor the suffixes from it and the reversed prefixes up to it are
   sorted (``deepshallow``).  Two runs share the window that starts ``l`` bytes
   before the anchor if they share ``l`` bytes before and ``width - l`` from it
   on: a block of neighbours in either order.  All but the first are repeats.
4. Repeats are joined to the documents and cut out.

The text moves twice, by doc_id; what else moves are rows of a few numbers.
A null text is empty.  Rows with equal doc_id and equal text are one document
and get the same result; rows with equal doc_id and other text are told apart by
the 64-bit hash of the text, the tag, which also orders them.  A null doc_id
counts as greater than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scansio.llm.anchors import anchors
from scansio.llm.common import by_slice, extended, slices
from scansio.llm.deepshallow import sort_strings
from scansio.session import stage

WIDTH = 100
GRAM = 32
#: Anchors whose text one step of the comparison holds, beyond the group it ends in.
STEP_ROWS = 20_000
LAST_DOC = (1 << 63) - 1
PLACE_SHIFT = 14

ANCHORS = "h bigint, content bigint, doc bigint, tag bigint, packed bigint"
RANGES = "doc bigint, tag bigint, low bigint, high bigint"


def pack(place, first, last):
    """An order by place, with the window offsets below: place - last and place - first."""
    return (place << PLACE_SHIFT) | ((place - last) << 7) | (place - first)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, first and last window."""
    place = packed >> PLACE_SHIFT
    return place, place - (packed & 127), place - (packed >> 7 & 127)


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of slices of documents; repeats inside a slice come as rows without a content hash."""
    for rows in slices(batches, 512):
        parts = []
        for doc, tag, text in zip(*(c.to_pylist() for c in rows.columns)):
            place, h, first, last, content = anchors(np.frombuffer((text or "").encode(), np.uint8), WIDTH, GRAM)
            if len(place):
                parts.append((h, content, np.full(len(place), doc), np.full(len(place), tag), pack(place, first, last)))
        if not parts:
            continue
        h, content, doc, tag, packed = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((packed, tag, doc, content, h))
        h, content, doc, tag, packed = h[order], content[order], doc[order], tag[order], packed[order]
        equal = np.concatenate(([False], (h[1:] == h[:-1]) & (content[1:] == content[:-1])))
        leader = np.maximum.accumulate(np.where(equal, 0, np.arange(len(h))))
        settled = equal & ((doc != doc[leader]) | (tag != tag[leader]) | (packed != packed[leader]))
        # settled rows travel by document instead, which spreads a common passage
        h = np.where(settled, doc * np.int64(0x5851F42D4C957F2D) + tag + packed, h)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(content, mask=settled), pa.array(doc), pa.array(tag), pa.array(packed)],
            ["h", "content", "doc", "tag", "packed"])


def _key() -> list[Column]:
    """What tells documents apart."""
    return [F.expr(f"coalesce(cast(doc_id as bigint), {LAST_DOC})").alias("doc"),
            F.xxhash64("text").alias("tag")]


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(*_key(), "text")


def _classes(docs: DataFrame) -> DataFrame:
    """doc, tag, packed, h and whether the run is a repeat or is to be compared."""
    rows = _numbered(docs).filter(F.octet_length("text") >= WIDTH).mapInArrow(_anchor_rows, ANCHORS)
    runs = Window.partitionBy("h", "content").orderBy("doc", "tag", "packed")
    all_ = Window.partitionBy("h")
    marked = rows.select(
        "*", F.first("doc").over(runs).alias("d0"), F.first("tag").over(runs).alias("t0"),
        F.first("packed").over(runs).alias("p0"),
        F.min("content").over(all_).alias("least"), F.max("content").over(all_).alias("most"))
    first = (F.col("doc") == F.col("d0")) & (F.col("tag") == F.col("t0")) & (F.col("packed") == F.col("p0"))
    return (marked.select("doc", "tag", "packed", "h", (F.col("content").isNull() | ~first).alias("repeat"),
                          (F.col("least") != F.col("most")).alias("differ"))
            .filter("repeat or differ").drop("differ"))


def _ranges(classes: DataFrame) -> DataFrame:
    """The bytes of whole repeated runs."""
    place = f"shiftright(packed, {PLACE_SHIFT})"
    return classes.filter("repeat").selectExpr(
        "doc", "tag", f"{place} - (packed & 127) as low",
        f"{place} - (shiftright(packed, 7) & 127) + {WIDTH} as high")


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """h, doc, tag, packed and the bytes of the runs to be compared."""
    wanted = (classes.filter("not repeat")
              .groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "packed")).alias("wanted")))
    joined = _numbered(docs).join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out_h, out_doc, out_tag, out_packed, out_text = [], [], [], [], []
        lists = rows.column(3)
        edges = lists.offsets.to_numpy()
        h = lists.values.field("h").to_numpy()
        packed = lists.values.field("packed").to_numpy()
        for i, (doc, tag, text) in enumerate(zip(*(rows.column(k).to_pylist() for k in range(3)))):
            raw = text.encode()
            mine = packed[edges[i]:edges[i + 1]]
            _, first, last = unpack(mine)
            out_text += [raw[a:b] for a, b in zip(first.tolist(), (last + WIDTH).tolist())]
            out_h.append(h[edges[i]:edges[i + 1]])
            out_packed.append(mine)
            out_doc.append(np.full(len(mine), doc))
            out_tag.append(np.full(len(mine), tag))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.concatenate(c)) for c in (out_h, out_doc, out_tag, out_packed)), pa.array(out_text, pa.binary())],
            ["h", "doc", "tag", "packed", "run"])

    return joined.mapInArrow(by_slice(batch), "h bigint, doc bigint, tag bigint, packed bigint, run binary")


def shared_windows(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, packed: np.ndarray,
                   runs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Byte ranges (row, low, high) of the windows of runs that an earlier run of the same anchor has too."""
    order = np.lexsort((packed, tag, doc, h))
    h, doc, tag, packed = h[order], doc[order], tag[order], packed[order]
    n = len(order)
    place, first, last = unpack(packed)
    before, behind = WIDTH - GRAM, -(-WIDTH // 8) * 8
    ahead = np.zeros((n, behind), np.uint8)
    back = np.zeros((n, -(-before // 8) * 8), np.uint8)
    for i, (k, middle) in enumerate(zip(order.tolist(), (place - first).tolist())):
        run = runs[k]
        right, left = run[middle:middle + WIDTH], run[:middle][::-1]
        ahead[i, :len(right)] = np.frombuffer(right, np.uint8)
        back[i, :len(left)] = np.frombuffer(left, np.uint8)
    by_right, share_right = sort_strings(h, ahead, GRAM + 16)
    by_left, share_left = sort_strings(h, back, 16)
    block_right, block_left = np.empty(n, np.int64), np.empty(n, np.int64)
    covered = np.zeros((n, before + 2), bool)
    nearest, farthest = place - last, place - first
    earlier = np.zeros(n, bool)
    for l in range(before + 1):
        valid = np.flatnonzero((nearest <= l) & (l <= farthest))
        if len(valid) < 2:
            continue
        block_right[by_right] = np.cumsum(share_right < WIDTH - l)
        block_left[by_left] = np.cumsum(share_left < l)
        key = block_right[valid] * (n + 1) + block_left[valid]
        sort = np.argsort(key, kind="stable")  # the rows are in order of document and place
        key = key[sort]
        again = np.concatenate(([False], key[1:] == key[:-1]))
        # the same place of the same document (a repeated row) is not earlier
        leader = valid[sort[np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))]]
        rows = valid[sort]
        earlier[:] = False
        earlier[rows] = again & (
            (doc[rows] != doc[leader]) | (tag[rows] != tag[leader]) | (packed[rows] != packed[leader]))
        covered[:, l + 1] = earlier
    change = np.diff(covered.astype(np.int8), axis=1, append=0)
    row, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    # offsets low .. high - 1 before the anchor
    return order[row], place[row] - (high - 1), place[row] - low + WIDTH


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows; the rows of an anchor come one after the other."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def done(table: pa.Table) -> pa.RecordBatch:
        h, doc, tag, packed = (table.column(k).to_numpy() for k in range(4))
        row, low, high = shared_windows(h, doc, tag, packed, table.column(4).to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(tag[row]), pa.array(low), pa.array(high)],
            ["doc", "tag", "low", "high"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < STEP_ROWS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column(0).to_numpy()
        whole = int(np.searchsorted(h, h[-1]))  # sorted by h: all but the last group is complete
        if whole:
            yield done(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows -= whole
    if rows:
        yield done(pa.Table.from_batches(held))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc, tag, low, high``: bytes of documents that repeat; ranges of a document may overlap."""
    classes = stage(_classes(docs), "repeat-classes")
    runs = _texts(docs, classes).repartition("h").sortWithinPartitions("h").mapInArrow(_compare, RANGES)
    return _ranges(classes).unionByName(stage(runs, "repeat-windows"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges as maximal disjoint ones; those that touch are one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate(([True], low[1:] > high[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)
    return low[new], high[last]


def cut(docs: DataFrame) -> DataFrame:
    """``row, kept, n_bytes, n_removed, n_spans`` of every document.

    ``row`` is a struct of the document's other columns, whatever their names;
    ``kept`` the bytes that stay.  They need not be valid UTF-8, as a range may
    begin or end inside a character.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*keep).alias("row"), "text", *_key())
    ranges = (repeated_ranges(docs.select("doc_id", "text")).groupBy("doc", "tag")
              .agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
    joined = base.join(ranges, ["doc", "tag"], "left").select("row", "text", "ranges")
    schema = extended(joined.select("row"), "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(2)
        edges = lists.offsets.to_numpy()
        lows, highs = lists.values.field("low").to_numpy(), lists.values.field("high").to_numpy()
        kept, total, removed, spans = [], [], [], []
        for i, text in enumerate(rows.column(1).to_pylist()):
            raw = (text or "").encode()
            mine = slice(edges[i], edges[i + 1])
            total.append(len(raw))
            if mine.start == mine.stop:
                kept.append(raw)
                removed.append(0)
                spans.append(0)
                continue
            low, high = merged(lows[mine], highs[mine])
            starts, ends = [0, *high.tolist()], [*low.tolist(), len(raw)]
            kept.append(b"".join([raw[a:b] for a, b in zip(starts, ends)]))
            removed.append(int((high - low).sum()))
            spans.append(len(low))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, removed, spans))],
            ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(by_slice(batch), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return cut(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: Iterable[tuple[int, bytes]], width: int = WIDTH) -> dict[int, tuple[int, int, int, str]]:
    """The same for a few documents, window by window; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, raw in sorted(texts):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - width + 1):
            window = raw[i:i + width]
            if window in seen:
                gone[i:i + width] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]),
                    hashlib.sha256(kept).hexdigest())
    return out
