"""Hard negatives inside a score window below each positive, by disjoint score slots.

An anchor's positives are its best rows of the same label.  A positive of score
``p`` asks for the best rows of other labels with ``low * p <= 100 * score <=
high * p``.  The windows of one anchor overlap, so they are not searched one by
one:

1. The upper limits of an anchor's windows, in falling order, cut the scores
   into disjoint slots; a score lies in the slot of the least limit that is not
   below it.
2. One pass of tiles (a block of anchors against a shard of rows) scores every
   row once and keeps the best k of each slot; a tree of merges keeps the best k
   of a slot over all shards.  At most ``positives * k`` rows of an anchor exist
   anywhere.
3. From the lowest slot upwards, lists are merged: the best k at or below a
   limit are the best k of its slot and of the merged list below.  Each window
   is a merged list cut at the window's lower end.

Scores are whole numbers, exact as said in ``topk.products``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.llm.topk import BLOCK_ROWS, SHARD_ROWS, STRIP, matrices, products, quantised, usable
from scansio.session import stage

FAN = 16
#: A row found by a tile: what makes it a better one comes first.
HIT = "struct<low: bigint, id: bigint, row: bigint>"


def participants(embeddings: DataFrame, scale: int) -> DataFrame:
    """``vec_id, row, label, vector`` of the rows that take part; ``row`` tells rows of one id apart."""
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    return (embeddings.filter(able)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    quantised(F.col("embedding"), scale).alias("vector"))
            .withColumn("row", F.xxhash64("label", "vector")).dropDuplicates(["vec_id", "row"]))


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties in the order of positions."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.argsort(-scores[near], kind="stable")][:k]


def tiled(anchors: DataFrame, rows: DataFrame, pick: Callable, n_anchors: int, n_rows: int) -> DataFrame:
    """``anchor_id, anchor_row, slot, node, hit``: what ``pick`` keeps of each anchor in each shard.

    ``pick(line, same, own, limits)`` gets the scores of one anchor with the rows
    of a shard in order of id, which of them have its label, which is the anchor
    itself, and the anchor's limits; it yields slots and positions.
    """
    shards, blocks = max(1, -(-n_rows // SHARD_ROWS)), max(1, -(-n_anchors // BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = anchors.select("vec_id", "row", "label", "vector", "limits", part(blocks).alias("block"), each(shards).alias("shard"))
    there = rows.select(F.col("vec_id").alias("other_id"), F.col("row").alias("other_row"), F.col("label").alias("other_label"),
                        F.col("vector").alias("other"), part(shards).alias("shard"), each(blocks).alias("block"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            shard = left.column("shard")[0].as_py()
            right = right.sort_by([("other_id", "ascending"), ("other_row", "ascending")])
            limits = left.column("limits").to_pylist()
            ids, row, label = (left.column(c).to_numpy() for c in ("vec_id", "row", "label"))
            other_id, other_row, other_label = (right.column(c).to_numpy() for c in ("other_id", "other_row", "other_label"))
            theirs = matrices(np.arange(right.num_rows), right.column("other").combine_chunks())
            for d, (mine, a) in matrices(np.arange(left.num_rows), left.column("vector").combine_chunks()).items():
                if d not in theirs:
                    continue
                there_, b = theirs[d]
                for s in range(0, len(a), STRIP):
                    for me, line in zip(mine[s:s + STRIP].tolist(), products(a[s:s + STRIP], b)):
                        own = (other_id[there_] == ids[me]) & (other_row[there_] == row[me])
                        for slot, found in pick(line, other_label[there_] == label[me], own, limits[me]):
                            at = there_[found]
                            out.append((np.full(len(at), ids[me]), np.full(len(at), row[me]), np.full(len(at), slot),
                                        np.full(len(at), shard), -line[found].astype(np.int64), other_id[at], other_row[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 7
        return pa.table([pa.array(c, pa.int64()) for c in columns],
                        names=["anchor_id", "anchor_row", "slot", "node", "low", "id", "row"])

    return (asked.groupBy("block", "shard").cogroup(there.groupBy("block", "shard"))
            .applyInArrow(tile, "anchor_id bigint, anchor_row bigint, slot bigint, node bigint, low bigint, id bigint, row bigint")
            .select("anchor_id", "anchor_row", "slot", "node", F.struct("low", "id", "row").alias("hit")))


def merged(found: DataFrame, k: int, n_rows: int) -> DataFrame:
    """``anchor_id, anchor_row, slot, hits``: the best k of each slot, by a tree of merges over the shards."""
    keys = ["anchor_id", "anchor_row", "slot"]
    lists = found.groupBy(*keys, "node").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    shards = max(1, -(-n_rows // SHARD_ROWS))
    while shards > 1:
        shards = -(-shards // FAN)
        lists = (lists.groupBy(*keys, F.floor(F.col("node") / FAN).alias("node"))
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")))
    return lists.select(*keys, F.slice("hits", 1, k).alias("hits"))


def windows(slots: list[Column], k: int) -> list[Column]:
    """For each slot the best k at or below its upper limit: suffixes merged from the last slot upwards."""
    below = F.array().cast(f"array<{HIT}>")
    out = []
    for hits in reversed(slots):
        below = F.slice(F.array_sort(F.concat(F.coalesce(hits, F.array().cast(f"array<{HIT}>")), below)), 1, k)
        out.append(below)
    return out[::-1]


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 5, low: int = 80, high: int = 100,
         scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive.

    ``embeddings`` holds ``vec_id, label, embedding``; further columns are not
    read.  Anchors are the rows whose vec_id is divisible by ``every``; components
    are ``floor(scale * x)``, scores inner products, higher ones first and ties by
    smaller vec_id.  ``high`` is at most 100, so a window ends at the positive's
    own score when it is 100.

    Rows without vec_id, label or vector, or with a component that is null or not
    finite, take no part.  Repeated rows count once; rows of one vec_id that
    differ are rows of their own (ties among them by a hash of label and vector),
    and only the anchor itself is shut out of its lists.  Vectors of different
    lengths never meet.  An anchor without a positive, and a positive without a
    negative in its window, give no row; an empty table gives an empty one.
    """
    rows = stage(participants(embeddings, scale), "participants")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), asked.count()

    def same(line, same_label, own, limits):
        at = np.flatnonzero(same_label & ~own)
        yield 0, at[first(line[at], positives)]

    none = asked.withColumn("limits", F.array().cast("array<bigint>"))
    best = stage(merged(tiled(none, rows, same, n_anchors, n_rows), positives, n_rows)
                 .select("anchor_id", "anchor_row", F.col("hits").alias("positives")), "positives")
    # the window's upper end as a whole score, in falling order of positives
    top = lambda p: F.floor(-p["low"].cast("decimal(38,0)") * high / 100).cast("long")
    limits = F.array_distinct(F.transform("positives", top))
    best = best.withColumn("limits", limits)

    def slotted(line, same_label, own, limits):
        rising = np.array(limits[::-1])
        at = np.flatnonzero(~same_label & (line <= limits[0]))
        slot = len(limits) - 1 - np.searchsorted(rising, line[at])
        for s in range(len(limits)):
            inside = at[slot == s]
            if len(inside):
                yield s, inside[first(line[inside], k)]

    limited = asked.join(best.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"), "limits"),
                         ["vec_id", "row"])
    slots = merged(tiled(limited, rows, slotted, n_anchors, n_rows), k, n_rows)
    each = slots.groupBy("anchor_id", "anchor_row").agg(*[
        F.max(F.when(F.col("slot") == s, F.col("hits"))).alias(f"slot_{s}") for s in range(positives)])
    answers = F.array(*windows([F.col(f"slot_{s}") for s in range(positives)], k))
    asked_of = best.join(each, ["anchor_id", "anchor_row"]).select(
        "anchor_id", "limits", answers.alias("answers"), F.explode("positives").alias("positive"))
    score = -F.col("positive.low").cast("decimal(38,0)")
    window = F.get("answers", F.array_position("limits", top(F.col("positive"))).cast("int") - 1)
    inside = F.filter(window, lambda n: -n["low"].cast("decimal(38,0)") * 100 >= score * low)
    return (asked_of.select("anchor_id", "positive", F.posexplode(inside).alias("place", "negative"))
            .select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("place") + 1).alias("rank"),
                    F.col("negative.id").alias("negative_id"), (-F.col("positive.low")).alias("positive_score"),
                    (-F.col("negative.low")).alias("negative_score")))
