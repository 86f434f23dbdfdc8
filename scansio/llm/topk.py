"""Exact top-k search by tiled matrix products.

Queries lie in blocks and candidates in shards, both by a hash of their id and
with a bounded number of rows.  Each pair of a block and a shard is one tile: a
task multiplies the two matrices, in strips, and keeps each query's best k by
partial selection.  A tree of merges, ``FAN`` lists to one, brings the lists of a
query together, so no task ever holds more than ``FAN * k`` candidates of it.

Scores are exact: whole numbers whose sums stay below 2^53 are multiplied as
doubles, larger ones as Python's whole numbers, kept inside the range of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.session import stage

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
STRIP = 128
FAN = 16
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def matrices(ids: np.ndarray, column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each dimension."""
    edges = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(edges)
    found = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        found[int(d)] = ids[rows], values[edges[rows][:, None] + np.arange(d)].reshape(len(rows), d)
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact for whole numbers."""
    if a.dtype.kind == "f":
        return a @ b.T
    top = [int(np.abs(x.astype(np.float64)).max(initial=0)) + 1 for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, id and score of each row's k best, ties to the smaller id; ``ids`` ascend."""
    rows, picked = [], []
    for r in range(len(scores)):
        line = scores[r]
        others = np.flatnonzero(ids != own[r])
        if len(others) > k:
            value = line[others]
            least = np.partition(value, len(value) - k)[len(value) - k]
            others = others[value >= least]
        others = others[np.lexsort((others, -line[others]))][:k]
        rows.append(np.full(len(others), r))
        picked.append(others)
    row, place = np.concatenate(rows), np.concatenate(picked)
    return row, ids[place], scores[row, place]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, n_queries: int, n_candidates: int,
          score: str = "bigint") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k candidates of highest inner product.

    Both frames hold ``vec_id, vector`` (arrays of bigint or double without
    nulls).  A query never meets a candidate with its own vec_id.  Vectors meet
    those of their own length only.  Ties go to the smaller vec_id; a query with
    fewer than k candidates gets all.  Of query rows with equal vec_id the least
    vector counts; candidate rows count each.  ``n_queries`` and
    ``n_candidates`` size the tiles and change no result.
    """
    shards = max(1, -(-n_candidates // SHARD_ROWS))
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = (queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
             .select("vec_id", "vector", part(blocks).alias("block"), each(shards).alias("shard")))
    # under other names: a cogroup of two frames of one origin loses columns that both have
    there = candidates.select(F.col("vec_id").alias("other_id"), F.col("vector").alias("other"),
                              part(shards).alias("shard"), each(blocks).alias("block"))
    kind = pa.int64() if score == "bigint" else pa.float64()

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = left.column("shard")[0].as_py()
            split = [matrices(t.column(i).to_numpy(), t.column(v).combine_chunks())
                     for t, i, v in ((left, "vec_id", "vector"), (right, "other_id", "other"))]
            for d, (own, a) in split[0].items():
                if d not in split[1]:
                    continue
                ids, b = split[1][d]
                order = np.argsort(ids, kind="stable")
                ids, b = ids[order], b[order]
                for s in range(0, len(a), STRIP):
                    row, found, value = best(products(a[s:s + STRIP], b), ids, own[s:s + STRIP], k)
                    out.append((own[s + row], found, value, np.full(len(row), shard)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2].astype(kind.to_pandas_dtype())), pa.array(columns[3], pa.int64())],
                        names=["query_id", "vec_id", "score", "node"])

    found = (asked.groupBy("block", "shard").cogroup(there.groupBy("block", "shard"))
             .applyInArrow(tile, f"query_id bigint, vec_id bigint, score {score}, node bigint"))
    lists = found.select("query_id", "node", F.struct((-F.col("score")).alias("low"), "vec_id").alias("hit"))
    merged = lists.groupBy("query_id", "node").agg(F.collect_list("hit").alias("hits"))
    while shards > 1:
        shards = -(-shards // FAN)
        merged = (merged.groupBy("query_id", F.floor(F.col("node") / FAN).alias("node"))
                  .agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")))
    return (merged.select("query_id", F.posexplode(F.slice(F.array_sort("hits"), 1, k)).alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.low")).alias("score")))


def search(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``, among all other rows.

    Components are ``floor(scale * x)``, scores whole inner products.  Rows whose
    vec_id or vector is null or holds a null or a number that is not finite take
    no part.
    """
    vectors = stage(embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
                    .select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("vector")),
                    "vectors")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    return top_k(asked, vectors, k, asked.count(), vectors.count())
