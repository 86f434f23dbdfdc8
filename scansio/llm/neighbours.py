"""Near-duplicate vectors by range search on a robust-pruned flat graph.

1. Equal vectors are one node with a count; copies are never expanded.
2. Pivots that lie apart are chosen from a bounded sample, and every node goes to
   the shards of its two nearest pivots.  A shard of more than ``BLOCK`` nodes is
   dealt into blocks by a hash, so a dense family is never one task.
3. Each block builds its part of the graph: the nearest candidates and a few
   random ones, thinned by robust pruning, with edges in both directions.
4. The adjacency lists of all blocks are united for each node.
5. Each block is searched by the nodes of its shard (those whose nearest pivot it
   is), block by block: a greedy walk from the block's medoid, then an expansion of
   all nodes in range until no new one is found.  Nodes outside that a list names
   come along.
6. Cosines are checked in double precision; components are the least vec_id over
   links.
7. Links are audited: the degrees of a bounded sample of nodes, by brute force
   over all nodes, against the degrees found.  While the recall is below
   ``RECALL``, the search is made again from other pivots and its links are added,
   so what one choice of pivots parts, another brings together.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.llm.components import components
from scansio.llm.topk import usable
from scansio.session import stage

#: Nodes from which pivots are chosen, and so a bound on the pivots every task holds.
SAMPLE = 8192
#: Bytes of the vectors that an audit asks about.
AUDIT_BYTES = 16 << 20
#: Recall that the audit must find, and the searches after which its failure is an error.
RECALL, ROUNDS = 0.97, 24
#: Nodes for one pivot.
SHARD = 1000
#: Nodes of a block, on average at most.
BLOCK = 4096
#: Pivots differ by more than the families they gather.
APART = 0.7
NEAREST, RANDOM, KEPT, FAR = 40, 24, 12, 4
BEAM = 12
ALPHA = 1.2


def unit_rows(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of which no two have a cosine of ``APART`` or more."""
    chosen = np.zeros((0, sample.shape[1]))
    for row in sample:
        if len(chosen) == most:
            break
        if not len(chosen) or (chosen @ row).max() < APART:
            chosen = np.vstack([chosen, row])
    return chosen


# the graph

def pruned(similar: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Positions of candidates, nearest first, that no kept one dominates (robust pruning)."""
    far = np.sqrt(np.maximum(0, 2 - 2 * similar))
    open_ = np.ones(len(similar), bool)
    kept: list[int] = []
    for c in np.argsort(-similar, kind="stable").tolist():
        if not open_[c]:
            continue
        kept.append(c)
        if len(kept) == most:
            break
        open_ &= ALPHA * np.sqrt(np.maximum(0, 2 - 2 * among[c])) > far
    return kept


def build(rows: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adjacency lists of a block: pruned near and random candidates, and the edges back to a few more."""
    n = len(rows)
    draw = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for start in range(0, n, 256):
        strip = rows[start:start + 256] @ rows.T
        strip[np.arange(len(strip)), np.arange(start, start + len(strip))] = -2
        near = np.argpartition(-strip, min(NEAREST, n - 1) - 1, axis=1)[:, :min(NEAREST, n - 1)] if n > 1 else np.zeros((len(strip), 0), int)
        for r in range(len(strip)):
            me = start + r
            kept = [near[r][c] for c in pruned(strip[r][near[r]], rows[near[r]] @ rows[near[r]].T, KEPT)]
            other = np.unique(draw.integers(0, n, RANDOM))
            other = other[other != me]
            kept += [other[c] for c in pruned(strip[r][other], rows[other] @ rows[other].T, FAR)]
            out.append(np.unique(np.array(kept, np.int64)))
    source = np.repeat(np.arange(n), [len(x) for x in out])
    target = np.concatenate(out) if n else np.zeros(0, np.int64)
    back: list[list[int]] = [[] for _ in range(n)]
    for s, t in zip(source.tolist(), target.tolist()):
        if len(back[t]) < KEPT:
            back[t].append(s)
    return [np.unique(np.concatenate([a, np.array(b, np.int64)])) for a, b in zip(out, back)]


# the search

class Graph:
    """Vectors and lists of what one task holds; lists name positions."""

    def __init__(self, rows: np.ndarray, lists: list[np.ndarray]):
        self.rows = rows
        width = max([1, *map(len, lists)])
        self.lists = np.full((len(rows), width), len(rows))
        for i, near in enumerate(lists):
            self.lists[i, :len(near)] = near
        self.seen = np.zeros(len(rows) + 1, bool)

    def fresh(self, nodes: np.ndarray) -> np.ndarray:
        """Neighbours of ``nodes`` that this search has not met."""
        found = self.lists[nodes].ravel()
        found = found[~self.seen[found]]
        if len(found):
            found = np.unique(found)
            self.seen[found] = True
        return found

    def within(self, query: np.ndarray, starts: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of at least the given cosine that the search meets, and the cosines."""
        self.seen[:] = False
        self.seen[-1] = True
        met = np.unique(np.array(starts))
        self.seen[met] = True
        all_, score = [met], [self.rows[met] @ query]
        beam, value, spent = met, score[0], np.zeros(len(met), bool)
        while not spent.all():  # greedy: expand the best few until none of them is new
            found = self.fresh(beam[~spent])
            spent[:] = True
            if len(found):
                s = self.rows[found] @ query
                all_.append(found)
                score.append(s)
                beam, value = np.concatenate([beam, found]), np.concatenate([value, s])
                spent = np.concatenate([spent, np.zeros(len(found), bool)])
                top = np.argsort(-value, kind="stable")[:BEAM]
                beam, value, spent = beam[top], value[top], spent[top]
        nodes, values = np.concatenate(all_), np.concatenate(score)
        edge = nodes[values >= least]
        hits, cosines = [edge], [values[values >= least]]
        while len(edge):  # range: expand everything inside
            found = self.fresh(edge)
            s = self.rows[found] @ query
            edge = found[s >= least]
            hits.append(edge)
            cosines.append(s[s >= least])
        return np.concatenate(hits), np.concatenate(cosines)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``node, n, vector`` of distinct vectors: the least vec_id and the number of rows."""
    return vectors.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))


def assigned(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``node, shard, rank`` for the two nearest pivots, the nearest with rank 0."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def batches(parts):
        for rows in parts:
            if not rows.num_rows:
                continue
            near = unit_rows(rows.column(1), rows.num_rows) @ shared.value.T
            take = min(2, len(shared.value))
            first = np.argsort(-near, axis=1, kind="stable")[:, :take]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rows.column(0).to_numpy(), take)), pa.array(first.ravel().astype(np.int64)),
                 pa.array(np.tile(np.arange(take), rows.num_rows))], ["node", "shard", "rank"])

    return nodes.select("node", "vector").mapInArrow(batches, "node bigint, shard bigint, rank bigint")


def links(nodes: DataFrame, least: float = 0.9, wanted: float = RECALL) -> DataFrame:
    """``a, b, n_a, n_b``: pairs of nodes (a < b) found with a cosine of ``least`` or more, and their counts.

    ``nodes`` (node, n, vector) is a stored table of distinct vectors of one
    length.  Searches go on from other pivots until the audited recall is ``wanted``.
    """
    true, found = degrees(nodes, least), None
    for round_ in range(ROUNDS):
        more = links_once(nodes, least, round_)
        found = stage(more if found is None else found.unionByName(more).distinct(), "links")
        share = audited(true, found)
        logging.getLogger(__name__).info("search %d: audited recall %.4f of %d nodes", round_, share, len(true))
        if share >= wanted:
            return found
    raise RuntimeError(f"recall {share:.3f} after {ROUNDS} searches")


def degrees(nodes: DataFrame, least: float) -> dict[int, int]:
    """The number of other nodes in range of each sampled node, by brute force over all nodes."""
    first = nodes.select("vector").first()
    if first is None:
        return {}
    most = max(64, min(SAMPLE, AUDIT_BYTES // (8 * max(1, len(first["vector"])))))
    # at most ``most`` rows reach the driver
    asked = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(most).select("node", "vector").toArrow()
    ids = asked.column(0).to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(unit_rows(asked.column(1), asked.num_rows))

    def counted(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                total += (unit_rows(part.column(0), part.num_rows) @ shared.value.T >= least).sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sums = nodes.select("vector").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    return {int(ids[r["at"]]): r["n"] - 1 for r in sums.collect()}  # without itself


def audited(true: dict[int, int], found: DataFrame) -> float:
    """The share of links found: the lesser of that of all sampled links and of the mean of the sampled nodes."""
    true = {node: n for node, n in true.items() if n > 0}
    if not true:
        return 1.0
    asked = found.sparkSession.createDataFrame([(node,) for node in true], "node bigint")  # a sampled node each
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node")))
    got = {r["node"]: r["count"] for r in ends.join(F.broadcast(asked), "node").groupBy("node").count().collect()}
    shares = [min(1.0, got.get(node, 0) / n) for node, n in true.items()]
    return min(sum(shares) / len(shares), sum(min(n, got.get(node, 0)) for node, n in true.items()) / sum(true.values()))


def links_once(nodes: DataFrame, least: float, round_: int) -> DataFrame:
    """The links that one choice of pivots finds."""
    spark = nodes.sparkSession
    total = nodes.count()
    # a bounded sample: at most SAMPLE rows reach the driver
    sample = nodes.orderBy(F.xxhash64("node", F.lit(round_))).limit(SAMPLE).select("vector").toArrow()
    empty = spark.createDataFrame([], "a bigint, b bigint, n_a bigint, n_b bigint")
    if not total:
        return empty
    pivots = apart(unit_rows(sample.column(0), sample.num_rows), max(1, min(SAMPLE, total // SHARD)))
    placed = stage(assigned(nodes, pivots), "shards")
    # one row for each pivot
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = placed.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("node", F.lit(round_)), F.col("blocks")))
    members = dealt.join(nodes, "node")

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("node").to_numpy()
        order = np.argsort(ids)
        lists = build(unit_rows(rows.column("vector"), len(ids))[order], key[0].as_py() + round_ * SAMPLE)
        ids = ids[order]
        return pa.table([pa.array(ids), pa.array([ids[x] for x in lists], pa.list_(pa.int64()))], names=["node", "near"])

    parts = members.select("shard", "block", "node", "vector").groupBy("shard", "block").applyInArrow(
        built, "node bigint, near array<bigint>")
    united = parts.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = stage(united.join(nodes, "node"), "graph")

    home = dealt.filter("rank = 0").select("node", "shard", "block", "blocks")
    inside = home.join(graph, "node")
    outside = (inside.select("shard", "block", "blocks", F.explode("near").alias("node")).distinct()
               .join(home.select("node", F.col("shard").alias("s"), F.col("block").alias("k")), "node")
               .filter("s <> shard or k <> block").drop("s", "k").join(graph, "node"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["shard", "i", "j", "role", "node", "n", "vector", "near"]
    held = [inside.withColumn("role", F.lit(1)), outside.withColumn("role", F.lit(2))]
    tasks = [f.withColumn("j", F.col("block")).withColumn("i", every).select(columns) for f in held]
    asked = (inside.withColumn("role", F.lit(0)).withColumn("i", F.col("block")).withColumn("j", every)
             .withColumn("near", F.lit(None).cast("array<bigint>")).select(columns))

    def searched(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("node", "ascending")])
        role = table.column("role").to_numpy()
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        rows = unit_rows(table.column("vector"), len(ids))
        q = int((role == 0).sum())
        place = {node: k for k, node in enumerate(ids[q:].tolist())}
        lists = [np.array([place[x] for x in near or () if x in place], np.int64) for near in table.column("near").to_pylist()[q:]]
        found = [[np.zeros(0, np.int64)] for _ in range(4)]
        if q < len(ids):
            graph_ = Graph(rows[q:], lists)
            own = rows[q:][role[q:] == 1]
            medoid = int(np.argmax(graph_.rows @ own.mean(0))) if len(own) else 0
            for k in range(q):
                me = place.get(ids[k])
                hits, cosines = graph_.within(rows[k], [medoid] if me is None else [medoid, me], least - 1e-6)
                other = q + hits[cosines >= least]
                other = other[ids[other] != ids[k]]
                low = ids[other] < ids[k]
                for column, mine, theirs in ((0, ids, ids), (2, n, n)):
                    found[column].append(np.where(low, theirs[other], mine[k]))
                    found[column + 1].append(np.where(low, mine[k], theirs[other]))
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=["a", "b", "n_a", "n_b"])

    rows = asked.unionByName(tasks[0]).unionByName(tasks[1])
    return rows.groupBy("shard", "i", "j").applyInArrow(
        searched, "a bigint, b bigint, n_a bigint, n_b bigint").distinct()


def near_duplicates(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows whose vec_id is null, or whose vector is null, empty, zero or holds a
    null or a number that is not finite, link with nothing: no links, themselves
    their component, kept.  Rows with equal vectors link with each other.
    Vectors of different lengths do not link.  Different vectors of one vec_id
    are one node of several places: each of its rows has the links of all.
    """
    vector = F.col("embedding")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the norm must be a number that the vector can be divided by
    able = F.col("vec_id").isNotNull() & usable(vector) & F.coalesce((length > 0) & (length < float("inf")), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"),
                             F.coalesce(able, F.lit(False)).alias("able"))
    nodes = stage(nodes_of(rows.filter("able")), "nodes")
    # one row for each vector length
    sizes = [r[0] for r in nodes.select(F.size("vector").alias("d")).distinct().collect()]
    found = None
    for d in sizes:
        part = links(nodes.filter(F.size("vector") == d), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "a bigint, b bigint, n_a bigint, n_b bigint")
    ends = found.select(F.col("a").alias("node"), F.col("n_b").alias("m")).unionByName(
        found.select(F.col("b").alias("node"), F.col("n_a").alias("m")))
    totals = ends.groupBy("node").agg(F.sum("m").alias("m"))
    known = (nodes.join(totals, "node", "left").join(components(found.select("a", "b")), "node", "left")
             .select("vector", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("component_id")))
    alone = rows.filter("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                           F.col("vec_id").alias("component_id"))
    linked = rows.filter("able").join(known, "vector").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(nodes: DataFrame, found: DataFrame, least: float = 0.9, every: int = 100) -> float:
    """Share of the true links of every ``every``-th node (by hash) that were found, by brute force.

    The audited nodes are a bounded sample, at most ``SAMPLE``.
    """
    asked = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).orderBy("node").limit(SAMPLE).select("node", "vector").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, rows = asked.column(0).to_numpy(), unit_rows(asked.column(1), asked.num_rows)

    def pairs(batches):
        for batch in batches:
            if batch.num_rows:
                near = unit_rows(batch.column(1), batch.num_rows) @ rows.T >= least
                i, j = np.nonzero(near)
                other = batch.column(0).to_numpy()[i]
                a, b = np.minimum(other, ids[j]), np.maximum(other, ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])

    true = nodes.select("node", "vector").mapInArrow(pairs, "a bigint, b bigint").distinct()
    counted = true.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return counted["hits"] / counted["n"] if counted["n"] else 1.0
