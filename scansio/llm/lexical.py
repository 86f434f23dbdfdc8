"""Ranked lexical search over per-term posting lists in geometric blocks.

One pass over the texts keeps, of each document, its length and the counts of
the words that some item asks for; from it come the corpus statistics, and then
the impacts: whole numbers that a document's score is the sum of.

A task takes documents in shards of bounded memory.  In a shard

1. the documents are clustered by the similarity of their impact vectors;
2. each word's posting list is cut into blocks of similar documents: a cluster
   or a part of one, in short lists a few clusters;
3. each block keeps a summary: for every word that an item has beside the
   block's word, the greatest impact of any of its documents.

An item's inner product with a summary bounds the score of every document of
the block, exactly.  Blocks are visited in falling order of that bound, and left
out only when the bound is below the item's k-th best score so far; the
documents of the others are scored in full.  The best k of an item go on from
shard to shard in a task, so later shards leave out more, and the lists of all
tasks are merged at the end.  No text and no posting is shuffled.

Words of the items are held by every task, so items are searched in groups of
bounded size, however many there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.llm.common import slices
from scansio.session import stage

#: Bytes of item texts searched in one pass over the documents.
GROUP_BYTES = 4 << 20
#: Bytes of a shard's matrix of impacts.
SHARD_BYTES = 48 << 20
#: Documents of a shard for one cluster, and of a block at most.
CLUSTER, BLOCK = 48, 32
#: Documents of a list for each cluster, below which a block may hold several clusters that follow each other.
LEAST = 8
#: Rows gathered at once for summaries.
STRIP_BYTES = 16 << 20
#: Blocks whose documents are scored in one step.
STEP = 64
# Every ASCII character that is no letter or digit parts terms, only A-Z are lower-cased.
TERMS = bytes(c + 32 if chr(c).isupper() else c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split()


@dataclass
class Items:
    """A group of items: for each its number, terms (as numbers) and how often it has them."""

    numbers: list[int]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    known: dict[bytes, int]

    @classmethod
    def of(cls, rows: Iterable[tuple[int, str | None]]) -> Items:
        known: dict[bytes, int] = {}
        items = cls([], [], [], known)
        for number, text in rows:
            counts = Counter(terms_of(text))
            if counts:
                items.numbers.append(number)
                items.terms.append(np.array([known.setdefault(t, len(known)) for t in counts]))
                items.times.append(np.array(list(counts.values()), np.float64))
        return items

    def beside(self) -> list[np.ndarray]:
        """For each term the terms that some item has beside it, itself included, in order."""
        found: list[list[np.ndarray]] = [[] for _ in self.known]
        for terms in self.terms:
            for t in terms.tolist():
                found[t].append(terms)
        return [np.unique(np.concatenate(x)) for x in found]


def counted(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, n, terms, counts`` of documents with at least one term: all its terms, and the items' terms in it."""
    known = items.known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            ids, n, terms, counts = [], [], [], []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                all_ = terms_of(text)
                if all_:
                    found = Counter(all_)
                    asked = known.keys() & found.keys()
                    ids.append(doc)
                    n.append(len(all_))
                    terms.append([known[t] for t in asked])
                    counts.append([found[t] for t in asked])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def weights(n_docs: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def impacts(n: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each count adds to a score for each time an item has its term; one row of ``n`` for each count."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms if int(n.max(initial=0)) * 75 * n_docs < 1 << 62 else np.array(
        [100 - 75 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return weight[terms] * ((1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + 8 * m))


# a shard

def clusters(rows: np.ndarray, seed: int = 7) -> np.ndarray:
    """The cluster of each row: the nearest of a few rows by cosine, after their members' mean took their place."""
    n = len(rows)
    k = max(1, n // CLUSTER)
    flat = rows.astype(np.float32)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)
    centres = flat[np.random.default_rng(seed).choice(n, k, replace=False)]
    nearest = np.argmax(flat @ centres.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    means = np.add.reduceat(flat[order], np.flatnonzero(np.diff(nearest[order], prepend=-1)), axis=0)
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-30)
    return np.argmax(flat @ means.T, axis=1)


class Shard:
    """Impacts of some documents, and for each term its posting list in blocks with their summaries."""

    def __init__(self, matrix: np.ndarray, beside: list[np.ndarray]):
        self.matrix = matrix
        cluster = clusters(matrix)
        order = np.argsort(cluster, kind="stable")
        group, parts = cluster[order], int(cluster.max(initial=0)) + 1
        self.beside = beside
        self.members: list[np.ndarray] = []
        self.edges: list[np.ndarray] = []
        self.summaries: list[np.ndarray] = []
        term, place = np.nonzero(matrix[order].T)
        lists = np.split(place, np.searchsorted(term, np.arange(1, matrix.shape[1])))
        for t, at in enumerate(lists):
            members, own = order[at], group[at]
            start = np.zeros(len(at), np.int64)  # of the run that a block may not leave
            if len(at) >= LEAST * parts:
                new = np.flatnonzero(np.diff(own, prepend=-1))
                start = np.repeat(new, np.diff(np.append(new, len(at))))
            edges = np.flatnonzero((np.arange(len(at)) - start) % BLOCK == 0)
            self.members.append(members)
            self.edges.append(np.append(edges, len(at)))
            self.summaries.append(self.summary(members, edges, beside[t]))

    def summary(self, members: np.ndarray, edges: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The greatest impact in each block, for each of the columns."""
        out = np.zeros((len(edges), len(columns)))
        strip = max(BLOCK, STRIP_BYTES // (8 * max(1, len(columns))))
        low = 0
        while low < len(edges):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + strip, "right")) - 1)
            start, end = edges[low], edges[high] if high < len(edges) else len(members)
            part = self.matrix[np.ix_(members[start:end], columns)]
            out[low:high] = np.maximum.reduceat(part, edges[low:high] - start, axis=0)
            low = high
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Bring ``best`` up to date with this shard; returns how many documents were scored."""
        bounds, blocks = [], []
        for t in terms.tolist():
            if len(self.summaries[t]):
                bounds.append(self.summaries[t][:, np.searchsorted(self.beside[t], terms)] @ times)
                blocks.append(np.stack([np.full(len(bounds[-1]), t), np.arange(len(bounds[-1]))], axis=1))
        if not bounds:
            return 0
        bound, block = np.concatenate(bounds), np.concatenate(blocks)
        falling = np.argsort(-bound, kind="stable")
        bound, block = bound[falling], block[falling].tolist()
        unseen = np.ones(len(self.matrix), bool)
        scored, at, step = 0, 0, 4
        while at < len(block):
            live = min(at + step, int(np.searchsorted(-bound, -best.least, "right")))
            if live <= at:
                break  # this bound is below the k-th best score, and so are all that follow
            docs = np.unique(np.concatenate([self.members[t][self.edges[t][b]:self.edges[t][b + 1]] for t, b in block[at:live]]))
            docs = docs[unseen[docs]]
            unseen[docs] = False
            if len(docs):
                scored += len(docs)
                best.add(docs, self.matrix[np.ix_(docs, terms)] @ times)
            at, step = live, min(2 * step, STEP)
        return scored


class Best:
    """The k best documents of an item so far: score, then smaller id, ids that are null last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.id = np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)
        self.ids: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def least(self) -> float:
        """What a bound must reach: the k-th score, or the least score above 0."""
        return max(1.0, self.score[-1]) if len(self.score) == self.k else 1.0

    def add(self, docs: np.ndarray, score: np.ndarray) -> None:
        able = score >= self.least
        ids, none = self.ids
        score = np.concatenate([self.score, score[able]])
        none = np.concatenate([self.none, none[docs[able]]])
        id_ = np.concatenate([self.id, ids[docs[able]]])
        order = np.lexsort((id_, none, -score))[:self.k]
        self.score, self.none, self.id = score[order], none[order], id_[order]


def searched(index: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``number, doc_id, score``: the best k of each item in each task."""
    width = max(1, len(items.known))
    rows_of = max(256, SHARD_BYTES // (8 * width))
    beside = items.beside()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.numbers]
        held: list[pa.RecordBatch] = []

        def shard() -> None:
            table = pa.Table.from_batches(held)
            terms = table.column("terms").combine_chunks()
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(table.num_rows), sizes)
            number = terms.flatten().to_numpy()
            counts = table.column("counts").combine_chunks().flatten().to_numpy()
            matrix = np.zeros((table.num_rows, width))
            matrix[doc, number] = impacts(table.column("n").to_numpy()[doc], number, counts, weight, n_docs, n_terms)
            ids = table.column("doc_id").combine_chunks()
            there = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
            part = Shard(matrix, beside)
            for t, n, b in zip(items.terms, items.times, best):
                b.ids = there
                part.search(t, n, b)

        n = 0
        for rows in slices(batches, min(rows_of, 1024)):
            if n + rows.num_rows > rows_of:
                shard()
                held, n = [], 0
            held.append(rows)
            n += rows.num_rows
        if n:
            shard()
        kept = [(number, int(s), None if none else int(i)) for number, b in zip(items.numbers, best)
                for s, none, i in zip(b.score, b.none, b.id)]
        if kept:
            number, score, doc = zip(*kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                ["number", "doc_id", "score"])

    return index.mapInArrow(run, "number bigint, doc_id bigint, score bigint")


def grouped(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in groups of about ``GROUP_BYTES``, each gathered by itself."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-size // GROUP_BYTES))
    for g in range(groups):
        yield [(r["number"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == g).collect()]


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item (all, if fewer).

    ``docs`` holds ``doc_id, text`` and ``items`` ``item_id, text``; further
    columns are not read.  Terms, weights and scores are those of the module's
    constants: an item's term counts as often as it stands there.  Equal scores
    go by ascending doc_id, null ids last; ranks are unique.

    A null or empty text has no terms: such a document is not counted, such an
    item has no row.  Repeated documents are documents of their own.  Repeated
    items count once; items of one id with different texts are ranked each by
    itself.  Empty tables give an empty one.
    """
    spark = docs.sparkSession
    # a number for each item: the hash of its row, so any number of items can be searched in groups
    asked = stage(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
                  .withColumn("number", F.xxhash64("item_id", "text")), "items")
    found = spark.createDataFrame([], "number bigint, doc_id bigint, score bigint")
    for rows in grouped(asked):
        group = Items.of(rows)
        if not group.numbers:
            continue
        index = stage(counted(docs, group), "counts")
        totals = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not totals["docs"]:
            continue
        # one row for each term of the group, at most GROUP_BYTES of text
        holding = np.zeros(len(group.known), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[r["t"]] = r["count"]
        lists = searched(index.filter(F.size("terms") > 0), group, weights(totals["docs"], holding),
                         totals["docs"], totals["terms"], k)
        found = found.unionByName(stage(best_of(lists, k), "ranked"))
    hit = F.posexplode("hits").alias("place", "hit")
    return (found.groupBy("number").agg(hits(k)).select("number", hit)
            .join(asked.select("number", "item_id"), "number")
            .select("item_id", (F.col("place") + 1).alias("rank"), F.col("hit.doc_id").alias("doc_id"),
                    (-F.col("hit.low")).alias("score")))


def hits(k: int):
    one = F.struct((-F.col("score")).alias("low"), F.col("doc_id").isNull().alias("none"), "doc_id")
    return F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("hits")


def best_of(lists: DataFrame, k: int, parts: int = 64) -> DataFrame:
    """The best k of each item among the lists of up to ``parts`` groups of tasks: what one task then merges."""
    grouped_ = lists.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    return grouped_.groupBy("number", "part").agg(hits(k)).select("number", F.explode("hits").alias("hit")).select(
        "number", F.col("hit.doc_id").alias("doc_id"), (-F.col("hit.low")).alias("score"))


RANK_SQL = r"""WITH words AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
    held AS (SELECT doc_id, r, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
    totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM held),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weighed AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
    impacts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt))) AS i
        FROM postings JOIN weighed USING (term), totals),
    scored AS (SELECT item_id, r, doc_id, sum(times * i)::BIGINT AS score FROM asked JOIN impacts USING (term)
        GROUP BY item_id, r, doc_id)
    SELECT item_id, rank, doc_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    WHERE rank <= 10"""
