"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scansio.llm import lexical

# Fixed value: the pattern that the operator's terms are defined by.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c, length in held:
            m = 100 - 75 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k=10):
    frame = lexical.rank(spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "doc_id AS score", "text AS terms"),
                         spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS rank"), k)
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def prose(seed, n, words=120, length=60):
    draw = random.Random(seed)
    known = [f"w{i}" for i in range(words)]
    return [" ".join(draw.choices(known, [1 / (i + 1) for i in range(words)], k=draw.randint(1, length))) for _ in range(n)]


def test_terms():
    for text in ["Don't STOP_it: Éa éA 中文-x 9a\x7fb c", "", None, "\x00\x1c", "ÀB c"]:
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.mark.parametrize("cluster, block, shard", [(48, 32, 48 << 20), (3, 2, 1), (1, 1, 1)])
def test_ranks_equal_brute_force(spark, monkeypatch, cluster, block, shard):
    """Also with shards of 256 documents and tiny clusters and blocks, so that bounds leave blocks out."""
    for name, value in (("CLUSTER", cluster), ("BLOCK", block), ("SHARD_BYTES", shard)):
        monkeypatch.setattr(lexical, name, value)
    docs = list(enumerate(prose(1, 700)))
    items = list(enumerate(prose(2, 9, length=12)))
    want = brute(docs, items)
    assert got(spark, docs, items) == want and len(want) == 90


def test_bounds_leave_documents_out():
    """A shard scores few documents once the best are known, and the bound of a block is never below a score."""
    items = lexical.Items.of([(0, "a b c")])
    draw = np.random.default_rng(5)
    matrix = np.zeros((600, 3))
    matrix[:, 0] = 1
    matrix[:20] += draw.integers(50, 90, (20, 3))
    part = lexical.Shard(matrix, items.beside())
    for t in range(3):
        for low, high, top in zip(part.edges[t], part.edges[t][1:], part.summaries[t]):
            assert (matrix[part.members[t][low:high]].max(0)[items.beside()[t]] == top).all()
    best = lexical.Best(10)
    best.ids = (np.arange(600), np.zeros(600, bool))
    assert part.search(items.terms[0], items.times[0], best) < 300
    order = np.lexsort((np.arange(600), -matrix.sum(1)))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == matrix.sum(1)[order].tolist()


def test_items_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GROUP_BYTES", 64)
    docs, items = list(enumerate(prose(3, 80))), list(enumerate(prose(4, 12, length=8)))
    assert got(spark, docs, items, 3) == brute(docs, items, 3) != []


def test_odd_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "!?"), (5, "a " * 50000), (6, "b é"), (None, "zz"), (7, "b é")]
    items = [(1, "a a b"), (1, "a a b"), (1, "é"), (2, None), (3, ""), (None, "zz"), (4, "nowhere")]
    assert got(spark, docs, items) == brute(docs, items) != []
    assert got(spark, docs[:0], items) == [] == got(spark, docs, items[:0])
    assert got(spark, [(1, None)], items) == []
