"""Hard negatives against a plain search over all pairs."""

import numpy as np
import pytest

from scansio.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, low int"


def brute(rows, every=100, positives=5, k=5, low=80, high=100, scale=256):
    """Every (anchor, positive, rank, negative, scores), row by row; equal rows count once."""
    able = {(i, label, tuple(v)) for i, label, v, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, label, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v]) for i, label, v in able]
    out = []
    for a in (w for w in whole if w[0] % every == 0):
        near = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] != a[1])
                      for b in whole if b is not a and len(b[2]) == len(a[2]))
        for score, positive, _ in [n for n in near if not n[2]][:positives]:
            hard = [n for n in near if n[2] and low * -score <= 100 * -n[0] <= high * -score][:k]
            out += [(a[0], positive, r, n[1], -score, -n[0]) for r, n in enumerate(hard, 1)]
    return sorted(out)


def got(frame, **options):
    found = negatives.mine(frame, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def drawn(n, labels, d=6, seed=3, like=None):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=d) if like is None else like
    return [(i, int(draw.integers(labels)), (base + draw.normal(scale=0.5, size=d)).astype(np.float32).tolist(), "x", 1) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"every": 7, "positives": 3, "k": 2}, {"low": 95}, {"high": 90, "scale": 16}, {"scale": 1}])
def test_windows_equal_brute_force(spark, monkeypatch, options):
    """Small tiles, so lists of several shards and blocks are merged; a coarse scale brings ties."""
    monkeypatch.setattr(negatives, "SHARD_ROWS", 16)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 2)
    rows = drawn(330, 4)
    assert got(spark.createDataFrame(rows, SCHEMA), **options) == brute(rows, **options) != []


def test_one_label_holds_most_rows_and_many_vectors_are_equal(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 32)
    rows = [(i, 0 if i % 3 else 1, [1.0, 2.0, 1.0 + (i % 5 == 0)], "x", 1) for i in range(240)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0], "a", 1), (0, 1, [1.0, 0.0], "b", 2), (1, 1, [0.9, 0.1], "a", 1), (2, 2, [0.85, 0.2], None, 1),
            (3, 2, [0.8, nan], "a", 1), (4, 2, [0.8, None], "a", 1), (5, None, [0.9, 0.0], "a", 1), (6, 2, None, "a", 1),
            (None, 2, [0.9, 0.0], "a", 1), (7, 2, [inf, 0.0], "a", 1), (8, 2, [0.9, 0.0, 0.0], "a", 1), (9, 2, [], "a", 1),
            (100, 3, [-1.0, 0.0], "a", 1), (101, 3, [1.0, 0.0], "a", 1), (102, 1, [-0.9, 0.0], "a", 1), (200, 9, [1.0, 1.0], "a", 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).limit(0)) == []


def test_rows_of_one_id_that_differ_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0], "a", 1), (0, 1, [0.99, 0.0], "a", 1), (3, 2, [0.95, 0.0], "a", 1), (3, 2, [0.9, 0.0], "a", 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_suffixes_are_merged_from_the_lowest_slot():
    assert negatives.first(np.array([1, 5, 5, 3]), 2).tolist() == [1, 2]
    assert negatives.first(np.array([2, 2, 2, 9]), 3).tolist() == [3, 0, 1]
