"""The adapting head against plain numpy on the same episodes, and against centroids where those fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scansio.operators import adaptation, episodes
from scansio.operators.adaptation import Head, Pass


def episode_rows(n=12, ways=3, shots=2, queries=2, width=6, seed=4, noise=3.0):
    """Classes differ in two components; the others are common noise of far greater size."""
    draw = np.random.default_rng(seed)
    rows = []
    for e in range(n):
        for slot in range(ways):
            angle = 2 * np.pi * slot / ways
            for k in range(shots + queries):
                signal = [np.cos(angle), np.sin(angle)] + draw.normal(0, 0.1, 2)
                vector = [*signal, *draw.normal(0, noise, width - 2)]
                rows.append((e, "train", slot, e * 100 + slot * 10 + k, [float(x) for x in vector], "support" if k < shots else "query"))
    return rows


SCHEMA = "episode bigint, part string, slot int, row_key bigint, embedding array<double>, role string"


def numeric(f, at, step=1e-5):
    out = np.zeros_like(at)
    for i in range(len(at)):
        up, down = at.copy(), at.copy()
        up[i] += step
        down[i] -= step
        out[i] = (f(up) - f(down)) / (2 * step)
    return out


def sides(rows, e):
    mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[3]))
    return [(np.array([r[4] for r in mine if r[5] == role]), np.array([r[2] for r in mine if r[5] == role]))
            for role in ("support", "query")]


def test_gradient_goes_through_the_steps():
    """Against differences of the query loss, as a function of the shared start; first order differs from it."""
    support, query = sides(episode_rows(1, noise=0.5), 0)
    start = Head.new(6, 5, 3, seed=2)

    def loss(flat):
        head, _ = adaptation.adapted(start.like(flat), *support, 0.3, 3)
        return Pass(query[0], head, query[1]).loss

    want = numeric(loss, start.flat())
    got = adaptation.episode_gradient(start, support, query, 0.3, 3)[1].flat()
    first = adaptation.episode_gradient(start, support, query, 0.3, 3, second_order=False)[1].flat()
    assert np.allclose(got, want, atol=1e-6) and not np.allclose(first, want, atol=1e-3)
    plain = Pass(*support[:1], start, support[1])
    assert np.allclose(plain.gradient().flat(), numeric(lambda f: Pass(support[0], start.like(f), support[1]).loss, start.flat()), atol=1e-6)


@pytest.mark.parametrize("second_order", [True, False])
def test_iterations_equal_plain_numpy(spark, second_order):
    """The same start, losses and accuracies, iteration by iteration; the last one holds fewer episodes."""
    rows = episode_rows(10, noise=0.5)
    frame = spark.createDataFrame(rows, SCHEMA)
    options = dict(rate=0.2, steps=2, hidden=7, seed=3)
    head, curve = adaptation.meta_fit(frame, "embedding", 3, tasks_per_step=4, meta_rate=0.05, second_order=second_order, tasks=3, **options)
    start, adam, want = Head.new(6, 7, 3, seed=3), adaptation.Adam(0.05), []
    for it in range(3):
        found = [adaptation.episode_gradient(start, *sides(rows, e), 0.2, 2, second_order) for e in range(4 * it, min(10, 4 * it + 4))]
        want.append((it, len(found), np.mean([p.loss for p, _ in found]), np.mean([p.hits / len(p.labels) for p, _ in found])))
        start = start.like(adam.step(start.flat(), sum(g.flat() for _, g in found) / len(found)))
    got = [tuple(r) for r in curve.orderBy("iteration").collect()]
    assert np.allclose(got, want) and np.allclose(head.flat(), start.flat())
    scores = adaptation.adapted_scores(head, frame, "embedding", 0.2, 2).collect()
    assert len(scores) == 10 * 3 * 2
    for r in scores[:7]:
        support, query = sides(rows, r["episode"])
        mine = Pass(query[0], adaptation.adapted(start, *support, 0.2, 2)[0], query[1]).scores
        assert any(np.allclose(r["scores"], m) for m in mine[query[1] == r["slot"]])


def test_adaptation_beats_centroids(spark):
    """Components that say nothing drown the centroids; the head learns to leave them out."""
    rows = episode_rows(480, shots=1, queries=2, noise=4.0, seed=9)
    frame = spark.createDataFrame(rows, SCHEMA)
    late = frame.filter("episode >= 400")
    head, curve = adaptation.meta_fit(frame.filter("episode < 400"), "embedding", 3, tasks_per_step=16, rate=0.3, steps=3,
                                      meta_rate=0.03, hidden=24)
    accuracy = lambda scores: scores.agg(F.avg((F.col("predicted") == F.col("slot")).cast("double"))).first()[0]
    learned = accuracy(adaptation.adapted_scores(head, late, "embedding", 0.3, 3))
    centroid = accuracy(episodes.centroid_scores(late, "embedding", 3))
    before = curve.orderBy("iteration").first()["accuracy"]
    assert learned > 0.9 and learned > centroid + 0.3 and learned > before + 0.3, (learned, centroid, before)


def test_odd_episodes(spark):
    frame = spark.createDataFrame(episode_rows(2), SCHEMA)
    head, curve = adaptation.meta_fit(frame.limit(0), "embedding", 3, hidden=4)
    assert curve.count() == 0
    head, curve = adaptation.meta_fit(frame, "embedding", 3, iterations=5, hidden=4)
    assert [r["episodes"] for r in curve.collect()] == [2]
    assert adaptation.adapted_scores(head, frame.limit(0), "embedding").count() == 0


def test_a_step_reads_whole_episodes_where_they_lie(spark):
    """An episode is one stored row, only iterations that are taken are stored, and a step has no exchange."""
    rows = spark.range(24).selectExpr(
        "cast(id div 4 as bigint) as episode", "'a' as part", "cast(id % 2 as int) as slot", "if(id % 4 < 2, 'support', 'query') as role",
        "id as row_key", "array(cast(id as float), 1f) as embedding")
    table, found = adaptation.episode_table(rows, "embedding", 2, 2)
    assert found == [0, 1] and table.count() == 4
    assert "Exchange" not in table.filter("iteration = 1").coalesce(3)._jdf.queryExecution().executedPlan().toString()
    one = table.filter("episode = 1").first()
    assert (one.asked, one.slots, one["keys"]) == ([False, False, True, True], [0, 1, 0, 1], [4, 5, 6, 7])
    assert one.vectors == [4.0, 1.0, 5.0, 1.0, 6.0, 1.0, 7.0, 1.0]
