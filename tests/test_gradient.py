"""Fits on a table of parameters against plain numpy on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scansio.operators import gradient
from scansio.plans import baseline


def lines(spark, n=300, extra=()):
    """Two planted words say where the stresses are; the rest is noise."""
    word = lambda k, m: F.concat(F.lit("w"), F.pmod(F.xxhash64("i", F.lit(k)), F.lit(m)))
    rows = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "es").otherwise("en").alias("lang"),
                                 F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "sol").otherwise("mar"), word(1, 40), word(2, 40),
                                             F.when(F.col("id") % 5 < 2, "luz").otherwise("pan")).alias("text"),
                                 F.concat(F.when(F.col("id") % 2 == 0, "+").otherwise("-"), F.when(F.col("id") % 5 < 2, "+").otherwise("-")).alias("meter"))
    rows = rows.withColumn("id", F.col("i"))
    return rows.unionByName(spark.createDataFrame(list(extra), rows.schema)) if extra else rows


def plain(model, features, given=None):
    """The same fit without Spark: all parameters in one matrix, all rows at once."""
    rows = features.rows.orderBy("id").toPandas()
    f, sizes = np.concatenate(rows["features"].to_numpy()), np.concatenate(rows["sizes"].to_numpy())
    keys, place = np.unique(f, return_inverse=True)
    starts = np.cumsum([0, *map(len, rows["features"])])[:-1]
    y = np.array(rows["labels"].tolist(), float)
    w = model.first(keys, [(given or {}).get(k) for k in keys.tolist()])
    s, labels = np.zeros_like(w), model.shared()
    ls, loss = None if labels is None else labels * 0, 0
    for it in range(model.iterations):
        loss, back, by_labels = model.backward(w[place], labels, sizes, starts, y)
        g = np.zeros_like(w)
        np.add.at(g, place, back)
        g, rate = model.step(w, g / len(y), it)
        s += g * g
        w = w - rate * g / (np.sqrt(s) + model.damping)
        if labels is not None:
            by_labels = by_labels / len(y)
            ls = ls + by_labels ** 2
            labels = labels - model.rate * by_labels / (np.sqrt(ls) + 1e-12)
    return dict(zip(keys.tolist(), w)), labels, loss / len(y), model.forward(w[place], labels, sizes, starts)


MODELS = [gradient.Linear([1, 2], [{"n": 1}, {"max_iter": 2, "reg": 0.1}, {"rate": 0.1}], max_iter=3), gradient.LowRank([1, 2], 5, 0.5, 3)]


@pytest.mark.parametrize("model", MODELS, ids=["linear", "low rank"])
@pytest.mark.parametrize("part_rows", [1 << 14, 40])
def test_fit_equals_plain_numpy(spark, monkeypatch, model, part_rows):
    """Parameters, loss and scores, with one part and with many, and with several shards."""
    monkeypatch.setattr(gradient, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(gradient, "STRIP_ROWS", 16)
    features = gradient.featurise(lines(spark, 200), "text", "meter", [1, 2], 3, 50, part_rows)
    state = gradient.fit(features, model)
    want, labels, loss, probabilities = plain(model, features)
    got = {r["feature"]: r["w"] for r in state.collect()}
    assert set(want) == {k for k in got if k > gradient.LOSS}
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert labels is None or np.allclose(got[gradient.LABELS], labels)
    assert np.isclose(gradient.loss(state), loss)
    scored = gradient.scores(state, features, model).orderBy("id").collect()
    assert np.allclose([r["scores"] for r in scored], probabilities)
    if part_rows == 40 and isinstance(model, gradient.Linear):
        assert {r["feature"]: r["w"] for r in gradient.fit(features, model).collect()} == got


def test_choices_do_not_meet(spark):
    """Each choice of a sweep is what it would be alone."""
    features = gradient.featurise(lines(spark, 120), "text", "meter", [1, 2], 2, 50, 40)
    grid = [{"n": 1, "max_iter": 2}, {"max_iter": 1}, {"max_iter": 0}]
    both = {r["feature"]: r["w"] for r in gradient.fit(features, gradient.Linear([1, 2], grid)).collect()}
    for i, choice in enumerate(grid):
        one = {r["feature"]: r["w"] for r in gradient.fit(features, gradient.Linear([1, 2], [choice])).collect()}
        assert all(np.allclose(both[k][2 * i:2 * i + 2], one[k]) for k in one if k != gradient.LOSS)


def test_scans_do_not_grow_with_positions(spark):
    """As many jobs for one position as for two, and for three choices as for one."""
    def jobs(model):
        spark.sparkContext.setJobGroup(f"fit {id(model)}", "fit")
        gradient.fit(features, model)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {id(model)}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    features = gradient.featurise(lines(spark, 60), "text", "meter", [1, 2], 2, 50)
    assert jobs(gradient.Linear([1, 2], [{}], max_iter=1)) == jobs(gradient.Linear([1, 2], [{}, {"n": 1}, {"reg": 1.0}], max_iter=1))


def test_word_vectors_are_the_start(spark):
    """Without steps a word has its given vector, also one that no training row had; with steps it moves."""
    rows = lines(spark, 60)
    vectors = spark.createDataFrame([("sol", [1.0, 2.0, 3.0]), ("mar", [0.5, 0.0, 0.0]), ("nueva", [9.0, 0.0, 0.0])], "word string, vector array<float>")
    features = gradient.featurise(rows, "text", "meter", [1, 2], 2, 50)
    ids = {r["word"]: r["f"] for r in vectors.select("word", gradient.word_feature("word").alias("f")).collect()}
    still = {r["feature"]: r["w"] for r in gradient.fit(features, gradient.LowRank([1, 2], 3, max_iter=0), vectors).collect()}
    assert still[ids["sol"]] == [1, 2, 3] and ids["nueva"] not in still
    model = gradient.LowRank([1, 2], 3, 0.5, 3)
    state = gradient.fit(features, model, vectors)
    assert {r["feature"]: r["w"] for r in state.collect()}[ids["sol"]] != [1, 2, 3]
    asked = gradient.featurise(spark.createDataFrame([(0, "nueva", "+"), (1, "sol", "+")], "id bigint, text string, meter string"), "text", "meter", [1, 2], 2, 50)
    by = lambda v: {r["id"]: r["scores"] for r in gradient.scores(state, asked, model, v).collect()}
    assert by(vectors)[0] != by(None)[0] and by(vectors)[1] == by(None)[1]
    with pytest.raises(Exception, match="3 numbers"):
        gradient.fit(features, gradient.LowRank([1, 2], 4, max_iter=0), vectors).collect()


def test_planted_words_are_learned(spark):
    rows = lines(spark, 600).withColumn("split", F.when(F.col("i") % 4 == 0, "test").otherwise("train")).drop("id")
    vectors = spark.createDataFrame([("pan", [0.1] * 16)], "word string, vector array<float>")
    report = baseline.ngram_report(baseline.ngram_predictions(rows, [1, 2], vectors, dim=16, buckets=1000, max_iter=15, rate=1.0)).collect()
    assert {r["lang"]: r["samples"] for r in report} == {"es": 50, "en": 100}
    assert all(min(r["precision"], r["recall"], r["accuracy"]) >= 0.95 for r in report)


def test_odd_rows(spark):
    """Null and empty texts and patterns, a very long text, repeated rows, no rows."""
    rows = spark.createDataFrame([(0, None, "+-"), (1, "", None), (2, "sol " * 20000, "-+"), (3, "sol", ""), (4, "sol", "+"), (5, "sol", "+")],
                                 "id bigint, text string, meter string")
    for model in (gradient.Linear([1, 2], max_iter=2), gradient.LowRank([1, 2], 4, max_iter=2)):
        features = gradient.featurise(rows, "text", "meter", [1, 2], 2, 50)
        scored = {r["id"]: r["scores"] for r in gradient.scores(gradient.fit(features, model), features, model).collect()}
        assert len(scored) == 6 and scored[4] == scored[5] and all(0 <= s <= 1 for x in scored.values() for s in x)
        nothing = gradient.featurise(rows.limit(0), "text", "meter", [1, 2], 2, 50)
        empty = gradient.fit(nothing, model)
        assert gradient.scores(empty, nothing, model).count() == 0
        unknown = gradient.scores(empty, features, model).collect()
        assert len(unknown) == 6 and all(r["scores"] == [0.5, 0.5] for r in unknown)


def test_sent_numbers_follow_labels(spark, monkeypatch):
    """What parts get and send does not grow with the width of vectors, and no rows or shuffle files of a fit are left."""
    import os
    monkeypatch.setattr(gradient, "LEAST_ROWS", 40)
    features = gradient.featurise(lines(spark, 200), "text", "meter", [1, 2], 2, 50)
    for model in (gradient.LowRank([1, 2], 64, 0.5, 2), gradient.Linear([1, 2], [{"max_iter": 2}, {"max_iter": 1}, {"max_iter": 0}])):
        labels = model.shared()
        state = gradient.initial(features, model, None)
        sent = gradient.narrowed(state, model, labels, 1).selectExpr("max(octet_length(z))").first()[0]
        back = gradient.gradients(state, features, model, labels, 0).selectExpr("max(octet_length(g))").first()[0]
        assert sent <= 8 * 6 and back <= 8 * 4
    plan = gradient.gradients(gradient.fit(features, model).withColumn("places", F.array().cast("array<struct<part:bigint,at:int>>")),
                              features, model, None, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the parts' rows stay where they are
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = lines(spark, 60).withColumn("split", F.when(F.col("i") % 4 == 0, "test").otherwise("train")).drop("id")
    assert baseline.ngram_predictions(rows, [1, 2], dim=4, buckets=50, max_iter=1).count() == 15
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["predictions"]


def test_vectors_are_moved_as_bytes(spark, monkeypatch):
    """Vectors lie in an iteration's tables as bytes, and a step returns every feature once, with all its numbers."""
    monkeypatch.setattr(gradient, "LEAST_ROWS", 40)
    features = gradient.featurise(lines(spark, 120), "text", "meter", [1, 2], 2, 50)
    model = gradient.LowRank([1, 2], 8, 0.5, 2)
    state = gradient.initial(features, model, None)
    assert {state.schema[c].dataType.simpleString() for c in ("w", "s")} == {"binary"}
    names = gradient.spread_numbers(spark, 2)
    sums = gradient.gradients(state, features, model, model.shared(), 0)
    after = gradient.stepped(state.withColumn("shard", gradient.dealt("feature", names)), sums, model, model.shared(), 0, 120, names)
    rows = after.filter(F.col("feature") > gradient.LOSS).select("feature", F.octet_length("w").alias("n")).collect()
    assert {r["n"] for r in rows} == {64} and len(rows) == len({r["feature"] for r in rows}) == features.needs.select("feature").distinct().count()


def test_parts_and_shards_exchange_packed_messages(spark, monkeypatch):
    """An iteration moves a row for each part and shard, not for each feature, and its sums and steps are those feature by feature."""
    monkeypatch.setattr(gradient, "LEAST_ROWS", 60)
    monkeypatch.setattr(gradient, "STRIP_ROWS", 16)
    monkeypatch.setattr(gradient, "SUMMED", 64)
    features = gradient.featurise(lines(spark, 180), "text", "meter", [1, 2], 2, 50)
    names = gradient.spread_numbers(spark, 2)
    for model in (gradient.LowRank([1, 2], 8, 0.5, 2), gradient.Linear([1, 2], [{"n": 1}, {"max_iter": 1}], max_iter=2)):
        labels = None if model.shared() is None else np.arange(16) / 16
        state = gradient.initial(features, model, None).withColumn("shard", gradient.dealt("feature", names))
        rows = state.filter(F.col("feature") > gradient.LOSS).groupBy("shard")
        blocks = rows.applyInArrow(lambda x: gradient.blocks_of(x, 10), gradient.BLOCKS)
        routes = rows.applyInArrow(gradient.routes_of, gradient.ROUTES)
        asked = gradient.messages(blocks, routes, model, labels, 1)
        assert asked.count() <= features.parts * 2 < features.needs.count() / 4
        found = gradient.replies(asked, features, model, labels, 1, names)
        assert found.count() <= features.parts * 3
        after = gradient.moved(blocks, found, model, labels, 1, 180, 2).collect()
        want = gradient.stepped(state, gradient.gradients(state, features, model, labels, 1), model, labels, 1, 180, names).collect()
        got = {k: (w, s) for r in after if r["block"] >= 0 for k, w, s in zip(
            np.frombuffer(r["keys"], np.int64).tolist(), *(np.frombuffer(r[c]).reshape(-1, model.width) for c in ("w", "s")))}
        by = {r["feature"]: r for r in want if r["feature"] > gradient.LOSS}
        assert set(got) == set(by) and all(np.allclose(got[k][0], np.frombuffer(by[k]["w"])) and np.allclose(got[k][1], np.frombuffer(by[k]["s"])) for k in by)
        lost = [np.frombuffer(r["w"])[0] for r in want if r["feature"] == gradient.LOSS]
        assert np.isclose(sum(np.frombuffer(r["extra"])[0] for r in after if r["block"] < 0), lost[0])


def test_terms_have_the_features_and_sizes_of_their_words(spark):
    """Words, then pairs, then triples, by place; sizes follow from the number of terms."""
    rows = spark.createDataFrame([(0, "a b  c"), (1, ""), (2, None), (3, "a")], "id bigint, text string")
    grams = lambda *g: [F.xxhash64(F.lit(x)) for x in g]
    own = lambda *g: [F.shiftrightunsigned(x, 1) for x in grams(*g)]
    shared = lambda *g: [-1 - F.pmod(x, F.lit(50)) for x in grams(*g)]
    want = rows.filter("id = 0").select(F.array(*own("a", "b", "c", "</s>"), *shared("a b", "b c", "c </s>", "a b c", "b c </s>"))).first()[0]
    found = {r["id"]: r["f"] for r in rows.select("id", gradient.term_features(F.col("text"), 3, 50).alias("f")).collect()}
    assert found[0] == want and len(found[1]) == len(found[2]) == 1 and len(found[3]) == 3
    assert gradient.sizes_of(np.array([9, 1, 3]), 3).tolist() == [1, 1, 1, 1, 2, 2, 2, 3, 3, 1, 1, 1, 2]
