import numpy as np
from pyspark.sql import functions as F

from scansio.operators import models
from scansio.operators.metrics import exact_match


def planted(spark, n=400):
    """A word decides the first syllable."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "es").otherwise("en").alias("lang"),
        F.concat(F.when(F.col("id") % 2 == 0, "sol ").otherwise("mar "), F.lit("w"), F.col("id") % 17).alias("text"),
        F.when(F.col("id") % 2 == 0, "+-").otherwise("-+").alias("meter"))


def test_ngrams(spark):
    row = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string").select(models.word_ngrams("t")).collect()
    assert [r[0] for r in row] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_planted_word_is_learned_and_survives_saving(spark):
    df = planted(spark)
    model = models.fit_ova(df, "text", "meter", [1, 2], buckets=1 << 10)
    scores = models.ova_scores(model, df, "text", [1, 2])
    rows = scores.collect()
    assert len(rows) == 400 and all(0 <= s <= 1 for r in rows for s in r.scores)
    right = sum((r.scores[0] >= 0.5) == (r.meter[0] == "+") for r in rows) / 400
    assert right >= 0.95
    again = models.ova_scores(models.save_and_reload(model, spark), df, "text", [1, 2])
    refit = models.ova_scores(models.fit_ova(df, "text", "meter", [1, 2], buckets=1 << 10), df, "text", [1, 2])

    def table(x):
        return sorted((r.text, tuple(round(s, 6) for s in r.scores)) for r in x.collect())

    assert table(again) == table(scores) == table(refit)


def test_classifier_beats_the_majority(spark):
    model = models.fit_classifier(planted(spark), "text", "meter", buckets=1 << 10)
    got = models.classify(model, planted(spark), "text")
    assert got.agg(exact_match("label", "predicted")).first()[0] >= 0.95
    assert {(r.meter, r.label) for r in got.select("meter", "label").distinct().collect()} == {("+-", 0), ("-+", 1)}
    assert model.stages[-1].numClasses == 2
    later = models.classify(model, planted(spark, 4).withColumn("meter", F.lit("--")), "text").collect()
    assert all(r.label == 2 and r.predicted < 2 for r in later)


def test_sweep_prefers_the_better_run(spark):
    df = planted(spark)
    runs = models.sweep(df, df, "text", "meter", [1, 2], [{"max_iter": 0}, {"max_iter": 10}], buckets=1 << 10)
    assert runs.count() == 4
    assert all("10}" in r.parameters for r in models.sweep_best(runs).collect())


def _lengths():
    def predict(texts):
        return np.array([len(t) for t in texts], dtype=np.int64)
    return predict


def test_batch_score(spark):
    from pyspark.sql.types import LongType

    got = models.batch_score(planted(spark), ["text"], _lengths, "n", LongType(), batch_size=7)
    assert got.filter("n <> length(text)").count() == 0 and got.count() == 400


def test_ngrams_by_place(spark):
    """N-grams of odd texts, taken by place: no array is cut out for each of them."""
    texts = ["a b c d", "a", "", " a  b ", None, "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for n in (1, 2, 3):
        found = rows.select("i", models.word_ngrams("text", n).alias("t"))
        for r in found.collect():
            words = None if texts[r["i"]] is None else texts[r["i"]].split()
            assert r["t"] == (None if words is None else words + [" ".join(words[k:k + size]) for size in range(2, n + 1) for k in range(len(words) - size + 1)])
        assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
