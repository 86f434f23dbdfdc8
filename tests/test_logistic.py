import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from scansio.checks import QUERIES
from scansio.operators import logistic, models
from tests.plans import plan_text

BUCKETS = 1 << 6


def lines(spark, n=300):
    """Words decide some syllables, not all; words repeat in a line, and a line may have none."""
    word = F.concat(F.lit("w"), F.pmod(F.hash("id"), F.lit(9)).cast("string"))
    noise = F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string"))
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "").otherwise(F.concat_ws(" ", word, noise, word)).alias("text"),
        F.concat(F.when(F.pmod(F.hash("id"), F.lit(9)) < 4, "+").otherwise("-"),
                 F.when(F.pmod(F.hash(F.col("id") + 1), F.lit(3)) == 0, "+").otherwise("-"), F.lit("+")).alias("meter"))


def test_weights_are_those_of_separate_fits(spark, monkeypatch):
    """At its least point each regression is the one that Spark ML fits alone, in blocks and groups of any size."""
    df = lines(spark).coalesce(2).cache()
    rows = HashingTF(inputCol="terms", outputCol="features", numFeatures=BUCKETS).transform(
        models.ova_frame(df, "text", "meter", [1, 2], n=2)).cache()
    alone = [LogisticRegression(labelCol=f"pos{p}", maxIter=100, regParam=0.1, tol=1e-10, standardization=False).fit(rows) for p in (1, 2)]
    for at_once, terms in ((1 << 22, 1 << 16), (BUCKETS, 40)):
        monkeypatch.setattr(logistic, "FITTED", at_once)
        monkeypatch.setattr(logistic, "BLOCK_TERMS", terms)
        model = models.fit_positions(models.ova_features(df, "text", "meter", [1, 2], BUCKETS, 2), [1, 2], BUCKETS, 40, 0.1)
        for found, asked in zip(model.stages[1:], alone, strict=True):
            assert np.allclose(found.coefficients.toArray(), asked.coefficients.toArray(), atol=1e-3)
            assert abs(found.intercept - asked.intercept) < 1e-3


def test_positions_share_their_passes(spark, monkeypatch):
    """Twelve positions take no more passes over the rows than the slowest of them, not twelve times as many."""
    passes, summed = [], logistic.summed
    monkeypatch.setattr(logistic, "summed", lambda *a: passes.append(1) or summed(*a))
    positions = list(range(1, 13))
    df = lines(spark).withColumn("meter", F.concat(*["meter"] * 4))
    models.fit_ova(df, "text", "meter", positions, BUCKETS, max_iter=3)
    assert 4 <= len(passes) <= 2 + 3 * logistic.TRIES


def test_label_that_all_rows_share(spark, tmp_path):
    """It has the probability 1 or 0, also once saved; such rows are scored for the other labels as ever."""
    df = lines(spark)
    model = models.fit_ova(df, "text", "meter", [1, 3, 4], BUCKETS)
    assert [math.copysign(1, x.intercept) * math.isinf(x.intercept) for x in model.stages[2:]] == [1, -1]
    again = models.save_and_reload(model, spark, str(tmp_path / "model"))
    for m in (model, again):
        scores = [r.scores for r in models.ova_scores(m, df, "text", [1, 3, 4]).collect()]
        assert len(scores) == 300 and all(0 < s[0] < 1 and s[1:] == [1.0, 0.0] for s in scores)
    assert [x.getProbabilityCol() for x in again.stages[1:]] == ["pos1_probability", "pos3_probability", "pos4_probability"]


def test_rows_that_cannot_be_fitted(spark):
    for rows in (lines(spark).withColumn("meter", F.lit(None).cast("string")), lines(spark).withColumn("text", F.lit(None).cast("string")),
                 lines(spark).limit(0)):
        with pytest.raises(Exception):
            models.fit_ova(rows, "text", "meter", [1], BUCKETS)


def test_round_trip_moves_no_scores(spark, data):
    """Both models score a row where it lies; the scores are not joined."""
    df = QUERIES["model_round_trip"](spark, data)
    assert df.filter("same and positions = 12").count() == df.count() > 0
    assert "Join" not in plan_text(df) and "Exchange" not in plan_text(df)
