"""The n-gram baseline from split lines to its measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.functions.meter import stress_labels, threshold_labels
from scansio.operators import gradient, metrics
from scansio.session import new_path, shuffles_deleted, stage, staging


def ngram_predictions(rows: DataFrame, positions: Sequence[int], vectors: DataFrame | None = None,
                      dim: int = gradient.DIM, buckets: int = gradient.BUCKETS, n: int = gradient.NGRAMS,
                          max_iter: int = gradient.EPOCHS, rate: float = gradient.RATE, damping: float = 0.003,
                      text: str = "text", pattern: str = "meter") -> DataFrame:
    """Fit one low-rank model on the train rows; test rows with ``scores`` and the label sets ``gold`` and ``labels``.

    ``rows`` holds ``split``: ``train`` or ``test``, as ``prepare_ngram`` returns
    them.  Stage it: train and test are read separately.  ``vectors`` (word, vector
    of ``dim`` numbers) are where words start from.
    """
    spark = rows.sparkSession
    path = new_path(spark, "predictions")
    # the parameters are far larger than the scores, and go before another fit begins
    with staging(spark), shuffles_deleted(spark):
        train, test = (stage(rows.filter(F.col("split") == s).drop("split").withColumn("id", F.monotonically_increasing_id()), s)
                       for s in ("train", "test"))
        model = gradient.LowRank(list(positions), dim, rate, max_iter, damping=damping)
        state = gradient.fit(gradient.featurise(train, text, pattern, positions, n, buckets), model, vectors)
        scored = gradient.scores(state, gradient.featurise(test, text, pattern, positions, n, buckets), model, vectors)
        found = test.join(scored, "id").drop("id")
        found.write.parquet(path)
        schema = found.schema
    return spark.read.schema(schema).parquet(path).withColumns({"gold": stress_labels(pattern), "labels": threshold_labels("scores")})


def ngram_report(predictions: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Samples, precision and recall of the labels, and the share of lines with exactly the gold labels."""
    return predictions.groupBy(*by).agg(
        F.count("*").alias("samples"),
        metrics.label_precision("gold", "labels").alias("precision"),
        metrics.label_recall("gold", "labels").alias("recall"),
        metrics.label_set_match("gold", "labels").alias("accuracy"))
