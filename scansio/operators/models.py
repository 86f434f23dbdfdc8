"""Distributed baseline models and scoring with a user's own predictor."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.functions.binding import once
from scansio.functions.meter import decode_meter, encode_meter, fit_to_gold
from scansio.operators import gradient, logistic
from scansio.operators.metrics import exact_match
from scansio.operators.runs import best_run
from scansio.session import new_path, shuffles_deleted, stage, staging

BUCKETS = 1 << 21


def word_ngrams(text: Column | str, n: int = 3) -> Column:
    """Words and all n-grams up to ``n``, in one array."""
    def grams(words: Column, size: int) -> Column:
        # from each word that has enough words behind it, by place: no array is made for an n-gram
        firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))
        return F.transform(firsts, lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, size)]))

    words = F.filter(F.split(text, " "), lambda w: w != "")
    return once(words, lambda w: F.concat(w, *[grams(w, size) for size in range(2, n + 1)]))


def ova_frame(df: DataFrame, text: str, pattern: str, positions: Sequence[int], n: int = 3) -> DataFrame:
    """Terms and one 0/1 label column per syllable position (1-based)."""
    labels = encode_meter(pattern, max(positions))
    return df.withColumn("terms", word_ngrams(text, n)).withColumns(
        {f"pos{p}": F.get(labels, F.lit(p - 1)).cast("double") for p in positions})


def ova_features(train: DataFrame, text: str, pattern: str, positions: Sequence[int], buckets: int = BUCKETS,
                 n: int = 3) -> DataFrame:
    """Hashed n-grams and labels in blocks, staged: every pass of a fit scans this table."""
    hashing = HashingTF(inputCol="terms", outputCol="features", numFeatures=buckets)
    rows = hashing.transform(ova_frame(train, text, pattern, positions, n))
    return logistic.packed(rows, "features", [f"pos{p}" for p in positions])


def fit_positions(features: DataFrame, positions: Sequence[int], buckets: int = BUCKETS, max_iter: int = 20,
                  reg: float = 1e-4) -> PipelineModel:
    """One logistic regression per syllable on staged features, all fitted in the same passes."""
    hashing = HashingTF(inputCol="terms", outputCol="features", numFeatures=buckets)
    weights, intercepts = logistic.fit(features, len(positions), buckets, max_iter, reg)
    return PipelineModel([hashing, *[
        _regression(features.sparkSession, f"pos{p}", w, float(b), max_iter, reg)
        for p, w, b in zip(positions, weights, intercepts, strict=True)]])


def _regression(spark, label: str, weights: np.ndarray, intercept: float, max_iter: int, reg: float) -> LogisticRegressionModel:
    """Spark ML's model of given weights: it scores, saves and loads like one that Spark ML has fitted."""
    form = LogisticRegression(featuresCol="features", labelCol=label, predictionCol=f"{label}_hat",
                              probabilityCol=f"{label}_probability", rawPredictionCol=f"{label}_raw",
                              maxIter=max_iter, regParam=reg, aggregationDepth=3, standardization=False)
    # Python has no call for this; the vector goes over as in Spark ML's own wrappers
    vector = _py2java(spark.sparkContext, Vectors.dense(weights))
    made = spark.sparkContext._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(form.uid, vector, intercept)
    return form._copyValues(LogisticRegressionModel(made))


def fit_ova(train: DataFrame, text: str, pattern: str, positions: Sequence[int], buckets: int = BUCKETS,
            n: int = 3, max_iter: int = 20, reg: float = 1e-4) -> PipelineModel:
    """One logistic regression per syllable over hashed n-grams; features are hashed once."""
    return fit_positions(ova_features(train, text, pattern, positions, buckets, n), positions, buckets, max_iter, reg)


def ova_scores(model: PipelineModel, df: DataFrame, text: str, positions: Sequence[int],
               n: int = 3) -> DataFrame:
    """Probability of stress per position as one array."""
    scored = model.transform(df.withColumn("terms", word_ngrams(text, n)))
    score = F.array(*[vector_to_array(f"pos{p}_probability")[1] for p in positions])
    return scored.select(*df.columns, score.alias("scores"))


def fit_classifier(train: DataFrame, text: str, label: str, buckets: int = BUCKETS, n: int = 2,
                   max_iter: int = 20, reg: float = 1e-4) -> PipelineModel:
    """Single-label text classifier; class numbers follow the sorted class names.

    A class that only appears later has the number behind the last one; it is
    never predicted, so the fit must not see it announced in the column metadata.
    """
    rows = train.withColumn("terms", word_ngrams(text, n))
    stages = [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        HashingTF(inputCol="terms", outputCol="features", numFeatures=buckets),
    ]
    prepare = Pipeline(stages=stages).fit(rows)
    seen = F.col("label").alias("label", metadata={})
    features = stage(prepare.transform(rows).select("features", seen), "features")
    fitted = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial", aggregationDepth=3,
                                standardization=False).fit(features)
    return PipelineModel([*prepare.stages, fitted])


def classify(model: PipelineModel, df: DataFrame, text: str, n: int = 2) -> DataFrame:
    """Rows with ``label`` and ``predicted`` class numbers."""
    scored = model.transform(df.withColumn("terms", word_ngrams(text, n)))
    return scored.select(*df.columns, F.col("label").cast("int").alias("label"),
                         F.col("prediction").cast("int").alias("predicted"))


def save_and_reload(model: PipelineModel, spark, path: str | None = None) -> PipelineModel:
    path = path or new_path(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


def sweep(train: DataFrame, held: DataFrame, text: str, pattern: str, positions: Sequence[int],
          grid: Sequence[dict], buckets: int = BUCKETS, n: int = 3, by: str = "lang") -> DataFrame:
    """Fit every combination and score it on held-out rows: ``run, by, parameters, accuracy``.

    All combinations and positions are columns of one parameter table, so an
    iteration is one scan of one table of features, and so is the scoring.  A
    combination may set ``n`` (up to the ``n`` of the features), ``reg``, ``rate``
    and ``max_iter``; the accuracy is the share of lines whose whole pattern is right.
    """
    positions = list(positions)
    model = gradient.Linear(positions, grid, n=n)
    spark = train.sparkSession
    path = new_path(spark, "accuracies")
    with staging(spark), shuffles_deleted(spark):
        fitted, asked = (stage(df.withColumn("id", F.monotonically_increasing_id()), "rows") for df in (train, held))
        state = gradient.fit(gradient.featurise(fitted, text, pattern, positions, n, buckets), model)
        scored = gradient.scores(state, gradient.featurise(asked, text, pattern, positions, n, buckets), model)
        runs = [F.struct(F.lit(i).alias("run"), F.lit(str(choice)).alias("parameters"),
                         F.slice("scores", i * len(positions) + 1, len(positions)).alias("scores")) for i, choice in enumerate(grid)]
        each = asked.select("id", by, pattern).join(scored, "id").select(by, pattern, F.inline(F.array(*runs)))
        guess = fit_to_gold(decode_meter(F.transform("scores", lambda p: (p >= 0.5).cast("int"))), F.length(pattern))
        found = each.groupBy("run", by, "parameters").agg(exact_match(pattern, guess).alias("accuracy"))
        found.write.parquet(path)
        schema = found.schema
    return spark.read.schema(schema).parquet(path)


def sweep_best(runs: DataFrame) -> DataFrame:
    return best_run(runs, ["lang"], "run")


def batch_score(df: DataFrame, inputs: Sequence[str], make_predictor: Callable[[], Callable],
                output: str = "pred", return_type: T.DataType = T.StringType(),
                batch_size: int = 1024) -> DataFrame:
    """Rows scored in batches by a user's predictor, loaded once per Python worker."""
    predict = predict_batch_udf(make_predictor, return_type=return_type, batch_size=batch_size)
    return df.withColumn(output, predict(*inputs))
