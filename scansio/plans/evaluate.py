"""Prepared rows and predictions to scores, all languages and splits in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.functions.meter import LABEL_WIDTH, decode_meter, encode_meter, fit_to_gold
from scansio.operators import metrics
from scansio.operators.metrics import hit


def decode_predictions(df: DataFrame, labels: str, length: str = "length") -> DataFrame:
    """Label vectors to patterns of the gold length."""
    return df.withColumn("pred", fit_to_gold(decode_meter(labels), length))


def through_labels(df: DataFrame, pattern: str, pad: int = LABEL_WIDTH) -> DataFrame:
    """A pattern column passed through the label encoding, as a model returns it."""
    return decode_predictions(df.withColumn("predicted", encode_meter(pattern, pad)), "predicted")


def score(df: DataFrame, models: dict[str, str], by: Sequence[str] = ("lang",)) -> DataFrame:
    """Accuracy of several prediction columns per group and over all rows.

    ``models`` maps a model name to its column.  Rows are read once; the pooled
    rows are rolled up from the groups.
    """
    sums = [F.sum(hit("meter", column)).alias(name) for name, column in models.items()]
    groups = df.groupBy(*by).agg(F.count("*").alias("rows"), *sums)
    pool = groups.rollup(*by).agg(F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in models])
    long = pool.unpivot([*by, "rows"], list(models), "model", "hits")
    return long.select(*by, "model", "rows", (F.col("hits") / F.col("rows")).alias("accuracy"))


def run_report(df: DataFrame, model_lang: str, gold: str = "meter", pred: str = "pred", baseline: str = "sota",
               lang: str = "lang") -> DataFrame:
    """One row per data language of a run: accuracy on dev and on test, and of the shipped baseline on test.

    ``df`` holds scored rows with ``split``.  One pass over the rows; what is
    spread over columns afterwards is one row per language and split.
    """
    per_split = df.filter(F.col("split").isin("dev", "test")).groupBy(lang, "split").agg(
        metrics.exact_match(gold, pred).alias("model"), metrics.exact_match(gold, baseline).alias("baseline"))
    scores = per_split.select(
        F.lit(model_lang).alias("model_lang"), F.col(lang).alias("data_lang"),
        F.inline(F.array(
            F.struct(F.when(F.col("split") == "dev", "eval_accuracy").otherwise("test_accuracy").alias("measure"),
                     F.col("model").alias("value")),
            F.struct(F.when(F.col("split") == "test", "sota").alias("measure"), F.col("baseline").alias("value")))))
    return metrics.run_report(scores.filter("measure IS NOT NULL"), ["eval_accuracy", "test_accuracy", "sota"])
