"""Joins: null-safe keys, and predictions next to gold rows."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where a missing key is a group like any other."""
    renamed = right.withColumnsRenamed({c: f"by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in by]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"by_{c}" for c in by])


def join_predictions(gold: DataFrame, predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gold rows with their prediction; rows without one are kept and marked."""
    marked = predictions.withColumn("scored", F.lit(True))
    return gold.join(marked, list(key), "left").withColumn("scored", F.col("scored").isNotNull())
