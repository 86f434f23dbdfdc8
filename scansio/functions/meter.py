"""Stress patterns, label vectors and label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRESSED = "+"
UNSTRESSED = "-"
LABEL_WIDTH = 12
LABEL_PREFIX = "__label__syll-"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_marks(pattern: Column | str) -> Column:
    """Remove foot and optional-syllable marks."""
    return F.translate(_col(pattern), "|()", "")


def meter_length(pattern: Column | str) -> Column:
    return F.length(_col(pattern))


def _symbols(pattern: Column | str) -> Column:
    # split once per row: a pattern used inside a lambda would be computed per symbol
    return F.filter(F.split(_col(pattern), ""), lambda s: s != "")


def encode_meter(pattern: Column | str, pad: int = LABEL_WIDTH) -> Column:
    """0/1 vector of width ``pad``: 1 where the syllable is stressed."""
    labels = F.transform(_symbols(pattern), lambda s: (s == STRESSED).cast("int"))
    return F.slice(F.concat(labels, F.array_repeat(F.lit(0), F.lit(pad))), 1, pad)


def decode_meter(labels: Column | str) -> Column:
    return F.array_join(
        F.transform(_col(labels), lambda x: F.when(x != 0, STRESSED).otherwise(UNSTRESSED)), "")


def stress_index(pattern: Column | str) -> Column:
    """0-based positions of stressed syllables."""
    places = F.transform(_symbols(pattern), lambda s, i: F.when(s == STRESSED, i))
    return F.filter(places, lambda i: i.isNotNull())


def stress_labels(pattern: Column | str) -> Column:
    return F.transform(stress_index(pattern), lambda i: F.concat(F.lit(LABEL_PREFIX), i + 1))


def stress_text(pattern: Column | str) -> Column:
    """1-based stressed positions as text, the target of the seq2seq route."""
    return F.array_join(F.transform(stress_index(pattern), lambda i: (i + 1).cast("string")), ", ")


def fit_to_gold(pred: Column | str, length: Column | str) -> Column:
    """Cut a prediction to the length of the gold pattern."""
    return F.substr(_col(pred), F.lit(1), _col(length))


def threshold_labels(scores: Column | str, threshold: float = 0.5) -> Column:
    """Labels of the positions whose score reaches the threshold."""
    named = F.transform(
        _col(scores),
        lambda s, i: F.when(s >= threshold, F.concat(F.lit(LABEL_PREFIX), i + 1)))
    return F.filter(named, lambda x: x.isNotNull())


def widen(df: DataFrame, labels: str, width: int) -> DataFrame:
    """One DOUBLE column per position next to the other columns."""
    return df.select(
        *[c for c in df.columns if c != labels],
        *[F.get(F.col(labels), F.lit(i)).cast("double").alias(f"pos{i + 1}") for i in range(width)])


def widen_from_data(df: DataFrame, pattern: str) -> DataFrame:
    """As ``widen``, as wide as the longest pattern (one small action)."""
    width = df.agg(F.max(F.length(pattern))).first()[0] or 0
    return widen(df.withColumn("labels", encode_meter(pattern, width)), "labels", width)
