"""Quality measures.

Measures are aggregate expressions, so any number of them runs in one pass over
any grouping; the grouped tables built on top are as small as their groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio.functions.binding import once
from scansio.functions.text import normalise_answer


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hit(gold: Column | str, pred: Column | str) -> Column:
    """1.0 where the prediction equals the gold value; a missing one is wrong."""
    return F.coalesce(_col(gold) == _col(pred), F.lit(False)).cast("double")


def exact_match(gold: Column | str, pred: Column | str) -> Column:
    return F.avg(hit(gold, pred))


def pooled_match(df: DataFrame, gold: str, pred: str, by: str = "lang") -> DataFrame:
    """Accuracy per group and, in the row without a group, over all rows.

    Hits and sizes are summed per group first and rolled up from there, so the
    rows are neither read twice nor expanded.
    """
    per_group = df.groupBy(by).agg(F.sum(hit(gold, pred)).alias("hits"), F.count("*").alias("rows"))
    return (per_group.rollup(by)
            .agg((F.sum("hits") / F.sum("rows")).alias("accuracy"), F.sum("rows").alias("rows")))


def macro_match(df: DataFrame, gold: str, pred: str, by: str = "lang") -> DataFrame:
    """Unweighted mean of the per-group accuracies."""
    return (df.groupBy(by).agg(exact_match(gold, pred).alias("accuracy"))
            .agg(F.avg("accuracy").alias("macro_accuracy")))


def label_set_match(gold: Column | str, pred: Column | str) -> Column:
    """Share of rows whose label sets are equal; a missing set is wrong."""
    same = F.array_sort(F.array_distinct(_col(gold))) == F.array_sort(F.array_distinct(_col(pred)))
    return F.avg(F.coalesce(same, F.lit(False)).cast("double"))


def label_precision(gold: Column | str, pred: Column | str) -> Column:
    common = F.sum(F.size(F.array_intersect(_col(gold), _col(pred))))
    return common / F.sum(F.size(_col(pred)))


def label_recall(gold: Column | str, pred: Column | str) -> Column:
    common = F.sum(F.size(F.array_intersect(_col(gold), _col(pred))))
    return common / F.sum(F.size(_col(gold)))


def token_f1(gold: Column | str, pred: Column | str) -> Column:
    """Token-overlap F1 of one row; without tokens on a side it is equality, a missing side is wrong."""
    return overlap_f1(normalise_answer(gold), normalise_answer(pred))


def overlap_f1(gold: Column | str, pred: Column | str) -> Column:
    """``token_f1`` of answers that are normalised already."""
    def tokens(c: Column | str) -> Column:
        return F.filter(F.split(c, " "), lambda w: w != "")

    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == word))

    def f1(pair: Column) -> Column:
        g, p = pair["g"], pair["p"]
        common = F.aggregate(
            F.array_intersect(g, p), F.lit(0),
            lambda total, word: total + F.least(times(g, word), times(p, word)))
        empty = (F.size(g) == 0) | (F.size(p) == 0)
        return (F.when(empty, (F.size(g) == F.size(p)).cast("double"))
                .otherwise(common * 2.0 / (F.size(g) + F.size(p))))

    return F.coalesce(once(F.struct(tokens(gold).alias("g"), tokens(pred).alias("p")), f1), F.lit(0.0))


def normalised_hit(gold: Column | str, pred: Column | str) -> Column:
    return hit(normalise_answer(gold), normalise_answer(pred))


def any_hit(gold: Column | str, candidates: Column | str) -> Column:
    """1.0 where the gold value is among the candidates; missing candidates are wrong."""
    return F.coalesce(F.array_contains(_col(candidates), _col(gold)), F.lit(False)).cast("double")


def top1_hit(gold: Column | str, candidates: Column | str) -> Column:
    return hit(gold, F.get(_col(candidates), F.lit(0)))


def arg_max(scores: Column | str) -> Column:
    """0-based position of the first largest score."""
    return (F.array_position(_col(scores), F.array_max(_col(scores))) - 1).cast("int")


def flat_accuracy(label: Column | str, scores: Column | str) -> Column:
    return F.avg(hit(label, arg_max(scores)))


def generative_scores(df: DataFrame, by: str = "prefix") -> DataFrame:
    """All measures of the generative route, per task prefix, in one pass."""
    first = F.get(F.col("all_predicted"), F.lit(0))
    rows = df.select(
        by, normalise_answer("target_text").alias("gold"), normalise_answer(first).alias("pred"),
        top1_hit("target_text", "all_predicted").alias("top1"),
        any_hit("target_text", "all_predicted").alias("any"))
    return rows.groupBy(by).agg(
        F.avg(overlap_f1("gold", "pred")).alias("f1"),
        exact_match("gold", "pred").alias("exact"),
        F.avg("top1").alias("accuracy"), F.sum("any").cast("bigint").alias("any_hits"), F.avg("any").alias("any_rate"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("lang", "split").agg(F.count("*").alias("rows"))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def wrong_predictions(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.filter(hit(gold, pred) == 0.0)


def position_confusion(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each gold symbol was predicted as each symbol, per position.

    A line yields one row per syllable, combined on the map side into at most
    four rows per position; a syllable without a prediction counts as the empty
    symbol.
    """
    symbols = F.zip_with(
        F.split(gold, ""), F.split(F.coalesce(F.col(pred), F.lit("")), ""),
        lambda g, p: F.struct(g.alias("gold"), F.coalesce(p, F.lit("")).alias("predicted")))
    cells = df.select(*by, F.posexplode(symbols).alias("place", "cell"))
    return (cells.filter("cell.gold <> ''")
            .select(*by, (F.col("place") + 1).alias("position"), "cell.gold", "cell.predicted")
            .groupBy(*by, "position", "gold", "predicted").agg(F.count("*").alias("rows")))


def run_report(scores: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Measures side by side, one row per run language and data language."""
    return (scores.groupBy("model_lang", "data_lang").pivot("measure", list(measures))
            .agg(F.first("value")))


def vector_moments(df: DataFrame, vector: str, width: bool = False) -> DataFrame:
    """Mean and population standard deviation over all components of all vectors, and on demand the widest.

    Each row is reduced to three numbers in place; components are never exploded.
    One component is taken off all others first: sums of squares of small
    differences lose nothing, whatever the size of the values.
    """
    one = df.select(F.get(vector, F.lit(0)).cast("double").alias("x")).filter("x is not null").first()
    pivot = F.lit(one["x"] if one else 0.0)
    v = F.transform(F.col(vector), lambda x: x.cast("double") - pivot)
    zero = F.lit(0.0)
    sums = df.select(
        F.size(vector).cast("bigint").alias("n"),
        F.aggregate(v, zero, lambda s, x: s + x).alias("s"),
        F.aggregate(v, zero, lambda s, x: s + x * x).alias("q"))
    total = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("n").alias("width"))
    mean = F.col("s") / F.col("n")
    return total.select("n", *["width"] * width, (mean + pivot).alias("mean"),
                        F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
