"""Row filters and the canonical verse columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio import schema as S
from scansio.functions.text import is_junk


def reviewed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("manually_checked"))


def unreviewed(df: DataFrame) -> DataFrame:
    """Rows marked as not reviewed; an unknown mark is neither."""
    return df.filter(~F.col("manually_checked"))


def keep_lengths(df: DataFrame, lengths: Sequence[int] = S.VERSE_LENGTHS) -> DataFrame:
    return df.filter(F.col("length").isin(list(lengths)))


def drop_irregular(df: DataFrame) -> DataFrame:
    """The word ``irregular`` is nine letters long, so a length filter keeps it."""
    return df.filter(F.col("meter") != "irregular")


def drop_junk(df: DataFrame, column: str = "value", digits: bool = False) -> DataFrame:
    return df.filter(~is_junk(column, digits))


def lang_code(lang: str) -> str:
    """The code under which a language is stored: ``ge`` is another name of ``de``."""
    return "de" if lang == "ge" else lang


def select_lang(df: DataFrame, lang: str) -> DataFrame:
    """One language, or all of them for ``multi``; ``ge`` is another name of ``de``."""
    if lang == "multi":
        return df
    return df.filter(F.col("lang") == lang_code(lang))


def final_fit_rows(df: DataFrame) -> DataFrame:
    """Train and dev rows together, for the last fit."""
    return df.filter(F.col("split").isin("train", "dev"))


def drop_baseline(df: DataFrame) -> DataFrame:
    """The shipped baseline stays on test rows only; rows of corpora without one are left as they are."""
    if "sota" not in df.columns:
        return df
    return df.withColumn("sota", F.when(F.col("split") == "test", F.col("sota")))


def seq2seq_frame(df: DataFrame, prefix: str = "scansion") -> DataFrame:
    """Prompt and target rows of the generative route."""
    from scansio.functions.meter import stress_text

    return df.select(
        F.lit(prefix).alias("prefix"),
        F.col("text").alias("input_text"),
        F.concat(F.lit(f"{prefix}: "), F.col("text")).alias("predict"),
        stress_text("meter").alias("target_text"))


def preview(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)
