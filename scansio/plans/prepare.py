"""Raw corpora to train, dev and test rows.

Every plan handles all languages at once: ``lang`` is part of each key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio import schema as S
from scansio.functions.meter import meter_length, strip_marks
from scansio.functions.text import clean_label, clean_text
from scansio.operators.dedup import dedup_first, remove_leakage
from scansio.operators.features import label_index
from scansio.operators.filters import drop_baseline, drop_irregular, keep_lengths, reviewed
from scansio.operators.sampling import (
    cap_per_group, rebalanced, split_exact, split_stratified, split_three_way)
from scansio.session import stage

TEXT_KEY = ("lang", "text")


def clean_corpus(df: DataFrame, order: Sequence[str], marked: bool = False) -> DataFrame:
    """Canonical rows cleaned, measured and reduced to the first row per text.

    The length filter comes after: a text whose first copy has another length
    disappears.
    """
    meter = strip_marks("meter") if marked else F.col("meter")
    rows = df.withColumn("text", clean_text("text")).withColumn("meter", meter)
    return dedup_first(rows.withColumn("length", meter_length("meter")), TEXT_KEY, order)


def prepare_against_test(pool: DataFrame, test: DataFrame, order: Sequence[str],
                         lengths: Sequence[int] = S.SPANISH_LENGTHS, dev: float = 0.25) -> DataFrame:
    """Reviewed pool split into train and dev next to a given, reviewed test set."""
    held = keep_lengths(clean_corpus(reviewed(test), order), lengths)
    free = keep_lengths(remove_leakage(clean_corpus(reviewed(pool), order), held, TEXT_KEY), lengths)
    drawn = split_exact(free, ["lang"], TEXT_KEY, dev)
    return drop_baseline(drawn.unionByName(held.withColumn("split", F.lit("test"))))


def prepare_three_way(corpus: DataFrame, order: Sequence[str], lengths: Sequence[int] = S.VERSE_LENGTHS,
                      test: float = 0.15, dev: float = 0.176) -> DataFrame:
    """One corpus with a shipped baseline split into train, dev and test."""
    rows = keep_lengths(clean_corpus(corpus, order), lengths)
    return drop_baseline(split_three_way(rows, ["lang"], TEXT_KEY, test, dev))


def prepare_rebalanced(pool: DataFrame, test: DataFrame, order: Sequence[str],
                       lengths: Sequence[int] = S.VERSE_LENGTHS, cap: int = 300) -> DataFrame:
    """Capped pool, topped up from the external test set, dev stratified by length."""
    held = stage(keep_lengths(clean_corpus(test, order), lengths), "external")
    free = remove_leakage(clean_corpus(reviewed(pool), order, marked=True), held, TEXT_KEY)
    kept = drop_irregular(keep_lengths(free, lengths))
    capped = cap_per_group(kept, ["lang", "meter"], TEXT_KEY, cap)
    return drop_baseline(rebalanced(capped, held, ["lang"], TEXT_KEY, "length")).drop("part")


def prepare_ngram(pool: DataFrame, order: Sequence[str], test: DataFrame | None = None,
                  lengths: Sequence[int] = S.NGRAM_VERSE_LENGTHS, held: float = 0.15) -> DataFrame:
    """Train and test rows of the n-gram baseline: next to a given test set, or with a share held out."""
    if test is None:
        rows = keep_lengths(clean_corpus(pool, order), lengths)
        return split_exact(rows, ["lang"], TEXT_KEY, held, held="test")
    given = keep_lengths(clean_corpus(test, order), lengths)
    free = keep_lengths(remove_leakage(clean_corpus(pool, order, marked=True), given, TEXT_KEY), lengths)
    return free.withColumn("split", F.lit("train")).unionByName(
        given.withColumn("split", F.lit("test")), allowMissingColumns=True)


def prepare_stanzas(stanzas: DataFrame, key: str, held: float = 0.25) -> DataFrame:
    """Clean stanzas with their class number, split so that classes keep their shares."""
    rows = stanzas.withColumn("text", clean_text("text")).withColumn("stanza", clean_label("stanza"))
    return split_stratified(label_index(rows, "stanza"), [], "stanza", [F.col(key).cast("string")], held)
