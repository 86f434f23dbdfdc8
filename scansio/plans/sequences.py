"""Prepared rows to the inputs of a sequence model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio.functions.meter import encode_meter, widen
from scansio.operators.features import (
    MAX_FEATURES, MAX_LENGTH, encode_tokens, pad_tokens, vocabulary)


def sequence_frame(rows: DataFrame, key: Sequence[str], source: str, position: str, positions: int,
                   max_features: int = MAX_FEATURES, max_length: int = MAX_LENGTH) -> DataFrame:
    """Padded word indexes and one label column per syllable, for all splits.

    ``rows`` holds ``key..., text, meter, split`` and the order columns.  The
    vocabulary is fitted on the train rows only.
    """
    vocab = vocabulary(rows.filter(F.col("split") == "train"), "text", source, position, max_features)
    keyed = list(dict.fromkeys([*key, "text", "meter", "split"]))
    sequences = encode_tokens(rows, keyed, "text", vocab)
    padded = sequences.withColumn("sequence", pad_tokens("sequence", max_length))
    return widen(padded.withColumn("labels", encode_meter("meter", positions)), "labels", positions)
