"""Duplicates and leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order.

    ``min_by`` is combined on the map side, so a line that makes up a third of
    the corpus reaches the shuffle as one row per map task.
    """
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("row")).select(*keys, "row.*")


def remove_leakage(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Train rows whose key does not occur in the test set.

    Two sides that come out of ``dedup_first`` on the same keys are already
    partitioned by them, so neither the distinct keys nor the anti-join adds a
    shuffle; a test set with repeats is reduced before it is moved.
    """
    return train.join(test.select(*keys).distinct(), list(keys), "left_anti")


def dedup_adjacent(df: DataFrame, value: str, source: str, position: str,
                   block_rows: int = 1 << 18) -> DataFrame:
    """Drop rows that repeat the row before them in the same source.

    A source may hold a third of all rows, so it is cut into blocks of
    positions.  Inside a block the previous row is a ``lag``.  The first row of a
    block gets its previous row from the edges alone, the first and last row of
    every block.  Both read the same exchange, so the input is scanned and
    shuffled once.
    """
    held = F.struct(F.col(value).alias("value"))
    block = Window.partitionBy(source, "block").orderBy(position)
    rows = (df.withColumn("block", F.floor(F.col(position) / F.lit(block_rows)))
            .withColumns({"previous": F.lag(held).over(block), "next": F.lead(F.lit(1)).over(block)}))
    first = F.col("previous").isNull()
    before = F.lag(held).over(Window.partitionBy(source).orderBy(position))
    edges = rows.filter(first | F.col("next").isNull()).withColumn("before", before).filter(first)
    both = rows.filter(~first).drop("next").unionByName(
        edges.withColumn("previous", F.col("before")).drop("next", "before"))
    return both.filter(F.col("previous").isNull()
                       | ~F.col(value).eqNullSafe(F.col("previous.value"))).select(*df.columns)
