"""Writers.  All of them write in parallel; none gathers rows on the driver."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansio import schema as S
from scansio.functions.meter import stress_labels
from scansio.operators.dedup import dedup_adjacent
from scansio.operators.filters import reviewed, unreviewed
from scansio.session import new_path

# Quotes are doubled and blanks at the ends of a field are kept.
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_splits(rows: DataFrame, path: str, format: str = "csv") -> None:
    """Train, dev and test rows under ``lang=/split=``: the columns of ``SPLIT_ROW``, whatever else there is.

    Rows without ``sota`` get an empty one; another missing column is an error.
    Rows meet those of their folder first, where adaptive execution cuts a large
    folder into tasks of the advisory size and gives several small ones to one
    task, so the number of files follows the bytes and not tasks times folders.
    """
    if "sota" not in rows.columns:
        rows = rows.withColumn("sota", F.lit(None).cast("string"))
    absent = [c for c in S.SPLIT_ROW.names if c not in rows.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} among {', '.join(rows.columns)}")
    writer = rows.select(*S.SPLIT_ROW.names).hint("rebalance", "lang", "split").write.partitionBy("lang", "split")
    if format == "csv":
        writer.csv(path, header=True, **CSV)
    else:
        writer.format(format).save(path)


def write_held(rows: DataFrame, keys: Sequence[str] = ("lang", "text"), buckets: int | None = None,
               name: str | None = None) -> str:
    """A test set stored as a bucketed table, by whose name later runs find it.

    ``remove_leakage`` against it, or a join of scores by the same keys, moves
    the other side only.  ``buckets`` should be about the shuffle partitions of
    those joins, which it is by default.  The files lie in the shared folder.
    """
    spark = rows.sparkSession
    name = name or f"held_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", new_path(spark, name)).saveAsTable(name))
    return name


def labelled_line(text: str, pattern: str) -> Column:
    """``labels... text``; a pattern without stress leaves a leading blank."""
    return F.concat_ws(" ", F.array_join(stress_labels(pattern), " "), F.col(text))


def write_labelled(rows: DataFrame, path: str) -> None:
    rows.select(labelled_line("text", "meter").alias("value")).write.text(path, lineSep="\n")


def write_reviewed(rows: DataFrame, text_path: str, pairs_path: str, source: str, position: str) -> None:
    """Unreviewed lines as text, reviewed ``(line, pattern)`` pairs as CSV.

    A pair that repeats the one before it in its source is written once.
    """
    unreviewed(rows).select("line_text").write.text(text_path, lineSep="\n")
    pairs = reviewed(rows).withColumn("pair", F.struct("line_text", "metrical_pattern"))
    (dedup_adjacent(pairs, "pair", source, position).select("line_text", "metrical_pattern")
     .write.csv(pairs_path, quoteAll=True, **CSV))


def write_lm_text(rows: DataFrame, path: str) -> None:
    """Lines of all languages under ``split=``, one common corpus per split."""
    rows.select("value", "split").write.partitionBy("split").text(path, lineSep="\n")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("text", "truth", "candidates").write.json(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """One record per run and measure."""
    rows.write.json(path)
