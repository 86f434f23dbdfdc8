"""Raw poetry to cleaned, split lines of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions.text import squeeze_line
from scansio.operators.dedup import dedup_adjacent
from scansio.operators.filters import drop_junk
from scansio.operators.sampling import split_positional
from scansio.session import bounded, stage


def clean_lines(lines: DataFrame, source: str, position: str, digits: bool = False) -> DataFrame:
    """Squeeze blanks, drop junk lines, drop lines that repeat the one before."""
    squeezed = lines.withColumn("value", squeeze_line("value"))
    return dedup_adjacent(drop_junk(squeezed, "value", digits), "value", source, position)


def numbered_lines(lines: DataFrame, order: str = "line_id", folders: bool = False) -> DataFrame:
    """Lines of files with ``source``, the number of their file, and ``position``, their place in it.

    With ``folders`` the files of a folder are one source, in the order of their names.

    Blocks of a file are counted, not its lines sorted: a line's place is the
    lines of the blocks before and its place in its own.  The file and block
    tables are as small as the list of splits.
    """
    rows = stage(lines, "lines")
    blocks = rows.groupBy(F.col(f"{order}.file").alias("file"), F.col(f"{order}.block").alias("block")).agg(
        F.count("*").alias("n"), F.min(f"{order}.row").alias("first"))
    blocks = blocks.withColumn("whole", F.regexp_replace("file", "/[^/]*$", "") if folders else F.col("file"))
    before = F.sum("n").over(Window.partitionBy("whole").orderBy("file", "block")) - F.col("n")
    wholes = blocks.select("whole").distinct().withColumn("source", F.row_number().over(Window.orderBy("whole")) - 1)
    places = bounded(blocks.withColumn("before", before).join(wholes, "whole")
                     .select("file", "block", "source", (F.col("before") - F.col("first")).alias("shift")), "blocks")
    here = (F.col(f"{order}.file") == F.col("file")) & (F.col(f"{order}.block") == F.col("block"))
    return rows.join(places, here).select(
        *[c for c in lines.columns if c != order], F.col("source").cast("bigint").alias("source"),
        (F.col(f"{order}.row") + F.col("shift")).alias("position"))


def lm_corpus(lines: DataFrame, by: Sequence[str], source: str, position: str) -> DataFrame:
    """Cleaned lines of every language; the first 75 % train, the rest evaluate."""
    return split_positional(clean_lines(lines, source, position), by, source, position)


def poem_lines(poems: DataFrame, text: str = "text") -> DataFrame:
    """Poems to lines with their position."""
    return poems.select(*[c for c in poems.columns if c != text],
                        F.posexplode(F.split(text, "\n")).alias("pos", "value"))
