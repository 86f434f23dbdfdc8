"""A corpus pipeline of four stages: quality, near duplicates, repeated passages, packing.

Each stage takes all documents that the one before kept.  All but the last
return the columns of ``documents``, with text and n_chars as they then are.
Every stage gives an empty result for an empty table, takes nulls as its operator
does, and carries further columns along, whatever their names.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from scansio.llm import packing, quality, repeats, simhash  # noqa: E402
from scansio.llm.common import by_slice, extended, table  # noqa: E402
from scansio.llm.queries import JSON, PATTERN, ship  # noqa: E402
from scansio.session import stage  # noqa: E402

#: No SQL states a fitted model, XXH64 or tokenisation; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold, by the model fitted on labelled rows among them."""
    ship(spark)
    machine = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return quality.scored(docs, machine, name).filter(F.col(name) >= quality.THRESHOLD).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles differ in 3 bits or fewer."""
    ship(spark)
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that started before; a character that lost a byte goes, a document stays."""
    ship(spark)
    parts = repeats.cut(docs).select("row", "kept")

    def text(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([k.decode("utf-8", "ignore") for k in rows.column(1).to_pylist()], pa.string())],
            ["row", "kept"])

    cleaned = parts.mapInArrow(by_slice(text), extended(parts.select("row"), "kept string"))
    values = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    values["text"] = F.col("kept")
    if "n_chars" in values:
        values["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[values[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their place in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.packed_digests(docs.select("doc_id", "text"), JSON, PATTERN, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
