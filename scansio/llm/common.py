"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of one slice of an Arrow batch; bounds what a task holds besides the batch itself.
SLICE_ROWS = 256


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of ``df`` with further columns, given as DDL; a name that ``df`` has already is an error."""
    more = StructType.fromDDL(columns).fields
    if clash := [f.name for f in more if f.name in df.columns]:
        raise ValueError(f"there is a column {', '.join(clash)} already: rename or drop it first")
    return StructType([*df.schema.fields, *more])


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """``work`` on each slice of each batch, for ``mapInArrow``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()
    return run


def bound_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of a few MB, whatever the length of texts, unless the session says otherwise.

    A worker holds a batch, its rows as objects and what it made of them, and the
    JVM holds the batch on both sides of the pipe, all of it for each core.
    """
    said = spark.sparkContext.getConf()
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1024"),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if said.get(key) is None:
            spark.conf.set(key, value)
