"""Session, shared folder and the two ways a table is materialised.

``stage`` writes a table that is read more than once to the cluster's shared
folder: later jobs rescan columns of a Parquet table instead of recomputing the
plan, and losing an executor loses nothing.  ``bounded`` turns a small result
(class counts, thresholds) into a table whose size Catalyst knows, so it may be
broadcast; anything above the bound is staged and joined without a hint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOUNDED_ROWS = 100_000
BOUNDED_BYTES = 64 << 20


def session(app: str = "scansio", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_settings(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for an input of a given size.

    Shuffles start with partitions of about ``partition_bytes``, small enough to
    sort in an executor's memory; adaptive execution merges what turns out small.
    """
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
    }


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master, where driver and
    executors are one process; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scansio-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths given out inside each open ``staging`` block, innermost last.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block when it ends.

    Write or collect results inside: a DataFrame that reads a staged table is of
    no use afterwards.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            forget(spark, path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query inside the block when it ends: a loop else keeps those of all rounds.

    For writes and collects; a setting that this Spark does not know is left alone.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, path: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` in buckets of ``key``, sorted by it: joins and groups by ``key`` leave it where it lies.

    ``path`` comes from ``new_path``; the table has its name, by which ``stored`` finds it until ``forget`` deletes it.
    """
    options = {"path": path} | ({"compression": compression} if compression else {})
    df.write.bucketBy(buckets, key).sortBy(key).options(**options).saveAsTable(path.rsplit("/", 1)[1].replace("-", "_"))
    return stored(df.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(path.rsplit("/", 1)[1].replace("-", "_"))


def forget(spark: SparkSession, path: str) -> None:
    """Delete what ``stored_by`` wrote."""
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1].replace('-', '_')}")
    discard(spark, path)


def bounded(df: DataFrame, name: str, max_rows: int = BOUNDED_ROWS) -> DataFrame:
    """A small table, broadcast when it has at most ``max_rows`` rows and ``BOUNDED_BYTES`` bytes.

    At most ``max_rows + 1`` rows reach the driver.  A larger table is staged
    and left to Catalyst, which sees its true size.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows and head.nbytes <= BOUNDED_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))
    return stage(df, name)
