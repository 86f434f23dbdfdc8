import os

import pytest
from pyspark.sql import functions as F

from scansio import fixtures
from scansio import session as S
from tests.plans import plan_text


def test_shared_folder_is_the_one_of_the_session(spark):
    assert S.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert S.stage(spark.range(5), "x").inputFiles()[0].startswith("file://" + S.shared_dir(spark))


def test_only_bounded_tables_are_broadcast(spark):
    big = spark.range(1000)
    small = S.bounded(spark.range(10), "small", 10)
    assert "LocalTableScan" in plan_text(small) and "BroadcastHashJoin" in plan_text(big.join(small, "id"))
    large = S.bounded(spark.range(11), "large", 10)
    assert "FileScan" in plan_text(large) and large.count() == 11
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_text(big.join(large, "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_of_many_splits_are_not_spread(spark):
    many = spark.range(100, numPartitions=16)
    assert fixtures.spread(many, "id") is many
    assert "REPARTITION" in plan_text(fixtures.spread(spark.range(0, 100, 1, 1), "id"))


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Session())


def test_bounded_keeps_types(spark):
    df = spark.createDataFrame([(1, "a", [1.5])], "i int, s string, v array<double>").withColumn(
        "st", F.struct("i", "s"))
    assert S.bounded(df, "t").schema.simpleString() == df.schema.simpleString()
    assert S.bounded(df, "t").collect() == df.collect()


def test_staged_tables_are_deleted_by_their_owner(spark):
    outside = S.stage(spark.range(3), "outside")
    with S.staging(spark):
        inner = S.stage(spark.range(4), "inside")
        path, total = inner.inputFiles()[0].removeprefix("file://"), inner.count()
        assert os.path.exists(path)
    assert total == 4 and not os.path.exists(os.path.dirname(path)) and outside.count() == 3
    with pytest.raises(ValueError, match="stop"), S.staging(spark):
        path = S.stage(spark.range(4), "inside").inputFiles()[0].removeprefix("file://")
        raise ValueError("stop")
    assert not os.path.exists(path)


def test_large_rows_are_staged(spark, monkeypatch):
    monkeypatch.setattr(S, "BOUNDED_BYTES", 1000)
    assert "FileScan" in plan_text(S.bounded(spark.range(1000), "wide"))


def test_sized_settings():
    assert S.sized_settings(1 << 30)["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "200"
    assert S.sized_settings(100 << 40)["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "409600"
