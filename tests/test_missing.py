"""Missing keys, missing predictions, frames without groups and repeated keys."""

import pytest
from pyspark.sql import functions as F

from scansio.operators import dedup, features, metrics, sampling


@pytest.fixture(scope="module")
def lines(spark):
    return spark.range(100).select(F.concat(F.lit("line "), "id").alias("text"), (F.col("id") % 7).alias("length"))


def counts(df, column="split"):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_splits_without_a_group(spark, lines):
    assert counts(sampling.split_exact(lines, [], ["text"], 0.25)) == {"dev": 25, "train": 75}
    assert counts(sampling.split_three_way(lines, [], ["text"])) == {"test": 15, "dev": 15, "train": 70}
    wanted = spark.createDataFrame([(30,)], "size bigint")
    drawn = sampling.split_stratified(lines, [], "length", ["text"], sizes=wanted)
    assert counts(drawn) == {"dev": 30, "train": 70} and drawn.columns == ["text", "length", "split"]
    placed = lines.withColumn("source", F.col("length")).withColumn("position", F.monotonically_increasing_id())
    assert counts(sampling.split_positional(placed, [], "source", "position")) == {"train": 75, "eval": 25}
    assert counts(sampling.split_positional_shuffled(lines, [], ["text"])) == {"train": 75, "eval": 25}


def test_rebalance_without_a_group(lines):
    test = lines.withColumn("text", F.concat(F.lit("t"), "text"))
    sizes = sampling.rebalance_sizes(lines, test, [])
    want = sizes.first()
    parts = counts(sampling.rebalance(lines, test, sizes, [], ["text"]), "part")
    assert parts == {"pool": 100, "moved": want["moved"], "test": want["test"]}


def test_repeated_keys_keep_the_size(spark):
    rows = spark.range(100).select(F.lit("es").alias("lang"), (F.col("id") % 5).cast("string").alias("text"))
    assert counts(sampling.split_exact(rows, ["lang"], ["text"], 0.25)) == {"dev": 25, "train": 75}


def test_missing_predictions_are_wrong(spark):
    rows = spark.createDataFrame([("1, 2", ["1, 2"], ["a"], ["a"], "+-"), ("1, 2", None, ["a"], None, None), ("1, 2", [], ["a"], ["b"], "++")],
                                 "target_text string, all_predicted array<string>, gold array<string>, pred array<string>, meter string")
    got = metrics.generative_scores(rows.withColumn("prefix", F.lit("x"))).first()
    assert {round(got[c], 3) for c in ("f1", "exact", "accuracy", "any_rate")} == {0.333} and got["any_hits"] == 1
    assert round(rows.agg(metrics.label_set_match("gold", "pred")).first()[0], 3) == 0.333
    cells = metrics.position_confusion(rows.withColumn("truth", F.lit("+-")), "truth", "meter").collect()
    assert sum(r["rows"] for r in cells) == 6 and sum(r["rows"] for r in cells if r["predicted"] == "") == 2


def test_missing_keys_are_groups(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "a"), (None, 3, "b"), ("s", 1, "a")], "source string, position int, value string")
    assert dedup.dedup_adjacent(rows, "value", "source", "position").count() == 3
    numbered = {r["source"]: r["label"] for r in features.label_index(rows, "source").collect()}
    assert numbered == {None: 0, "s": 1}
    tokens = rows.select("source", F.array_repeat(F.lit(1), F.col("position")).alias("tokens"))
    assert sorted(len(r["tokens"]) for r in features.collate_tokens(tokens, "source", "tokens", 0).collect()) == [1, 3, 3, 3]


@pytest.mark.parametrize("values, std", [([0.1] * 7, 0.0), ([1e8 + 1, 1e8 + 2, 1e8 + 3], 0.816496580927726)])
def test_moments_of_large_and_equal_values(spark, values, std):
    rows = spark.createDataFrame([([v],) for v in values], "vector array<double>")
    got = metrics.vector_moments(rows, "vector").first()
    assert got["n"] == len(values) and got["std"] == pytest.approx(std, abs=1e-12)
