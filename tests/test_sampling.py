import hashlib
import math

import pytest
from pyspark.sql import functions as F

from scansio.operators import sampling as S
from scansio.session import stage
from tests.plans import plan_text


def digest(*key):
    return hashlib.md5("|".join(["42", *map(str, key)]).encode()).hexdigest()


def rows(spark, n, groups=("es",)):
    """A first group with most of the rows, the others with a few."""
    data = [(groups[0] if i % 3 else groups[i % len(groups)], f"t{i}", i % 9 + 4) for i in range(n)]
    return spark.createDataFrame(data, "lang string, text string, length int"), data


@pytest.mark.parametrize("total, parts", [(10131, (7095, 1516, 1520)), (1107, (774, 166, 167))])
def test_published_three_way_sizes(spark, total, parts):
    df = spark.range(total).select(F.lit("x").alias("lang"), F.col("id").cast("string").alias("text"))
    split = S.split_three_way(df, ["lang"], ["lang", "text"])
    got = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert (got["train"], got["dev"], got["test"]) == parts


def test_published_quarter(spark):
    df = spark.range(8745).select(F.lit("es").alias("lang"), F.col("id").cast("string").alias("text"))
    got = {r.split: r["count"] for r in S.split_exact(df, ["lang"], ["text"], 0.25).groupBy("split").count().collect()}
    assert got == {"train": 6558, "dev": 2187}


@pytest.mark.parametrize("leaf_rows", [1, 1_000_000])
def test_exact_split_takes_the_smallest_hashes(spark, leaf_rows):
    df, data = rows(spark, 700, ("es", "en", "de"))
    got = S.split_exact(df, ["lang"], ["lang", "text"], 0.3, leaf_rows=leaf_rows).collect()
    held = {(r.lang, r.text) for r in got if r.split == "dev"}
    want = set()
    for lang in ("es", "en", "de"):
        texts = sorted((t for g, t, _ in data if g == lang), key=lambda t: digest(lang, t))
        want |= {(lang, t) for t in texts[:math.ceil(len(texts) * 0.3)]}
    assert held == want and len(got) == 700


def test_stratified_quotas_are_largest_remainder(spark):
    counts = spark.createDataFrame([("x", "a", 5), ("x", "b", 5), ("x", "c", 1)], "g string, c string, n bigint")
    got = {r.c: r.dev for r in S.quotas(counts, ["g"], "c", F.lit(4), "dev").collect()}
    assert got == {"a": 2, "b": 2, "c": 0}


def test_stratified_split_sizes(spark):
    df, data = rows(spark, 900, ("es", "en"))
    sizes = spark.createDataFrame([("es", 101), ("en", 7)], "lang string, size bigint")
    split = S.split_stratified(df, ["lang"], "length", ["lang", "text"], sizes=sizes)
    got = {r.lang: r["count"] for r in split.filter("split = 'dev'").groupBy("lang").count().collect()}
    assert got == {"es": 101, "en": 7} and split.count() == 900
    part = split.groupBy("lang", "length").agg(F.count_if(F.col("split") == "dev").alias("d"), F.count("*").alias("n"))
    total = {"es": sum(d[0] == "es" for d in data), "en": sum(d[0] == "en" for d in data)}
    for r in part.collect():
        assert abs(r.d - r.n * got[r.lang] / total[r.lang]) < 1


def test_cap_keeps_the_first_in_draw_order(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("rare"), F.col("id") % 30)).otherwise("common").alias("meter"),
        F.col("id").cast("string").alias("text"))
    for salts in (1, 64):
        got = S.cap_per_group(df, ["meter"], ["text"], 25, salts=salts).collect()
        common = sorted((str(i) for i in range(3000) if i % 3), key=digest)[:25]
        assert {r.text for r in got if r.meter == "common"} == set(common)
        assert len(got) == 25 + 10 * 25


def test_published_rebalance(spark):
    """2,705 lines end as 1,893 / 406 / 406 whatever the two sides bring."""
    pool = spark.range(1771).select(F.lit("en").alias("lang"), F.concat(F.lit("p"), "id").alias("text"))
    test = spark.range(934).select(F.lit("en").alias("lang"), F.concat(F.lit("e"), "id").alias("text"))
    sizes = S.rebalance_sizes(pool, test, ["lang"])
    row = sizes.first()
    assert (row.train, row.dev, row.test, row.moved) == (1893, 406, 406, 528)
    parts = S.rebalance(pool, test, sizes, ["lang"], ["lang", "text"])
    got = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert got == {"pool": 1771, "moved": 528, "test": 406}


@pytest.mark.parametrize("leaf_rows", [1, 1_000_000])
def test_one_table_of_both_sides_gives_the_same_draw(spark, leaf_rows):
    """Parts and dev rows are those of sizes, moves and a stratified draw taken one after the other; a group is missing."""
    pool, test = (spark.range(n).select(
        F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"),
        F.concat(F.lit(name), "id").alias("text"), (F.col("id") % 4).alias("length")) for name, n in (("p", 400), ("e", 300)))
    sizes = S.rebalance_sizes(pool, test, ["lang"])
    parts = S.rebalance(pool, test, sizes, ["lang"], ["lang", "text"]).cache()
    fit = S.split_stratified(parts.filter("part <> 'test'"), ["lang"], "length", ["lang", "text"],
                             sizes=sizes.select("lang", F.col("dev").alias("size")))
    want = {(r.text, r.part, r.split) for r in fit.collect()} | {
        (r.text, r.part, "test") for r in parts.filter("part = 'test'").collect()}
    got = S.rebalanced(pool, test, ["lang"], ["lang", "text"], "length", leaf_rows=leaf_rows)
    assert got.columns == ["lang", "text", "length", "part", "split"]
    assert {(r.text, r.part, r.split) for r in got.collect()} == want and got.count() == 700


def test_rebalanced_reads_few_times(spark):
    """Both sides are written once with their draw order; the steps one after the other write them three times."""
    pool, test = (stage(spark.range(n).select(F.lit("en").alias("lang"), F.concat(F.lit(name), "id").alias("text"),
                                              (F.col("id") % 4).alias("length")), "side") for name, n in (("p", 400), ("e", 300)))

    def jobs(group, work):
        spark.sparkContext.setJobGroup(group, group)
        work().collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    def one_by_one():
        sizes = stage(S.rebalance_sizes(pool, test, ["lang"]), "sizes")
        parts = S.rebalance(pool, test, sizes, ["lang"], ["text"])
        return S.split_stratified(parts.filter("part <> 'test'"), ["lang"], "length", ["text"],
                                  sizes=sizes.select("lang", F.col("dev").alias("size")))

    assert jobs("joint", lambda: S.rebalanced(pool, test, ["lang"], ["text"], "length")) < jobs("apart", one_by_one)
    assert jobs("moves", lambda: S.rebalanced(pool, test, ["lang"], ["text"])) <= 10


def test_rebalanced_without_a_group_or_rows_to_move(spark):
    big = spark.range(1000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("text"))
    with pytest.raises(Exception, match="cannot supply"):
        S.rebalanced(big, big.limit(10), ["lang"], ["text"]).collect()
    got = S.rebalanced(big.limit(400), big, [], ["text"])
    goal = int(1400 * 0.7)
    dev = (1400 - goal) // 2
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == {
        "pool": 400, "moved": goal + dev - 400, "test": 1400 - goal - dev}
    assert S.rebalanced(big.limit(0), big.limit(0), ["lang"], ["text"], "text").count() == 0


def test_rebalance_needs_enough_test_rows(spark):
    big = spark.range(1000).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("text"))
    with pytest.raises(Exception, match="cannot supply"):
        S.rebalance_sizes(big, big.limit(10), ["lang"]).collect()


@pytest.mark.parametrize("leaf_rows", [1, 1_000_000])
def test_positional_split(spark, leaf_rows):
    data = [("es", d * 70_000, p) for d in range(5) for p in range(d + 1)] + [("en", 3, p) for p in range(7)]
    df = spark.createDataFrame(data, "lang string, doc bigint, pos int")
    got = S.split_positional(df, ["lang"], "doc", "pos", leaf_rows=leaf_rows).collect()
    for lang in ("es", "en"):
        ordered = sorted((r.doc, r.pos, r.split) for r in got if r.lang == lang)
        first = len(ordered) * 75 // 100
        assert [s for _, _, s in ordered] == ["train"] * first + ["eval"] * (len(ordered) - first)


def test_class_partition(spark):
    df = spark.createDataFrame([(i % 12,) for i in range(100)], "label int")
    got = S.class_partition(df, "label", {"train": 5, "validation": 4}, "test").collect()
    order = sorted(range(12), key=digest)
    assert [r.label for r in sorted(got, key=lambda r: r.class_rank)] == order
    assert [r.part for r in sorted(got, key=lambda r: r.class_rank)] == ["train"] * 5 + ["validation"] * 4 + ["test"] * 3


def test_missing_groups_and_empty_inputs(spark):
    df = spark.createDataFrame([(None, f"t{i}", 5) for i in range(8)] + [("es", "x", 5)],
                               "lang string, text string, length int")
    got = S.split_exact(df, ["lang"], ["lang", "text"], 0.25, leaf_rows=1).collect()
    assert sum(r.split == "dev" for r in got if r.lang is None) == 2 and len(got) == 9
    nothing = df.limit(0)
    assert S.split_exact(nothing, ["lang"], ["text"], 0.25).count() == 0
    assert S.split_stratified(nothing, [], "length", ["text"], 0.25).count() == 0


def test_classes_are_numbered_by_ranges(spark):
    """A million classes, none missing and none twice, without a window over one partition; missing values come first."""
    df = spark.range(1_000_000).select(F.concat(F.lit("c"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(1_000_000)).cast("string"), 7, "0")).alias("c"))
    got = S.number_rows(df, ["c"], "n")
    assert "Window" not in plan_text(got)
    wrong = got.filter("n <> cast(substr(c, 2) as bigint)").count()
    assert wrong == 0 and got.count() == 1_000_000
    small = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    assert sorted(S.number_rows(small, ["c"], "n", 5).collect(), key=lambda r: r["n"]) == [(None, 5), ("a", 6), ("b", 7)]
    assert S.number_rows(small.limit(0), ["c"], "n").count() == 0
