import itertools
import random

from scansio.operators import dedup


def test_first_row_wins_whatever_the_partitioning(spark):
    rows = [("t%d" % (i % 7), i, "m%d" % i) for i in range(500)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "text string, id int, meter string").repartition(9)
    got = {r.text: (r.id, r.meter) for r in dedup.dedup_first(df, ["text"], ["id"]).collect()}
    assert got == {f"t{k}": (k, f"m{k}") for k in range(7)}


def test_leakage(spark):
    train = spark.createDataFrame([("es", "a"), ("es", "b"), ("en", "a")], "lang string, text string")
    test = spark.createDataFrame([("es", "a")], "lang string, text string")
    got = dedup.remove_leakage(train, test, ["lang", "text"]).collect()
    assert sorted(map(tuple, got)) == [("en", "a"), ("es", "b")]


def test_adjacent_repeats_across_blocks(spark):
    random.seed(5)
    for block in (1, 2, 3, 7, 1000):
        rows, want = [], []
        for source in range(3):
            places = sorted(random.sample(range(60), 40))
            values = [random.choice(["a", "b", None]) for _ in places]
            rows += [(source, p, v) for p, v in zip(places, values)]
            runs = [list(g) for _, g in itertools.groupby(zip(places, values), key=lambda x: x[1])]
            want += [(source, *run[0]) for run in runs]
        df = spark.createDataFrame(rows, "src int, pos int, value string")
        got = dedup.dedup_adjacent(df, "value", "src", "pos", block_rows=block).collect()
        assert sorted((r.src, r.pos) for r in got) == sorted((s, p) for s, p, _ in want), block


def test_stored_test_set_does_not_move(spark, tmp_path):
    """Leakage against a bucketed table shuffles the train side alone, and finds what a plain anti-join finds."""
    from scansio.sources import writers
    from tests.plans import plan_text

    rows = spark.range(1000).selectExpr("if(id % 3 = 0, 'es', 'en') as lang", "concat('t', id % 400) as text", "id")
    name = writers.write_held(rows.filter("id % 2 = 0").select("lang", "text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        free = dedup.remove_leakage(rows, spark.table(name), ["lang", "text"])
        text = plan_text(free)
        assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
        assert sorted(free.collect()) == sorted(dedup.remove_leakage(rows, rows.filter("id % 2 = 0"), ["lang", "text"]).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_adjacent_repeats_scan_once(spark, tmp_path):
    """One shuffle of the rows, used twice; edges of blocks are found in any size of block."""
    from tests.plans import plan_text

    spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 2) as source", "id as position", "nullif(floor(id / 7) % 5, 0) as value").write.parquet(f"{tmp_path}/r")
    rows = spark.read.parquet(f"{tmp_path}/r")
    want = None
    for block in (1, 2, 3, 100, 1 << 20):
        got = sorted(map(tuple, dedup.dedup_adjacent(rows, "value", "source", "position", block).collect()), key=repr)
        want = want or got
        assert got == want and 0 < len(got) < 2000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(dedup.dedup_adjacent(rows, "value", "source", "position", 100))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
