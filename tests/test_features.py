import pytest
from pyspark.sql import functions as F

from scansio.operators import episodes, features, sampling
from tests.plans import plan_text


def lines(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc bigint, pos int, text string")


def test_vocabulary_order_and_size(spark):
    df = lines(spark, "b a", "a c b", "d").repartition(4)
    got = [(r.word, r["count"], r.idx) for r in features.vocabulary(df, "text", "doc", "pos").orderBy("idx").collect()]
    assert got == [("b", 2, 1), ("a", 2, 2), ("c", 1, 3), ("d", 1, 4)]
    assert features.vocabulary(df, "text", "doc", "pos", max_features=3).count() == 2


@pytest.mark.parametrize("sample, buckets", [(1, 1 << 18), (4, 64), (4, 1), (10**9, 64)])
def test_vocabulary_by_threshold_is_the_vocabulary(spark, sample, buckets):
    """Whatever the candidates and buckets: ties at the last place, a third of all words the same, many rare ones."""
    df = spark.range(3000).select(
        F.col("id").alias("doc"), F.lit(0).alias("pos"),
        F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 40), F.concat(F.lit("r"), F.col("id") % 1500))
        .alias("text")).unionByName(spark.createDataFrame([(2, 1, None), (3, 1, "")], "doc bigint, pos int, text string"))
    for features_ in (2, 30, 500, 5000):
        want = features.vocabulary(df, "text", "doc", "pos", features_).orderBy("idx").collect()
        got = features.vocabulary_by_threshold(df, "text", "doc", "pos", features_, sample, buckets)
        assert got.orderBy("idx").collect() == want
    assert features.vocabulary_by_threshold(df.limit(0), "text", "doc", "pos").count() == 0


def test_rare_words_stay_out_of_the_shuffle(spark):
    """100,000 words that occur once or twice: none of their buckets reaches the threshold."""
    df = spark.range(100_000).select(
        F.col("id").alias("doc"), F.lit(0).alias("pos"),
        F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 20), F.concat(F.lit("r"), "id")).alias("text"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written(work):
        before = store.executorSummary("driver").totalShuffleWrite()
        rows = work(df, "text", "doc", "pos", 11).collect()
        return rows, store.executorSummary("driver").totalShuffleWrite() - before

    want, plain = written(features.vocabulary)
    got, cut = written(lambda *a: features.vocabulary_by_threshold(*a, buckets=1 << 10))
    assert sorted(got) == sorted(want) and cut < plain / 4


def test_first_seen_orders_wide_ids(spark):
    rows = spark.createDataFrame(
        [(2**62, 2**31 - 1, 5), (2**62, 2**31 - 1, 4), (2**62 - 1, 0, 9)], "d bigint, p int, i int")
    ordered = rows.orderBy(features.first_seen("d", "p", "i")).collect()
    assert [r.i for r in ordered] == [9, 4, 5]


def test_encode_and_pad(spark):
    df = lines(spark, "b a zz b", "zz", "")
    vocab = features.vocabulary(lines(spark, "a b", "b"), "text", "doc", "pos")
    got = features.encode_tokens(df, ["doc", "pos"], "text", vocab)
    padded = got.withColumn("p", features.pad_tokens("sequence", 2)).orderBy("doc").collect()
    assert [r.sequence for r in padded] == [[1, 2, 1], [], []]
    assert [r.p for r in padded] == [[2, 1], [0, 0], [0, 0]]


def test_lower_case_fallback_and_drawn_vectors(spark):
    vocab = spark.createDataFrame([("Sol", 1), ("mar", 2), ("luz", 3)], "word string, idx int")
    vectors = spark.createDataFrame([("sol", [1.0, 3.0]), ("mar", [2.0, 2.0]), ("otro", [4.0, 0.0])],
                                    "word string, vector array<float>")
    got = {r.word: r.vector for r in features.vector_lookup(vocab, vectors).collect()}
    assert got == {"Sol": [1.0, 3.0], "mar": [2.0, 2.0], "luz": None}
    matrix = features.embedding_matrix(vocab, vectors)
    first, again = matrix.orderBy("idx").collect(), matrix.orderBy("idx").collect()
    assert first == again and [len(r.vector) for r in first] == [2, 2, 2]
    assert [r.known for r in first] == [True, True, False]


def test_drawn_vectors_are_normal(spark):
    z = features.gaussian(F.lit(2.0), F.lit(0.5), F.col("id"))
    row = spark.range(20000).agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s")).first()
    assert abs(row.m - 2.0) < 0.02 and abs(row.s - 0.5) < 0.02


def test_collate(spark):
    df = spark.createDataFrame([(0, [5, 6, 2]), (0, [7, 2]), (1, [2])], "b int, t array<int>")

    def got(**kw):
        return sorted((r.b, r.t) for r in features.collate_tokens(df, "b", "t", 1, **kw).collect())

    assert got() == [(0, [5, 6, 2]), (0, [7, 2, 1]), (1, [2])]
    assert got(left_pad=True) == [(0, [1, 7, 2]), (0, [5, 6, 2]), (1, [2])]
    assert got(eos=2, move_eos_to_beginning=True) == [(0, [2, 5, 6]), (0, [2, 7, 1]), (1, [2])]
    with pytest.raises(Exception, match="end marker"):
        got(eos=9, move_eos_to_beginning=True)


def pool(spark, n=400):
    label = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 8)
    return spark.range(n).select("id", label.cast("int").alias("label"))


@pytest.mark.parametrize("cell_rows", [1_000_000, 5])
def test_rows_are_indexed_per_class(spark, cell_rows):
    got = episodes.index_rows(pool(spark), "label", "id", cell_rows=cell_rows).collect()
    by_label = {}
    for r in sorted(got, key=lambda r: r.place):
        by_label.setdefault(r.label, []).append(r)
    from tests.test_sampling import digest
    for members in by_label.values():
        assert [r.place for r in members] == list(range(len(members)))
        assert [r.id for r in members] == sorted((r.id for r in members), key=digest)


def test_episodes_have_distinct_rows(spark):
    df = pool(spark)
    parts = sampling.class_partition(df, "label", {"train": 4}, "test")
    tasks = spark.range(50).withColumnRenamed("id", "episode")
    rows = episodes.episode_rows(df, tasks, parts, "label", "id", ways=3, shots=4, queries=2)
    for r in rows.groupBy("episode", "part").agg(
            F.count_distinct("label").alias("classes"), F.count_distinct("slot").alias("slots"),
            F.count_distinct("id").alias("rows"), F.count_if(F.col("role") == "query").alias("queries")).collect():
        assert (r.classes, r.slots, r.rows, r.queries) == (3, 3, 18, 6)
    with pytest.raises(ValueError, match="fewer than 9 classes"):
        episodes.episode_rows(df, tasks, parts, "label", "id", ways=9, shots=1)


def test_episodes_of_many_classes(spark):
    """A task draws a few numbers, whatever the number of classes; every class is drawn now and then."""
    classes = spark.range(10_000).select(F.col("id").alias("label"), F.lit("train").alias("part"), F.lit(9).alias("size"))
    tasks = spark.range(20_000).withColumnRenamed("id", "episode")
    draws = episodes.draw_episodes(tasks, classes, "label", ways=5, shots=1, queries=1).cache()
    assert "array_sort" not in plan_text(draws) and "collect_list" not in plan_text(draws)
    each = draws.groupBy("episode").agg(F.count_distinct("label").alias("labels"), F.count_distinct("slot").alias("slots"))
    assert each.filter("labels = 5 and slots = 5").count() == 20_000
    assert draws.select("label").distinct().count() > 9_900
    few = episodes.draw_episodes(tasks.limit(50), classes.limit(5), "label", ways=5, shots=1)
    assert few.groupBy("episode").agg(F.count_distinct("label").alias("n")).filter("n = 5").count() == 50


def test_centroids_find_separated_classes(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 5).cast("int").alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(
            i == F.col("id") % 5, 1.0 + F.col("id") / 1000).otherwise(0.01)).alias("v"))
    parts = sampling.class_partition(df, "label", {"train": 5}, "test")
    rows = episodes.episode_rows(df, spark.range(20).withColumnRenamed("id", "episode"), parts, "label", "id", 4, 3)
    scores = episodes.centroid_scores(rows.withColumnRenamed("id", "row_key"), "v", 4)
    assert scores.count() == 80 and scores.filter("slot <> predicted").count() == 0
    summary = episodes.episode_summary(episodes.episode_accuracy(scores), 8).first()
    assert (summary.iterations, summary.first_accuracy, summary.best_accuracy) == (3, 1.0, 1.0)


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    assert sorted((r.c, r.label) for r in features.label_index(df, "c").collect()) == [("a", 0), ("b", 1), ("b", 1)]
