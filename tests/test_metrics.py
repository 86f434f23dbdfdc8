import collections
import random
import string

import pytest
from pyspark.sql import functions as F

from scansio.operators import metrics, runs
from scansio.plans import evaluate


def scores(spark, rows, **measures):
    df = spark.createDataFrame(rows, "gold string, pred string")
    return df.agg(*[m.alias(n) for n, m in measures.items()]).first().asDict()


def test_published_ratios(spark):
    """Whole counts over the published test sizes."""
    for hits, size, ratio in ((1412, 1520, 0.9289473684210526), (174, 406, 0.42857142857142855),
                              (75, 167, 0.4491017964071856)):
        df = spark.range(size).select(F.lit("+").alias("g"), F.when(F.col("id") < hits, "+").alias("p"))
        assert df.agg(metrics.exact_match("g", "p")).first()[0] == pytest.approx(ratio, abs=1e-15)


def test_pool_is_the_sum_of_its_parts(spark):
    parts = {"es": (1056, 1401), "en": (350, 934), "ge": (33, 152)}
    df = None
    for lang, (hits, size) in parts.items():
        part = spark.range(size).select(F.lit(lang).alias("lang"), F.lit("+").alias("meter"),
                                        F.when(F.col("id") < hits, "+").otherwise("-").alias("pred"))
        df = part if df is None else df.unionByName(part)
    got = {r.lang: r.accuracy for r in metrics.pooled_match(df, "meter", "pred").collect()}
    assert got[None] == pytest.approx(0.5786087655810213) and got["ge"] == pytest.approx(0.21710526315789475)
    table = {(r.lang, r.model): (r.rows, r.accuracy) for r in evaluate.score(df, {"m": "pred"}).collect()}
    assert table[(None, "m")] == (2487, pytest.approx(0.5786087655810213))
    macro = metrics.macro_match(df, "meter", "pred").first()[0]
    assert macro == pytest.approx(sum(h / n for h, n in parts.values()) / 3)


def reference_f1(gold, pred):
    def tokens(s):
        s = "".join(c for c in s.lower() if c not in string.punctuation)
        return [w for w in s.split() if w not in ("a", "an", "the")]

    g, p = tokens(gold), tokens(pred)
    if not g or not p:
        return float(g == p)
    same = sum((collections.Counter(g) & collections.Counter(p)).values())
    return 2 * same / (len(g) + len(p)) if same else 0.0


def test_token_f1(spark):
    random.seed(1)
    words = ["1", "2,", "3", "the", "A", "an", "x."]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 6))),
             " ".join(random.choices(words, k=random.randint(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "gold string, pred string")
    for r in df.select("gold", "pred", metrics.token_f1("gold", "pred").alias("f1")).collect():
        assert r.f1 == pytest.approx(reference_f1(r.gold, r.pred)), (r.gold, r.pred)


def test_missing_predictions_are_wrong(spark):
    got = scores(spark, [("+", "+"), ("+", None), ("-", "+")], a=metrics.exact_match("gold", "pred"))
    assert got["a"] == pytest.approx(1 / 3)


def test_label_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], ["a"]), ([], [])], "g array<string>, p array<string>")
    row = df.agg(metrics.label_precision("g", "p"), metrics.label_recall("g", "p"),
                 metrics.label_set_match("g", "p")).first()
    assert tuple(row) == (1.0, pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_position_confusion_counts_missing_symbols(spark):
    df = spark.createDataFrame([("+-", "+"), ("+", "--")], "g string, p string")
    got = sorted(map(tuple, metrics.position_confusion(df, "g", "p").collect()))
    assert got == [(1, "+", "+", 1), (1, "+", "-", 1), (2, "-", "", 1)]


def test_candidates(spark):
    df = spark.createDataFrame([("1, 3", ["2", "1, 3"]), ("2", ["2", "4"])], "t string, c array<string>")
    row = df.agg(F.sum(metrics.any_hit("t", "c")), F.avg(metrics.top1_hit("t", "c"))).first()
    assert tuple(row) == (2.0, 0.5)


def test_moments(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<float>")
    row = metrics.vector_moments(df, "v").first()
    assert (row.n, row["mean"], row["std"]) == (4, 2.5, pytest.approx(1.25 ** 0.5))


def test_sweep_sizes(spark):
    assert [runs.grid(spark, runs.SWEEPS[s]).count() for s in ("multi", "multi_large", "en2", "es", "en", "de")] == [
        48, 48, 28, 4, 4, 4]
    for models, size in ((runs.MULTILINGUAL_MODELS, 28), (runs.RECURRENT_MODELS, 36)):
        assert runs.grid(spark, {"lang": runs.LANGUAGES, "model": models}).count() == size


def test_best_and_pending(spark):
    df = spark.createDataFrame([("es", 1, "a", 0.5), ("es", 2, "b", 0.7), ("es", 3, "c", 0.7), ("en", 4, "d", 0.1)],
                               "lang string, line int, model string, accuracy double")
    got = {r.lang: r.model for r in runs.best_run(df, ["lang"], "line").collect()}
    assert got == {"es": "b", "en": "d"}
    names = df.withColumnRenamed("model", "run")
    done = names.filter("run in ('a', 'd')")
    assert {r.run for r in runs.pending_runs(names, done).collect()} == {"b", "c"}
    assert runs.pending_runs(names, done, overwrite=True).count() == 4


def test_run_strings(spark):
    df = spark.createDataFrame([("bert, x/y ;roberta,z", "ES, multi")], "m string, l string")
    got = runs.parse_langs(runs.parse_models(df, "m"), "l").select("model_type", "model_name", "run_lang").collect()
    assert sorted(map(tuple, got)) == [("bert", "x/y", "es"), ("bert", "x/y", "multi"),
                                       ("roberta", "z", "es"), ("roberta", "z", "multi")]
    tokens = spark.createDataFrame([("ges",), ("es",), ("ge",), (" GIT ",)], "t string")
    lang, extra = runs.lang_token("t")
    assert [tuple(r) for r in tokens.select(lang, extra).collect()] == [
        ("es", True), ("es", False), ("ge", False), ("it", True)]
    name = runs.run_name(F.lit("t"), F.lit("es"), F.lit("bert"), F.lit("a/b"))
    assert spark.range(1).select(name).first()[0] == "t-es-bert-a-b"
