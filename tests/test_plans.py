from pyspark.sql import functions as F

from scansio.plans import baseline, corpus, evaluate, prepare, sequences

SCHEMA = "lang string, text string, meter string, sota string, manually_checked boolean, line_id int"


def lines(spark, n=200, start=0, lang="es"):
    rows = [(lang, f"verso,  número {i}.", "+-" * 5 + "+", "+-" * 5 + "-+"[i % 2], i % 10 != 0, i)
            for i in range(start, start + n)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(df, split):
    return {r.text for r in df.filter(F.col("split") == split).collect()}


def test_against_test_set(spark):
    rows = prepare.prepare_against_test(lines(spark, 200), lines(spark, 60, 180), ["line_id"]).cache()
    train, dev, test = (texts(rows, s) for s in ("train", "dev", "test"))
    assert not (train & dev or train & test or dev & test)
    assert len(test) == 54 and len(train | dev) == 162 and len(dev) == 41
    assert "verso número 181" in test and "verso número 190" not in test
    assert rows.filter("split <> 'test' and sota is not null").count() == 0


def test_first_copy_decides_even_if_its_length_is_dropped(spark):
    rows = spark.createDataFrame(
        [("es", "a;", "+-", None, True, 1), ("es", "a", "+-+-", None, True, 2), ("es", "b", "+-+-", None, True, 3)],
        SCHEMA)
    got = prepare.prepare_three_way(rows, ["line_id"])
    assert [r.text for r in got.collect()] == ["b"]


def test_three_way_is_complete_and_repeatable(spark):
    df = lines(spark, 300).unionByName(lines(spark, 7, lang="en"))
    first = prepare.prepare_three_way(df, ["line_id"]).collect()
    again = prepare.prepare_three_way(df.repartition(5), ["line_id"]).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 307
    assert sum(r.split == "test" for r in first if r.lang == "en") == 2


def test_rebalanced_caps_and_moves(spark):
    marked = lines(spark, 400).withColumn(
        "meter", F.when(F.col("line_id") % 50 == 1, "irregular")
        .otherwise(F.concat(F.lit("(+)|"), F.substring("meter", 2, 7), (F.col("line_id") % 4).cast("string"))))
    held = lines(spark, 100, 380)
    rows = prepare.prepare_rebalanced(marked, held, ["line_id"], cap=20).cache()
    train, dev, test = (texts(rows, s) for s in ("train", "dev", "test"))
    total = 4 * 20 + 100
    assert len(train | dev | test) == total == len(train) + len(dev) + len(test)
    goal = int(total * 0.7)
    assert len(dev) == (total - goal) // 2 and len(test) == total - goal - len(dev)
    assert rows.filter("meter = 'irregular' or meter like '%(%'").count() == 0
    own = rows.filter("meter rlike '[0-3]$'").groupBy("meter").count().collect()
    assert {r["count"] for r in own} == {20}


def test_ngram_against_given_test(spark):
    rows = prepare.prepare_ngram(lines(spark, 50).drop("sota"), ["line_id"], lines(spark, 20, 40))
    assert rows.groupBy("split").count().orderBy("split").collect() == [("test", 20), ("train", 40)]


def test_stanzas(spark):
    df = spark.createDataFrame([(i, f"t {i}", [None, "None", "soneto"][i % 3]) for i in range(30)],
                               "id int, text string, stanza string")
    got = prepare.prepare_stanzas(df, "id").collect()
    assert {(r.stanza, r.label) for r in got} == {("soneto", 0), ("unknown", 1)}
    assert sum(r.split == "dev" for r in got) == 8


def test_raw_corpus(spark):
    values = ["  uno\t dos ", "====", "uno dos", "", "uno dos", "tres", "* *", "cuatro", "cinco"]
    df = spark.createDataFrame([("es", 0, i, v) for i, v in enumerate(values)],
                               "lang string, doc bigint, pos int, value string")
    got = corpus.lm_corpus(df, ["lang"], "doc", "pos").orderBy("pos").collect()
    assert [(r.value, r.split) for r in got] == [
        ("uno dos", "train"), ("tres", "train"), ("cuatro", "train"), ("cinco", "eval")]
    poems = spark.createDataFrame([("1", "a\nb")], "poem_id string, text string")
    assert [tuple(r) for r in corpus.poem_lines(poems).collect()] == [("1", 0, "a"), ("1", 1, "b")]


def test_predictions_are_cut_to_the_gold_length(spark):
    df = spark.createDataFrame([("es", "+-+", [1, 0, 1, 1], 3), ("es", "++", [1, 0], 2)],
                               "lang string, meter string, predicted array<int>, length int")
    scored = evaluate.decode_predictions(df, "predicted")
    assert sorted(r.pred for r in scored.collect()) == ["+-", "+-+"]
    table = evaluate.score(scored, {"m": "pred"}).collect()
    assert {(r.lang, r.rows, r.accuracy) for r in table} == {("es", 2, 0.5), (None, 2, 0.5)}


def test_sequences_use_the_train_vocabulary(spark):
    df = spark.createDataFrame(
        [("es", "sol mar", "+-", "train", 0, 0), ("es", "mar luz", "-+", "dev", 1, 0)],
        "lang string, text string, meter string, split string, doc bigint, pos int")
    frame = sequences.sequence_frame(df, ["lang", "text"], "doc", "pos", 3, max_length=4).orderBy("text").collect()
    assert [r.sequence for r in frame] == [[2, 0, 0, 0], [1, 2, 0, 0]]
    assert [(r.pos1, r.pos2, r.pos3) for r in frame] == [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]


def test_report_of_a_run(spark):
    df = spark.createDataFrame(
        [("es", "dev", "+-", "+-", None), ("es", "dev", "+-", None, None), ("es", "test", "+-", "+-", "--"),
         ("en", "test", "+-", "--", "+-"), ("es", "train", "+-", "+-", "+-")],
        "lang string, split string, meter string, pred string, sota string")
    got = {r.data_lang: tuple(r)[2:] for r in evaluate.run_report(df, "multi").collect()}
    assert got == {"es": (0.5, 1.0, 0.0), "en": (None, 0.0, 1.0)}


def test_ngram_baseline_end_to_end(spark):
    """A word decides both syllables; held-out lines get their label sets."""
    rows = spark.range(300).select(
        F.lit("es").alias("lang"), F.when(F.col("id") % 2 == 0, "+-").otherwise("-+").alias("meter"),
        F.concat(F.when(F.col("id") % 2 == 0, "sol w").otherwise("mar w"), F.col("id") % 13).alias("text"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    predictions = baseline.ngram_predictions(rows, [1, 2], buckets=1 << 10)
    report = baseline.ngram_report(predictions).first()
    assert report.samples == 60 and min(report.precision, report.recall, report.accuracy) >= 0.95


def test_files_of_a_folder_are_one_source(spark, tmp_path):
    """Lines of one language may lie in many files, and a line that repeats the last one of the file before goes."""
    from scansio.sources import readers
    for lang, parts in {"de": ["a\nb\n", "b\nc\n"], "en": ["x\n", "x\n", "y\n"]}.items():
        (tmp_path / f"lang={lang}").mkdir()
        for i, text in enumerate(parts):
            (tmp_path / f"lang={lang}" / f"part-{i:05}.txt").write_text(text)
    rows = corpus.numbered_lines(readers.read_raw_lines(spark, str(tmp_path)), folders=True)
    got = [(r.source, r.position, r.value) for r in rows.orderBy("source", "position").collect()]
    assert got == [(0, 0, "a"), (0, 1, "b"), (0, 2, "b"), (0, 3, "c"), (1, 0, "x"), (1, 1, "x"), (1, 2, "y")]
    assert sorted(r.value for r in corpus.lm_corpus(rows, [], "source", "position").collect()) == ["a", "b", "c", "x", "y"]


def test_corpus_is_made_once(spark, data, monkeypatch):
    from scansio import fixtures
    from scansio.checks import prepared
    calls, real = [], fixtures.verses
    monkeypatch.setattr(fixtures, "verses", lambda *a: calls.append(a) or real(*a))
    assert prepared.prepare_ngram(spark, data).count() and len(calls) == 1
