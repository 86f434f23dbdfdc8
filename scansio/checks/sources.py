"""Readers and writers: each query writes to the shared folder and reads back."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio import fixtures
from scansio import schema as S
from scansio.checks.prepared import _ALL as ALL, _FREE as FREE, _H as DRAW, _HELD as HELD, _SHARES as SHARES
from scansio.checks.registry import KEY, check, joined, kept, pool, r6
from scansio.functions.text import clean_text
from scansio.operators import features, filters, metrics, sampling
from scansio.operators.dedup import dedup_first
from scansio.plans import corpus, prepare
from scansio.session import bounded, new_path, shuffles_deleted, stage, staging
from scansio.sources import readers, writers


def _write_objects(objects, path):
    """One JSON value per file, each built from a bounded number of documents."""
    objects.write.partitionBy("bucket").text(path, lineSep="\n")


def _annotated(spark, folder):
    return fixtures.verses(spark, folder).select(
        "doc_id", "pos", F.col("raw").alias("line_text"), F.col("raw_pattern").alias("metrical_pattern"),
        "manually_checked")


@check("src_json", "SELECT raw AS line_text, raw_pattern AS metrical_pattern, manually_checked FROM verses")
def src_json(spark, folder):
    path = new_path(spark, "annotated")
    line = F.struct(*S.ANNOTATED_LINE.names)
    arrays = (_annotated(spark, folder).withColumn("bucket", F.floor(F.col("doc_id") / 100))
              .groupBy("bucket").agg(F.to_json(F.collect_list(line)).alias("value")))
    _write_objects(arrays, path)
    return readers.read_lines(spark, path).select(*S.ANNOTATED_LINE.names)


#: Bytes of one large file.
FILE_BYTES = 256 << 20


def _large_files(rows, order, path, ends, comma=","):
    """JSON texts (value) as files of one JSON value each, in order; the stand-in of files that grew large elsewhere.

    One file up to ``FILE_BYTES``, then one for each range of that size, which is what a task writes.  What is
    staged and shuffled for that goes when the files are written.
    """
    def framed(batches):
        begun = False
        for batch in batches:
            if batch.num_rows:
                before = [comma] * batch.num_rows
                before[0] = comma if begun else ends[0]
                begun = True
                yield pa.RecordBatch.from_arrays(
                    [pc.binary_join_element_wise(pa.array(before), batch.column(0).cast(pa.string()), "")], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([ends[1]])], ["value"])

    spark = rows.sparkSession
    with staging(spark), shuffles_deleted(spark):
        held = stage(rows, "values")
        total = held.agg(F.sum(F.octet_length("value") + 2)).first()[0] or 0
        (held.repartitionByRange(max(1, -(-total // FILE_BYTES)), *order).sortWithinPartitions(*order).select("value")
         .mapInArrow(framed, "value string").write.text(path, lineSep="\n"))


@check("src_json_split", "SELECT raw AS line_text, raw_pattern AS metrical_pattern, manually_checked FROM verses")
def src_json_split(spark, folder):
    """All lines in one array, or in several large ones, read in as many tasks as the files have blocks."""
    path = new_path(spark, "array")
    lines = _annotated(spark, folder).select("doc_id", "pos", F.to_json(F.struct(*S.ANNOTATED_LINE.names)).alias("value"))
    _large_files(lines, ["doc_id", "pos"], path, "[]")
    return readers.read_lines(spark, path, split=True).select(*S.ANNOTATED_LINE.names)


@check("src_poem_map_split", "SELECT doc_id::VARCHAR AS poem_id, md5(text) AS digest FROM documents WHERE doc_id % 20 <> 0")
def src_poem_map_split(spark, folder):
    """All poems in one object, or in several large ones, null ones among them."""
    path = new_path(spark, "poems")
    poem = F.when(F.col("doc_id") % 20 != 0, F.to_json(F.struct("text"))).otherwise("null")
    poems = fixtures.documents(spark, folder).select("doc_id", F.concat(F.lit('"'), "doc_id", F.lit('": '), poem).alias("value"))
    _large_files(poems, ["doc_id"], path, "{}")
    return readers.read_poem_map(spark, path, split=True).select("poem_id", F.md5("text").alias("digest"))


@check("src_csv", """SELECT lang, text, meter, sota FROM verses
    QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id, pos) = 1""")
def src_csv(spark, folder):
    path = new_path(spark, "metrical")
    rows = fixtures.verses(spark, folder).select(
        F.col("raw").alias("verse"), F.col("meter").alias("annotated_pattern"),
        F.col("sota").alias("metricalizer_pattern"), "lang")
    rows.write.partitionBy("lang").csv(path, header=True, **writers.CSV)
    table = readers.read_table(spark, path, T.StructType([*S.PO_EMO.schema, T.StructField("lang", T.StringType())])).withColumnsRenamed(S.PO_EMO.renames)
    cleaned = table.withColumn("text", clean_text("text"))
    return dedup_first(cleaned, KEY, [readers.ORDER]).select("lang", "text", "meter", "sota")


@check("src_stanzas", "SELECT text, CASE WHEN stanza IS NULL OR stanza = 'None' THEN NULL ELSE stanza END AS stanza "
       "FROM stanzas")
def src_stanzas(spark, folder):
    path = new_path(spark, "stanzas")
    rows = fixtures.stanzas(spark, folder).select(
        F.col("text").alias("Stanza_text"), F.nullif("stanza", F.lit("None")).alias("ST_Correct"))
    rows.write.csv(path, header=True, **writers.CSV)
    return readers.read_corpus(spark, path, S.STANZAS).select("text", "stanza")


def _three_way(spark, folder):
    rows = kept(spark, folder, "meter", "sota")
    return filters.drop_baseline(sampling.split_three_way(rows, ["lang"], KEY)).select(*S.SPLIT_ROW.names)


_SPLITS = """SELECT text, meter, CASE WHEN split = 'test' THEN sota END AS sota, length, lang, split FROM three_way"""


@check("src_splits", f"SELECT * FROM ({_SPLITS}) WHERE lang IN ('es', 'de')")
def src_splits(spark, folder):
    path = new_path(spark, "splits")
    writers.write_splits(_three_way(spark, folder), path)
    return readers.read_splits(spark, path, ["es", "de"])


@check("files_to_splits", f"SELECT * FROM ({_SPLITS}) WHERE lang = 'de'")
def files_to_splits(spark, folder):
    """Corpus files with columns of their own in another order, read, prepared, written and read again."""
    raw, splits = new_path(spark, "corpus"), new_path(spark, "splits")
    (fixtures.verses(spark, folder).filter("lang = 'de'")
     .select(F.col("sota").alias("metricalizer_pattern"), F.col("pos").alias("stanza"), F.col("raw").alias("verse"),
             F.lit("x, y").alias("note"), F.col("meter").alias("annotated_pattern"))
     .write.csv(raw, header=True, **writers.CSV))
    corpus_rows = readers.read_corpus(spark, raw, S.PO_EMO)
    writers.write_splits(prepare.prepare_three_way(corpus_rows, order=[readers.ORDER]), splits)
    return readers.read_splits(spark, splits)


def _annotated_files(spark, folder, where, pattern):
    """JSON arrays of annotated lines, in the order of documents."""
    path = new_path(spark, "annotated")
    line = F.struct("doc_id", "pos", F.lit("x").alias("note"), F.col("manually_checked"),
                    F.col(pattern).alias("metrical_pattern"), F.col("raw").alias("line_text"))
    arrays = (fixtures.verses(spark, folder).filter(where)
              .withColumn("bucket", F.lpad(F.floor(F.col("doc_id") / 100).cast("string"), 12, "0"))
              .groupBy("bucket").agg(F.to_json(F.array_sort(F.collect_list(line))).alias("value")))
    _write_objects(arrays, path)
    return path


@check("files_to_splits_es", f"""SELECT text, meter, NULL::VARCHAR AS sota, length::INTEGER AS length, lang, split FROM (
    SELECT text, meter, length, lang, 'test' AS split FROM ({HELD}) UNION ALL SELECT text, meter, length, lang,
        CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE)) THEN 'dev' ELSE 'train' END FROM (
        SELECT *, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY {DRAW}) AS rn FROM ({FREE}))) WHERE lang = 'es'""")
def files_to_splits_es(spark, folder):
    """Spanish: two JSON corpora, the second one a given test set."""
    splits = new_path(spark, "splits")
    pool, test = (readers.read_corpus(spark, _annotated_files(spark, folder, f"lang = 'es' and source = '{s}'", "meter"), S.ADSO)
                  for s in "ab")
    writers.write_splits(prepare.prepare_against_test(pool, test, [readers.ORDER]), splits)
    return readers.read_splits(spark, splits, ["es"])


@check("files_to_splits_en", f"""SELECT text, meter, sota, length::INTEGER AS length, lang, split FROM (
    SELECT lang, text, meter, sota, length, 'test' AS split FROM ({ALL}) WHERE part = 'test'
    UNION ALL SELECT r.lang, r.text, r.meter, NULL, r.length, CASE WHEN row_number() OVER (PARTITION BY r.lang, r.length
        ORDER BY md5('42|' || r.lang || '|' || r.text)) <= q.quota THEN 'dev' ELSE 'train' END
    FROM ({ALL}) r JOIN ({SHARES}) q ON q.lang = r.lang AND q.length = r.length WHERE r.part <> 'test') WHERE lang = 'en'""")
def files_to_splits_en(spark, folder):
    """English: a JSON corpus of marked patterns, topped up from a delimited test set with columns in another order."""
    outside, splits = new_path(spark, "outside"), new_path(spark, "splits")
    (fixtures.verses(spark, folder).filter("lang = 'en' and source = 'b'")
     .select(F.col("sota").alias("prosodic_meter"), F.lit("x, y").alias("note"), F.col("meter"), F.col("raw").alias("text"))
     .write.csv(outside, header=True, **writers.CSV))
    pool = readers.read_corpus(spark, _annotated_files(spark, folder, "lang = 'en' and source = 'a'", "raw_pattern"), S.ECPA)
    test = readers.read_corpus(spark, outside, S.FOUR_B_FOUR_V)
    writers.write_splits(prepare.prepare_rebalanced(pool, test, [readers.ORDER], cap=5), splits)
    return readers.read_splits(spark, splits, ["en"])


@check("files_to_scores", """SELECT split, count(*) AS rows,
    round(avg(coalesce((sota = meter)::INTEGER::DOUBLE, 0)), 6) AS accuracy
    FROM (SELECT text, meter, CASE WHEN split = 'test' THEN sota END AS sota, split FROM three_way WHERE lang = 'de')
    GROUP BY split""")
def files_to_scores(spark, folder):
    """The accuracy of the shipped baseline, from files; train and dev have none."""
    return files_to_splits(spark, folder).groupBy("split").agg(
        F.count("*").alias("rows"), r6(metrics.exact_match("meter", "sota")).alias("accuracy"))


@check("lm_from_files", """SELECT value, CASE WHEN rn <= n * 75 // 100 THEN 'train' ELSE 'eval' END AS split
    FROM (SELECT value, count(*) OVER () AS n, row_number() OVER (ORDER BY lang, doc_id, pos) AS rn
    FROM (SELECT *, lag(value) OVER (PARTITION BY lang ORDER BY doc_id, pos) AS previous FROM squeezed)
    WHERE previous IS NULL OR previous <> value)""")
def lm_from_files(spark, folder):
    """Raw files, a folder of them for each language, to text for a language model, all lines one group."""
    raw, out = new_path(spark, "raw"), new_path(spark, "lm")
    rows = fixtures.raw_lines(spark, folder)
    total = fixtures.documents(spark, folder).agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    (rows.repartitionByRange(files, "lang", "doc_id", "pos").sortWithinPartitions("lang", "doc_id", "pos")
     .select("value", "lang").write.partitionBy("lang").text(raw, lineSep="\n"))
    lines = corpus.numbered_lines(readers.read_raw_lines(spark, raw), folders=True)
    writers.write_lm_text(corpus.lm_corpus(lines, [], "source", "position"), out)
    return spark.read.schema("value string, split string").text(out, lineSep="\n")


@check("sink_splits", _SPLITS)
def sink_splits(spark, folder):
    path = new_path(spark, "splits")
    writers.write_splits(_three_way(spark, folder), path, "parquet")
    return spark.read.schema(S.SPLIT_ROW).parquet(path)


@check("src_poem_map", "SELECT doc_id::VARCHAR AS poem_id, md5(text) AS digest FROM documents WHERE doc_id % 20 <> 0")
def src_poem_map(spark, folder):
    path = new_path(spark, "poems")
    poem = F.when(F.col("doc_id") % 20 != 0, F.struct("text"))
    entry = F.struct(F.col("doc_id").cast("string").alias("key"), poem.alias("value"))
    objects = (fixtures.documents(spark, folder).withColumn("bucket", F.floor(F.col("doc_id") / 100))
               .groupBy("bucket").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")))
    _write_objects(objects, path)
    return readers.read_poem_map(spark, path).select("poem_id", F.md5("text").alias("digest"))


@check("src_text", "SELECT value, true AS extra FROM raw_lines UNION ALL "
       "SELECT value, false FROM raw_lines WHERE doc_id % 10 >= 4")
def src_text(spark, folder):
    main, more = new_path(spark, "raw"), new_path(spark, "extra")
    lines = fixtures.raw_lines(spark, folder)
    lines.filter("doc_id % 10 >= 4").select("value").write.text(main, lineSep="\n", compression="gzip")
    lines.filter("doc_id % 10 < 4").select("value").write.text(more, lineSep="\n")
    return readers.read_raw_lines(spark, main, more).select("value", F.lit(True).alias("extra")).unionByName(
        readers.read_raw_lines(spark, main).select("value", F.lit(False).alias("extra")))


@check("src_vectors", """SELECT word, round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 6) AS total,
    len(vector)::INTEGER AS size FROM looked_up WHERE vector IS NOT NULL""")
def src_vectors(spark, folder):
    """A header, an outdated copy of every word, then the words."""
    path = new_path(spark, "vectors")
    vocab = features.vocabulary(pool(spark, folder), "text", "doc_id", "pos")
    words = fixtures.vectors(spark, folder, vocab)
    old = F.transform("vector", lambda x: F.lit(0.0).cast("float"))

    def line(vector):
        return F.concat_ws(" ", "word", joined(vector, " ")).alias("value")

    header = words.agg(F.concat_ws(" ", F.count("*"), F.max(F.size("vector"))).alias("value"))
    lines = (header.select(F.lit(0).alias("turn"), "value")
             .unionByName(words.select(F.lit(1).alias("turn"), line(old)))
             .unionByName(words.select(F.lit(2).alias("turn"), line("vector"))))
    (lines.repartitionByRange(3, "turn").sortWithinPartitions("turn").select("value")
     .write.text(path, lineSep="\n"))
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return readers.read_vectors(spark, path).select("word", r6(total).alias("total"), F.size("vector").alias("size"))


_LABELS = ("array_to_string(list_transform(list_filter(range(0, length(meter)), "
           "lambda i: substr(meter, i + 1, 1) = '+'), lambda i: '__label__syll-' || (i + 1)), ' ')")


@check("sink_labelled", f"SELECT {_LABELS} || ' ' || text AS value FROM kept")
def sink_labelled(spark, folder):
    path = new_path(spark, "labelled")
    writers.write_labelled(kept(spark, folder, "meter"), path)
    return spark.read.text(path, lineSep="\n")


_SORTED = ("array_to_string(list_sort(list_transform(list_filter(range(0, length(meter)), "
           "lambda i: substr(meter, i + 1, 1) = '+'), lambda i: '__label__syll-' || (i + 1))), ' ')")


@check("src_labelled", f"SELECT text, {_SORTED} AS labels FROM kept")
def src_labelled(spark, folder):
    path = new_path(spark, "labelled")
    writers.write_labelled(kept(spark, folder, "meter"), path)
    return readers.read_labelled(spark, path).select("text", joined("labels", " ").alias("labels"))


@check("sink_reviewed", """SELECT raw AS line_text, NULL AS metrical_pattern FROM verses WHERE NOT manually_checked
    UNION ALL SELECT raw, raw_pattern FROM (SELECT *, lag(raw || chr(10) || raw_pattern)
        OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM verses WHERE manually_checked)
    WHERE previous IS NULL OR previous <> raw || chr(10) || raw_pattern""")
def sink_reviewed(spark, folder):
    lines, pairs = new_path(spark, "lines"), new_path(spark, "pairs")
    writers.write_reviewed(_annotated(spark, folder), lines, pairs, "doc_id", "pos")
    text = spark.read.text(lines, lineSep="\n").select(
        F.col("value").alias("line_text"), F.lit(None).cast("string").alias("metrical_pattern"))
    return text.unionByName(spark.read.schema("line_text string, metrical_pattern string").csv(
        pairs, quote='"', escape='"'))


@check("sink_lm_text", """SELECT value, split FROM (SELECT value, CASE WHEN rn <= n * 75 // 100 THEN 'train'
    ELSE 'eval' END AS split FROM (SELECT value, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS rn FROM uniq_lines))""")
def sink_lm_text(spark, folder):
    path = new_path(spark, "lm")
    writers.write_lm_text(corpus.lm_corpus(fixtures.raw_lines(spark, folder), ["lang"], "doc_id", "pos"), path)
    return spark.read.schema("value string, split string").text(path, lineSep="\n")


@check("sink_predictions", """SELECT text, meter AS truth, array_to_string(all_predicted, '|') AS candidates
    FROM kept""")
def sink_predictions(spark, folder):
    path = new_path(spark, "predictions")
    rows = kept(spark, folder, "meter", "all_predicted").select(
        "text", F.col("meter").alias("truth"), F.col("all_predicted").alias("candidates"))
    writers.write_predictions(rows, path)
    back = spark.read.schema("text string, truth string, candidates array<string>").json(path)
    return back.withColumn("candidates", joined("candidates", "|"))


_METRICS = """SELECT lang, round(avg((pred = meter)::INTEGER::DOUBLE), 6) AS model,
    round(avg((sota = meter)::INTEGER::DOUBLE), 6) AS baseline FROM kept GROUP BY lang"""


def _metrics(spark, folder):
    return kept(spark, folder, "meter", "pred", "sota").groupBy("lang").agg(
        r6(metrics.exact_match("meter", "pred")).alias("model"),
        r6(metrics.exact_match("meter", "sota")).alias("baseline"))


@check("sink_metrics", f"""SELECT lang AS run, 'model' AS measure, model AS value FROM ({_METRICS})
    UNION ALL SELECT lang, 'baseline', baseline FROM ({_METRICS})""")
def sink_metrics(spark, folder):
    path = new_path(spark, "metrics")
    long = _metrics(spark, folder).unpivot("lang", ["model", "baseline"], "measure", "value")
    writers.write_metrics(long.withColumnRenamed("lang", "run"), path)
    return spark.read.schema("run string, measure string, value double").json(path)


@check("src_run_log", f"""SELECT lang AS model_lang, lang AS data_lang, 'accuracy' AS measure, 'own/model' AS model,
    model AS accuracy FROM ({_METRICS}) UNION ALL
    SELECT 'multi', 'multi', 'accuracy', 'own/model', model FROM ({_METRICS}) UNION ALL
    SELECT lang, lang, 'test', 'own/model', model FROM ({_METRICS}) UNION ALL
    SELECT lang, lang, 'sota', NULL, baseline FROM ({_METRICS})""")
def src_run_log(spark, folder):
    path = new_path(spark, "log")
    scores = bounded(_metrics(spark, folder), "scores")
    own = F.concat("lang", F.lit(":"), "lang")

    def line(label, keys, value, end=" (own/model)"):
        return F.concat(F.lit(f"- {label} ["), keys, F.lit("]: "), F.col(value).cast("string"), F.lit(end))

    lines = scores.select(F.explode(F.array(
        F.lit("# heading"), line("Accuracy", own, "model"), line("Accuracy", F.lit("multi"), "model"), F.lit(""),
        line("Accuracy TEST", own, "model"), line("SOTA", own, "baseline", ""))).alias("value"))
    lines.write.text(path, lineSep="\n")
    return readers.read_run_log(spark, path).drop(readers.ORDER)
