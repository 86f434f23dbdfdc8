"""Filters, joins, sets and run tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansio import fixtures
from scansio import schema as S
from scansio.checks.registry import KEY, ORDER, check, external, firsts, kept, pool, r6
from scansio.functions import meter as M
from scansio.functions import text as X
from scansio.operators import dedup, filters, joins, metrics, runs, sampling
from scansio.session import bounded
from scansio.sources import writers


@check("reviewed", "SELECT doc_id, pos FROM verses WHERE manually_checked")
def reviewed(spark, folder):
    return filters.reviewed(fixtures.verses(spark, folder)).select("doc_id", "pos")


@check("unreviewed", "SELECT doc_id, pos FROM verses WHERE NOT manually_checked")
def unreviewed(spark, folder):
    return filters.unreviewed(fixtures.verses(spark, folder)).select("doc_id", "pos")


@check("length_eq", "SELECT lang, text, meter FROM firsts WHERE length = 11")
def length_eq(spark, folder):
    return filters.keep_lengths(firsts(spark, folder, "meter"), S.SPANISH_LENGTHS).select("lang", "text", "meter")


@check("length_range", """SELECT lang, text, length, length BETWEEN 5 AND 11 AS older FROM firsts
    WHERE length BETWEEN 4 AND 12""")
def length_range(spark, folder):
    rows = filters.keep_lengths(firsts(spark, folder))
    return rows.select("lang", "text", "length", F.col("length").isin(list(S.NGRAM_VERSE_LENGTHS)).alias("older"))


@check("drop_irregular", """SELECT doc_id, pos, meter FROM (SELECT doc_id, pos,
    translate(raw_pattern, '|()', '') AS meter FROM verses) WHERE meter <> 'irregular'""")
def drop_irregular(spark, folder):
    rows = fixtures.verses(spark, folder).select("doc_id", "pos", M.strip_marks("raw_pattern").alias("meter"))
    return filters.drop_irregular(rows)


@check("drop_junk", "SELECT doc_id, pos, value FROM squeezed")
def drop_junk(spark, folder):
    rows = fixtures.raw_lines(spark, folder).withColumn("value", X.squeeze_line("value"))
    return filters.drop_junk(rows).select("doc_id", "pos", "value")


@check("select_lang", """SELECT lang, text, 'ge' AS wanted FROM kept WHERE lang = 'de'
    UNION ALL SELECT lang, text, 'multi' FROM kept""")
def select_lang(spark, folder):
    rows = kept(spark, folder).select("lang", "text")
    return filters.select_lang(rows, "ge").withColumn("wanted", F.lit("ge")).unionByName(
        filters.select_lang(rows, "multi").withColumn("wanted", F.lit("multi")))


@check("union_langs", "SELECT lang, text FROM kept")
def union_langs(spark, folder):
    rows = kept(spark, folder).select("lang", "text")
    spanish, english, german, french = (filters.select_lang(rows, x) for x in ("es", "en", "ge", "fr"))
    return spanish.unionByName(english).unionByName(german).unionByName(french)


@check("final_fit_rows", "SELECT lang, text FROM three_way WHERE split IN ('train', 'dev')")
def final_fit_rows(spark, folder):
    rows = sampling.split_three_way(kept(spark, folder), ["lang"], KEY)
    return filters.final_fit_rows(rows).select("lang", "text")


@check("dedup_first", "SELECT lang, text, doc_id, pos, meter FROM firsts")
def dedup_first(spark, folder):
    return firsts(spark, folder, "meter").select("lang", "text", "doc_id", "pos", "meter")


@check("dedup_adjacent", """SELECT doc_id, pos, raw FROM (SELECT *,
    lag(raw) OVER (PARTITION BY doc_id ORDER BY pos) AS previous FROM raws)
    WHERE previous IS NULL OR previous <> raw""")
def dedup_adjacent(spark, folder):
    pieces = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
    rows = fixtures.documents(spark, folder).select("doc_id", F.posexplode(pieces).alias("pos", "raw"))
    return dedup.dedup_adjacent(rows, "raw", "doc_id", "pos", block_rows=64)


@check("leak_anti_join", "SELECT lang, text, meter FROM pool")
def leak_anti_join(spark, folder):
    return pool(spark, folder, "meter").select("lang", "text", "meter")


@check("leak_stored", "SELECT lang, text, meter FROM pool")
def leak_stored(spark, folder):
    """The same against a test set that was stored, bucketed by the key."""
    held = spark.table(writers.write_held(external(spark, folder)))
    return pool(spark, folder, "meter", held=held).select("lang", "text", "meter")


@check("join_predictions", """SELECT lang, count(*) AS gold_rows,
    count(*) FILTER (WHERE length <= 12) AS scored_rows, count(*) FILTER (WHERE length > 12) AS unmatched_rows,
    round(avg(CASE WHEN length <= 12 AND pred = meter THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
    FROM verses GROUP BY lang""")
def join_predictions(spark, folder):
    verses = fixtures.verses(spark, folder)
    predictions = verses.filter("length <= 12").select(*ORDER, "pred")
    rows = joins.join_predictions(verses.select("lang", *ORDER, "meter"), predictions, ORDER)
    return rows.groupBy("lang").agg(
        F.count("*").alias("gold_rows"), F.count_if("scored").alias("scored_rows"),
        F.count_if(~F.col("scored")).alias("unmatched_rows"),
        r6(metrics.exact_match("meter", "pred")).alias("accuracy"))


_RUNS = """SELECT lang, m.model_name, e.epochs::INTEGER AS epochs, n AS train_rows,
    'verse-' || lang || '-' || replace(m.model_name, '/', '-') || '-' || e.epochs AS run
    FROM (SELECT lang, count(*) AS n FROM kept GROUP BY lang),
    (VALUES ('bert-base'), ('google/electra')) m(model_name), (VALUES (10), (100)) e(epochs)"""


def _runs(spark, folder):
    sizes = bounded(kept(spark, folder).groupBy("lang").agg(F.count("*").alias("train_rows")), "langs")
    rows = runs.expand_grid(sizes, {"model_name": ["bert-base", "google/electra"], "epochs": [10, 100]})
    name = runs.run_name(F.lit("verse"), "lang", "model_name", F.col("epochs").cast("string"))
    return rows.withColumn("run", name)


@check("grid", _RUNS)
def grid(spark, folder):
    return _runs(spark, folder)


_PUBLISHED = """(VALUES ('multi', 12), ('multi_large', 12), ('en2', 14), ('es', 4), ('en', 4), ('de', 4), ('tuned', 7),
    ('recurrent', 9)) s(sweep, runs)"""


@check("published_grids", f"""SELECT lang, sweep, runs::BIGINT AS runs, runs::BIGINT AS names, n AS train_rows
    FROM (SELECT lang, count(*) AS n FROM kept GROUP BY lang), {_PUBLISHED}""")
def published_grids(spark, folder):
    """The published sweeps on the languages of the tables, each run with its name."""
    sizes = bounded(kept(spark, folder).groupBy("lang").agg(F.count("*").alias("train_rows")), "langs")
    lists = {"tuned": runs.MULTILINGUAL_MODELS, "recurrent": runs.RECURRENT_MODELS}
    grids = {name: {k: v for k, v in grid.items() if k != "lang"} | runs.SWEEP_CONSTANTS
             for name, grid in runs.SWEEPS.items()} | {name: {"model_name": models} for name, models in lists.items()}
    parts = []
    for sweep, parameters in grids.items():
        rows = runs.expand_grid(sizes.withColumn("sweep", F.lit(sweep)), parameters)
        name = runs.run_name("sweep", "lang", *[F.col(p).cast("string") for p in parameters])
        parts.append(rows.select("lang", "sweep", "train_rows", name.alias("run")))
    return reduce(DataFrame.unionByName, parts).groupBy("lang", "sweep", "train_rows").agg(
        F.count("*").alias("runs"), F.count_distinct("run").alias("names"))


@check("pending_runs", f"""SELECT run, lang FROM ({_RUNS}) WHERE NOT (epochs = 10 AND train_rows >= 1400)""")
def pending_runs(spark, folder):
    rows = _runs(spark, folder)
    done = rows.filter("epochs = 10 AND train_rows >= 1400")
    return runs.pending_runs(rows, done).select("run", "lang")


@check("union_moved", """SELECT lang, text, sota, part FROM (
    SELECT lang, text, NULL AS sota, 'pool' AS part FROM pool UNION ALL
    SELECT lang, text, sota, 'external' FROM external)""")
def union_moved(spark, folder):
    rows = pool(spark, folder).select("lang", "text").withColumn("part", F.lit("pool"))
    moved = external(spark, folder, "sota").select("lang", "text", "sota").withColumn("part", F.lit("external"))
    return rows.unionByName(moved, allowMissingColumns=True)


@check("preview", "SELECT doc_id, pos, text, meter FROM verses ORDER BY doc_id, pos LIMIT 3")
def preview(spark, folder):
    return filters.preview(fixtures.verses(spark, folder).select(*ORDER, "text", "meter"), ORDER, 3)
