"""Projections and scalar functions."""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio import schema as S
from scansio.checks.registry import check, joined, kept
from scansio.functions import meter as M
from scansio.functions import text as X
from scansio.operators import filters, runs


@check("clean_text", "SELECT doc_id, pos, text FROM verses")
def clean_text(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", X.clean_text("raw").alias("text"))


@check("clean_text_lower", "SELECT doc_id, pos, lower(text) AS text FROM verses")
def clean_text_lower(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", X.clean_text_lower("raw").alias("text"))


@check("clean_label", "SELECT stanza_id, stanza FROM labelled_stanzas")
def clean_label(spark, folder):
    return fixtures.stanzas(spark, folder).select("stanza_id", X.clean_label("stanza").alias("stanza"))


@check("strip_marks", "SELECT doc_id, pos, translate(raw_pattern, '|()', '') AS meter FROM verses")
def strip_marks(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", M.strip_marks("raw_pattern").alias("meter"))


@check("meter_length", "SELECT doc_id, pos, length(meter)::INTEGER AS length FROM verses")
def meter_length(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", M.meter_length("meter").alias("length"))


@check("encode_meter", """SELECT doc_id, pos,
    array_to_string(list_transform(range(1, 13), lambda i: (substr(meter, i, 1) = '+')::INTEGER), ',') AS labels12,
    array_to_string(list_transform(range(1, 12), lambda i: (substr(meter, i, 1) = '+')::INTEGER), ',') AS labels11
    FROM verses""")
def encode_meter(spark, folder):
    return fixtures.verses(spark, folder).select(
        "doc_id", "pos", joined(M.encode_meter("meter", 12)).alias("labels12"),
        joined(M.encode_meter("meter", 11)).alias("labels11"))


@check("decode_meter", "SELECT doc_id, pos, rpad(substr(meter, 1, 12), 12, '-') AS meter FROM verses")
def decode_meter(spark, folder):
    return fixtures.verses(spark, folder).select(
        "doc_id", "pos", M.decode_meter(M.encode_meter("meter")).alias("meter"))


_PLACES = "list_filter(range(0, length(meter)), lambda i: substr(meter, i + 1, 1) = '+')"


@check("stress_index", f"SELECT doc_id, pos, array_to_string({_PLACES}, ',') AS places FROM verses")
def stress_index(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", joined(M.stress_index("meter")).alias("places"))


@check("stress_labels", f"""SELECT doc_id, pos,
    array_to_string(list_transform({_PLACES}, lambda i: '__label__syll-' || (i + 1)), ' ') AS labels FROM verses""")
def stress_labels(spark, folder):
    return fixtures.verses(spark, folder).select(
        "doc_id", "pos", joined(M.stress_labels("meter"), " ").alias("labels"))


@check("stress_text", f"""SELECT doc_id, pos,
    array_to_string(list_transform({_PLACES}, lambda i: i + 1), ', ') AS target FROM verses""")
def stress_text(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", M.stress_text("meter").alias("target"))


@check("fit_to_gold", """SELECT doc_id, pos, substr(rpad(substr(pred, 1, 12), 12, '-'), 1, length) AS pred
    FROM verses""")
def fit_to_gold(spark, folder):
    predicted = M.decode_meter(M.encode_meter("pred"))
    return fixtures.verses(spark, folder).select("doc_id", "pos", M.fit_to_gold(predicted, "length").alias("pred"))


@check("canonical", "SELECT 'po-emo' AS corpus, lang, raw AS text, meter, sota FROM verses")
def canonical(spark, folder):
    rows = fixtures.verses(spark, folder).select(
        "lang", F.col("raw").alias("verse"), F.col("meter").alias("annotated_pattern"),
        F.col("sota").alias("metricalizer_pattern"))
    return rows.withColumnsRenamed(S.PO_EMO.renames).select(
        F.lit(S.PO_EMO.name).alias("corpus"), "lang", "text", "meter", "sota")


_POS = ", ".join(f"CAST(substr(meter, {i}, 1) = '+' AS DOUBLE) AS pos{i}" for i in range(1, 13))


@check("widen_fixed", f"SELECT doc_id, pos, {_POS} FROM verses")
def widen_fixed(spark, folder):
    rows = fixtures.verses(spark, folder).select("doc_id", "pos", M.encode_meter("meter").alias("labels"))
    return M.widen(rows, "labels", 12)


@check("widen_from_data", f"SELECT doc_id, pos, {_POS} FROM verses WHERE length BETWEEN 4 AND 12")
def widen_from_data(spark, folder):
    rows = filters.keep_lengths(fixtures.verses(spark, folder)).select("doc_id", "pos", "meter")
    return M.widen_from_data(rows, "meter").drop("meter")


@check("seq2seq_frame", f"""SELECT 'scansion' AS prefix, text AS input_text, 'scansion: ' || text AS predict,
    array_to_string(list_transform({_PLACES}, lambda i: i + 1), ', ') AS target_text FROM kept""")
def seq2seq_frame(spark, folder):
    return filters.seq2seq_frame(kept(spark, folder, "meter"))


@check("squeeze_line", """SELECT doc_id, pos, trim(regexp_replace(value, '[ \\t]+', ' ', 'g')) AS value
    FROM raw_lines""")
def squeeze_line(spark, folder):
    return fixtures.raw_lines(spark, folder).select("doc_id", "pos", X.squeeze_line("value").alias("value"))


@check("run_name", """SELECT doc_id, 'verse-' || lang || '-' || source || '-' || lang || '-' || source AS run
    FROM documents""")
def run_name(spark, folder):
    model = F.concat("lang", F.lit("/"), "source")
    return fixtures.table(spark, folder, "documents").select(
        "doc_id", runs.run_name(F.lit("verse"), "lang", "source", model).alias("run"))


@check("parse_runs", """SELECT doc_id, model_type, model_name, run_lang FROM documents,
    (VALUES ('bert'), ('roberta')) m(model_type), (VALUES ('own'), ('es')) l(kind),
    LATERAL (SELECT CASE WHEN model_type = 'bert' THEN source || '/base' ELSE source || '-large' END AS model_name,
             CASE WHEN kind = 'own' THEN lower(lang) ELSE 'es' END AS run_lang)""")
def parse_runs(spark, folder):
    spec = F.concat(F.lit("bert, "), "source", F.lit("/base ; roberta,"), "source", F.lit("-large"))
    rows = fixtures.table(spark, folder, "documents").select(
        "doc_id", spec.alias("models"), F.concat(F.upper("lang"), F.lit(", Es")).alias("langs"))
    return runs.parse_langs(runs.parse_models(rows, "models"), "langs").select(
        "doc_id", "model_type", "model_name", "run_lang")


@check("parse_langs_ext", "SELECT doc_id, lang, doc_id % 3 = 0 AS extra FROM documents")
def parse_langs_ext(spark, folder):
    token = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("G"), "lang")).otherwise(F.col("lang"))
    lang, extra = runs.lang_token(token)
    return fixtures.table(spark, folder, "documents").select("doc_id", lang.alias("lang"), extra.alias("extra"))


@check("run_params", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 32 END AS batch_size,
    CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS accumulation FROM documents""")
def run_params(spark, folder):
    model = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-large").otherwise("-base"))
    return fixtures.table(spark, folder, "documents").select(
        "doc_id", runs.batch_size(model).alias("batch_size"),
        runs.accumulation_steps(model).alias("accumulation"))


@check("drop_baseline", """SELECT lang, text, CASE WHEN source = 'b' THEN sota END AS sota FROM kept""")
def drop_baseline(spark, folder):
    rows = kept(spark, folder, "sota", "source").withColumn(
        "split", F.when(F.col("source") == "b", "test").otherwise("train"))
    return filters.drop_baseline(rows).select("lang", "text", "sota")


@check("tokenise", """SELECT doc_id, pos, array_to_string(list_filter(string_split(translate(lower(text),
    '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '), lambda w: w <> ''), ' ')
    AS tokens FROM verses""")
def tokenise(spark, folder):
    return fixtures.verses(spark, folder).select("doc_id", "pos", joined(X.tokenise("text"), " ").alias("tokens"))


@check("threshold_labels", """SELECT doc_id, pos, array_to_string(list_transform(list_filter(
    range(1, len(scores) + 1), lambda i: scores[i] >= 0.5), lambda i: '__label__syll-' || i), ' ') AS labels
    FROM verses""")
def threshold_labels(spark, folder):
    return fixtures.verses(spark, folder).select(
        "doc_id", "pos", joined(M.threshold_labels("scores"), " ").alias("labels"))
