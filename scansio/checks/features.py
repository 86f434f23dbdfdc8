"""Vocabulary, sequences, lookups and padded batches."""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio.checks.registry import KEY, ORDER, check, joined, kept, pool, r6
from scansio.functions.text import clean_label
from scansio.operators import features
from scansio.operators.metrics import vector_moments
from scansio.session import stage


def _vocabulary(spark, folder):
    return features.vocabulary(pool(spark, folder), "text", "doc_id", "pos")


@check("label_index", """SELECT s.stanza_id, s.stanza, c.label FROM labelled_stanzas s JOIN (
    SELECT stanza, (row_number() OVER (ORDER BY stanza) - 1)::INTEGER AS label FROM
    (SELECT DISTINCT stanza FROM labelled_stanzas)) c ON c.stanza = s.stanza""")
def label_index(spark, folder):
    rows = fixtures.stanzas(spark, folder).withColumn("stanza", clean_label("stanza"))
    return features.label_index(rows, "stanza").select("stanza_id", "stanza", "label")


@check("vocab_rank", "SELECT word, count, idx FROM vocab")
def vocab_rank(spark, folder):
    return _vocabulary(spark, folder)


@check("vocab_threshold", "SELECT word, count, idx FROM vocab")
def vocab_threshold(spark, folder):
    """The same vocabulary, with a threshold that keeps rare words out of the shuffle."""
    lines = stage(pool(spark, folder).select("doc_id", "pos", "text"), "lines")
    return features.vocabulary_by_threshold(lines, "text", "doc_id", "pos")


_ENCODED = """SELECT k.lang, k.text, coalesce(list(v.idx ORDER BY w.place) FILTER (WHERE v.idx IS NOT NULL), [])
    AS seq FROM kept k
    LEFT JOIN (SELECT lang, text, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (
        SELECT lang, text, list_filter(string_split(translate(lower(text),
            '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '),
            lambda w: w <> '') AS ws FROM kept)) w ON w.lang = k.lang AND w.text = k.text
    LEFT JOIN vocab v ON v.word = w.word GROUP BY k.lang, k.text"""


def _encoded(spark, folder):
    return features.encode_tokens(kept(spark, folder), KEY, "text", _vocabulary(spark, folder), partitioned=True)


@check("encode_tokens", f"SELECT lang, text, array_to_string(seq, ',') AS sequence FROM ({_ENCODED})")
def encode_tokens(spark, folder):
    return _encoded(spark, folder).select("lang", "text", joined("sequence").alias("sequence"))


@check("pad_tokens", f"""SELECT lang, text, array_to_string(CASE WHEN len(seq) > 24 THEN seq[len(seq) - 23:]
    ELSE list_concat(seq, list_transform(range(24 - len(seq)), lambda i: 0)) END, ',') AS padded,
    array_to_string(CASE WHEN len(seq) > 4 THEN seq[len(seq) - 3:]
    ELSE list_concat(seq, list_transform(range(4 - len(seq)), lambda i: 0)) END, ',') AS padded4
    FROM ({_ENCODED})""")
def pad_tokens(spark, folder):
    return _encoded(spark, folder).select(
        "lang", "text", joined(features.pad_tokens("sequence")).alias("padded"),
        joined(features.pad_tokens("sequence", 4)).alias("padded4"))


def _lookup(spark, folder):
    vocab = _vocabulary(spark, folder)
    return features.vector_lookup(vocab, fixtures.vectors(spark, folder, vocab))


@check("vector_lookup", """SELECT word, idx, round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 6) AS total
    FROM looked_up""")
def vector_lookup(spark, folder):
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return _lookup(spark, folder).select("word", "idx", r6(total).alias("total"))


@check("vector_coverage", """SELECT count(*) AS words, count(vector) AS known,
    round(count(vector)::DOUBLE / count(*), 6) AS coverage FROM looked_up""")
def vector_coverage(spark, folder):
    return features.vector_coverage(_lookup(spark, folder)).withColumn("coverage", r6("coverage"))


@check("embedding_matrix", """SELECT word, idx, vector IS NOT NULL AS known,
    (SELECT max(len(vector)) FROM looked_up)::INTEGER AS width,
    round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 6) AS total, true AS plausible FROM looked_up""")
def embedding_matrix(spark, folder):
    """Known vectors as they are; drawn ones as wide, and within eight deviations of the mean of the table."""
    vocab = _vocabulary(spark, folder)
    vectors = fixtures.vectors(spark, folder, vocab)
    moments = vector_moments(vectors, "vector").first()
    matrix = features.embedding_matrix(vocab, vectors)
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = F.forall("vector", lambda x: F.abs(x - F.lit(moments["mean"])) <= F.lit(8 * moments["std"]))
    return matrix.select("word", "idx", "known", F.size("vector").alias("width"),
                         F.when(F.col("known"), r6(total)).alias("total"), (F.col("known") | near).alias("plausible"))


_ROWS = """SELECT doc_id, pos, list_concat(list_transform(words, lambda w: length(w)::INTEGER), [2]) AS t,
    max(len(words) + 1) OVER (PARTITION BY doc_id) AS width FROM verses"""
_FILL = "list_transform(range(width - len(t)), lambda i: 1)"


def _batches(spark, folder):
    rows = fixtures.verses(spark, folder)
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    return rows.select(*ORDER, F.concat(lengths, F.array(F.lit(2))).alias("tokens"))


@check("collate_right", f"""SELECT doc_id, pos, array_to_string(list_concat(t, {_FILL}), ',') AS tokens
    FROM ({_ROWS})""")
def collate_right(spark, folder):
    rows = features.collate_tokens(_batches(spark, folder), "doc_id", "tokens", 1)
    return rows.select("doc_id", "pos", joined("tokens").alias("tokens"))


@check("collate_left", f"""SELECT doc_id, pos, array_to_string(list_concat({_FILL}, t), ',') AS tokens
    FROM ({_ROWS})""")
def collate_left(spark, folder):
    rows = features.collate_tokens(_batches(spark, folder), "doc_id", "tokens", 1, left_pad=True)
    return rows.select("doc_id", "pos", joined("tokens").alias("tokens"))


@check("collate_eos", f"""SELECT doc_id, pos, array_to_string(list_concat(list_concat([2], t[1:len(t) - 1]), {_FILL}),
    ',') AS tokens FROM ({_ROWS})""")
def collate_eos(spark, folder):
    rows = features.collate_tokens(_batches(spark, folder), "doc_id", "tokens", 1, eos=2, move_eos_to_beginning=True)
    return rows.select("doc_id", "pos", joined("tokens").alias("tokens"))
