"""The preparation plans end to end."""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio.checks.registry import KEY, ORDER, check, joined, kept
from scansio.checks.sampling import STANZA_SPLIT, _quotas
from scansio.operators import sampling
from scansio.plans import prepare, sequences
from scansio.session import stage

_H = "md5('42|' || lang || '|' || text)"


def _corpus(spark, folder, pattern="meter"):
    return fixtures.verses(spark, folder).select(
        "lang", *ORDER, F.col("raw").alias("text"), F.col(pattern).alias("meter"), "sota", "manually_checked",
        "source")


def _sides(spark, folder, pattern="meter"):
    pool = _corpus(spark, folder, pattern).filter("source = 'a'").drop("source", "sota")
    return pool, _corpus(spark, folder).filter("source = 'b'").drop("source")


def _first(where, pattern="meter"):
    return f"""SELECT * FROM (SELECT lang, text, sota, {pattern} AS meter, length({pattern}) AS length, doc_id, pos
        FROM verses WHERE {where})
        QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id, pos) = 1"""


@check("prepare_three_way", """SELECT lang, text, meter, CASE WHEN split = 'test' THEN sota END AS sota, split
    FROM three_way""")
def prepare_three_way(spark, folder):
    rows = _corpus(spark, folder).drop("manually_checked", "source")
    return prepare.prepare_three_way(rows, ORDER).select("lang", "text", "meter", "sota", "split")


_HELD = f"SELECT * FROM ({_first("source = 'b' AND manually_checked")}) WHERE length = 11"
_FREE = f"""SELECT * FROM ({_first("source = 'a' AND manually_checked")}) p WHERE length = 11
    AND NOT EXISTS (SELECT 1 FROM ({_HELD}) h WHERE h.lang = p.lang AND h.text = p.text)"""


@check("prepare_against_test", f"""SELECT lang, text, meter, sota, 'test' AS split FROM ({_HELD})
    UNION ALL SELECT lang, text, meter, NULL,
        CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE)) THEN 'dev' ELSE 'train' END FROM (
        SELECT *, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS rn FROM ({_FREE}))""")
def prepare_against_test(spark, folder):
    pool, test = _sides(spark, folder)
    rows = prepare.prepare_against_test(pool.withColumn("sota", F.lit(None).cast("string")), test, ORDER)
    return rows.select("lang", "text", "meter", "sota", "split")


_OUTSIDE = f"""SELECT * FROM ({_first("source = 'b'")}) WHERE length BETWEEN 4 AND 12"""
_CAPPED = f"""SELECT * FROM ({_first("source = 'a' AND manually_checked", "translate(raw_pattern, '|()', '')")}) p
    WHERE length BETWEEN 4 AND 12 AND meter <> 'irregular'
    AND NOT EXISTS (SELECT 1 FROM ({_OUTSIDE}) o WHERE o.lang = p.lang AND o.text = p.text)
    QUALIFY row_number() OVER (PARTITION BY lang, meter ORDER BY {_H}) <= 5"""
_GOALS = f"""SELECT lang, (p + t - goal) // 2 AS dev, (p + t - goal) // 2 + goal - p AS moved FROM (
    SELECT lang, p, t, floor(CAST(p + t AS DOUBLE) * CAST(0.7 AS DOUBLE))::BIGINT AS goal FROM (
    SELECT lang, sum(p)::BIGINT AS p, sum(t)::BIGINT AS t FROM (
    SELECT lang, 1 AS p, 0 AS t FROM ({_CAPPED}) UNION ALL SELECT lang, 0, 1 FROM ({_OUTSIDE})) GROUP BY lang))"""
_ALL = f"""SELECT lang, text, meter, length, NULL AS sota, 'pool' AS part FROM ({_CAPPED}) UNION ALL
    SELECT e.lang, e.text, e.meter, e.length, e.sota, CASE WHEN row_number() OVER (PARTITION BY e.lang
        ORDER BY md5('42|' || e.lang || '|' || e.text)) <= g.moved THEN 'moved' ELSE 'test' END
    FROM ({_OUTSIDE}) e JOIN ({_GOALS}) g ON g.lang = e.lang"""
_SHARES = _quotas(
    f"""SELECT r.lang, r.length, count(*) AS n, any_value(g.dev) AS wanted FROM ({_ALL}) r
        JOIN ({_GOALS}) g ON g.lang = r.lang WHERE r.part <> 'test' GROUP BY r.lang, r.length""",
    "PARTITION BY lang", "length", "wanted")


@check("prepare_rebalanced", f"""SELECT lang, text, meter, sota, 'test' AS split FROM ({_ALL}) WHERE part = 'test'
    UNION ALL SELECT r.lang, r.text, r.meter, NULL, CASE WHEN row_number() OVER (PARTITION BY r.lang, r.length
        ORDER BY md5('42|' || r.lang || '|' || r.text)) <= q.quota THEN 'dev' ELSE 'train' END
    FROM ({_ALL}) r JOIN ({_SHARES}) q ON q.lang = r.lang AND q.length = r.length WHERE r.part <> 'test'""")
def prepare_rebalanced(spark, folder):
    """The cap is 5 because patterns of the stand-in corpora rarely repeat 300 times."""
    pool, test = _sides(spark, folder, "raw_pattern")
    rows = prepare.prepare_rebalanced(pool, test.drop("manually_checked"), ORDER, cap=5)
    return rows.select("lang", "text", "meter", "sota", "split")


_NGRAM_TEST = f"""SELECT * FROM ({_first("source = 'b'")}) WHERE length BETWEEN 5 AND 11"""


@check("prepare_ngram", f"""SELECT lang, text, meter, 'own' AS kind, CASE WHEN rn <= ceil(CAST(n AS DOUBLE)
        * CAST(0.15 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM (
        SELECT *, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS rn FROM firsts WHERE length BETWEEN 5 AND 11)
    UNION ALL SELECT lang, text, meter, 'given', 'test' FROM ({_NGRAM_TEST})
    UNION ALL SELECT lang, text, meter, 'given', 'train' FROM (
        {_first("source = 'a'", "translate(raw_pattern, '|()', '')")}) p WHERE length BETWEEN 5 AND 11
        AND NOT EXISTS (SELECT 1 FROM ({_NGRAM_TEST}) t WHERE t.lang = p.lang AND t.text = p.text)""")
def prepare_ngram(spark, folder):
    columns = ["lang", "text", "meter", "split"]
    # the corpus is made once for all three of its readings
    made = stage(fixtures.verses(spark, folder).select(
        "lang", *ORDER, F.col("raw").alias("text"), "meter", F.col("raw_pattern").alias("marked"), "sota", "source"), "corpus")
    own = prepare.prepare_ngram(made.drop("source", "marked"), ORDER)
    pool = made.filter("source = 'a'").withColumn("meter", F.col("marked")).drop("source", "sota", "marked")
    test = made.filter("source = 'b'").drop("source", "marked")
    given = prepare.prepare_ngram(pool, ORDER, test)
    return own.select(*columns, F.lit("own").alias("kind")).unionByName(
        given.select(*columns, F.lit("given").alias("kind")))


@check("prepare_stanzas", f"""SELECT s.stanza_id, s.stanza, s.split, c.label FROM ({STANZA_SPLIT}) s JOIN (
    SELECT stanza, (row_number() OVER (ORDER BY stanza) - 1)::INTEGER AS label FROM
    (SELECT DISTINCT stanza FROM labelled_stanzas)) c ON c.stanza = s.stanza""")
def prepare_stanzas(spark, folder):
    rows = prepare.prepare_stanzas(fixtures.stanzas(spark, folder), "stanza_id")
    return rows.select("stanza_id", "stanza", "split", "label")


_WORDS = """SELECT lang, text, split, doc_id, pos, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (
    SELECT *, list_filter(string_split(translate(lower(text),
        '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '),
        lambda w: w <> '') AS ws FROM three_way)"""
_RANKS = f"""SELECT word, row_number() OVER (ORDER BY n DESC, seen)::INTEGER AS idx FROM (
    SELECT word, count(*) AS n, min(row(doc_id, pos, place)) AS seen FROM ({_WORDS}) WHERE split = 'train'
    GROUP BY word) QUALIFY row_number() OVER (ORDER BY n DESC, seen) <= 1729"""
_POSITIONS = ", ".join(f"CAST(substr(t.meter, {i}, 1) = '+' AS DOUBLE) AS pos{i}" for i in range(1, 12))


@check("sequence_frame", f"""SELECT t.lang, t.text, t.split, {_POSITIONS}, array_to_string(
    CASE WHEN len(s.seq) > 24 THEN s.seq[len(s.seq) - 23:]
    ELSE list_concat(s.seq, list_transform(range(24 - len(s.seq)), lambda i: 0)) END, ',') AS sequence
    FROM three_way t JOIN (
        SELECT k.lang, k.text, coalesce(list(r.idx ORDER BY w.place) FILTER (WHERE r.idx IS NOT NULL), []) AS seq
        FROM three_way k LEFT JOIN ({_WORDS}) w ON w.lang = k.lang AND w.text = k.text
        LEFT JOIN ({_RANKS}) r ON r.word = w.word GROUP BY k.lang, k.text) s
    ON s.lang = t.lang AND s.text = t.text""")
def sequence_frame(spark, folder):
    rows = stage(sampling.split_three_way(kept(spark, folder, "meter"), ["lang"], KEY), "prepared")
    frame = sequences.sequence_frame(rows, KEY, "doc_id", "pos", 11, max_features=1730)
    return frame.withColumn("sequence", joined("sequence")).drop("meter")
