"""The registry, the shared frames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scansio import fixtures
from scansio.operators.dedup import dedup_first, remove_leakage
from scansio.operators.filters import keep_lengths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ["lang", "text"]
ORDER = ["doc_id", "pos"]

# The stand-in tables in SQL, in order of dependency.
WS = (r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def _pattern(test: str) -> str:
    return f"array_to_string(list_transform(words, lambda w: CASE WHEN {test} THEN '+' ELSE '-' END), '')"


_MODEL = "length(w) >= 5 AND NOT (length(w) = 5 AND right(w, 1) = 'e')"

TABLES: dict[str, str] = {
    "pieces": """SELECT doc_id, lang, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS parts
        FROM documents""",
    "raws": "SELECT doc_id, lang, unnest(parts) AS raw, unnest(range(len(parts)))::INTEGER AS pos FROM pieces",
    "cleaned": f"""SELECT *, trim(regexp_replace(translate(replace(translate(raw, '“”', ''), '//', ''),
        '«»,;.', ''), '{WS}', ' ', 'g')) AS text FROM raws""",
    "worded": "SELECT *, string_split(text, ' ') AS words FROM cleaned WHERE text <> ''",
    "patterned": f"""SELECT *, {_pattern('length(w) >= 5')} AS meter, {_pattern('length(w) >= 6')} AS sota,
        {_pattern(_MODEL)} AS pred,
        CASE WHEN doc_id % 10 < 4 THEN 'b' ELSE 'a' END AS source,
        doc_id % 7 <> 0 AS manually_checked,
        list_transform(words, lambda w: CAST((CASE WHEN {_MODEL} THEN 5 ELSE 0 END) + length(w) % 5 AS DOUBLE)
            / 10) AS scores FROM worded""",
    "verses": """SELECT *, length(meter)::INTEGER AS length,
        CASE WHEN (doc_id + pos) % 97 = 0 THEN 'irregular'
             ELSE '(' || substr(meter, 1, 2) || ')|' || substr(meter, 3) END AS raw_pattern,
        [sota, pred, CASE WHEN doc_id % 3 = 0 THEN meter ELSE pred END] AS all_predicted FROM patterned""",
    "firsts": """SELECT * FROM verses
        QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id, pos) = 1""",
    "kept": "SELECT * FROM firsts WHERE length BETWEEN 4 AND 12",
    "external": """SELECT * FROM (SELECT * FROM verses WHERE source = 'b'
        QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id, pos) = 1)
        WHERE length BETWEEN 4 AND 12""",
    "pool": """SELECT * FROM (SELECT * FROM verses WHERE source = 'a'
        QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id, pos) = 1) a
        WHERE length BETWEEN 4 AND 12
        AND NOT EXISTS (SELECT 1 FROM external e WHERE e.lang = a.lang AND e.text = a.text)""",
    "three_way": """SELECT *, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_dev THEN 'dev'
        ELSE 'train' END AS split FROM (
        SELECT *, ceil(CAST(n - n_test AS DOUBLE) * CAST(0.176 AS DOUBLE))::BIGINT AS n_dev FROM (
        SELECT *, ceil(CAST(n AS DOUBLE) * CAST(0.15 AS DOUBLE))::BIGINT AS n_test FROM (
        SELECT *, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || lang || '|' || text)) AS rn FROM kept)))""",
    "stanzas": """SELECT doc_id AS stanza_id, text, CASE WHEN doc_id % 50 = 0 THEN NULL
        WHEN doc_id % 50 = 1 THEN 'None' ELSE lang END AS stanza FROM documents""",
    "labelled_stanzas": """SELECT stanza_id, text, CASE WHEN stanza IS NULL OR stanza = 'None' THEN 'unknown'
        ELSE stanza END AS stanza FROM stanzas""",
    "line_lists": "SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents",
    "raw_lines": """SELECT doc_id, lang, unnest(parts) AS value, unnest(range(len(parts)))::INTEGER AS pos
        FROM line_lists""",
    "squeezed": """SELECT doc_id, lang, pos, value FROM (SELECT doc_id, lang, pos,
        trim(regexp_replace(value, '[ \\t]+', ' ', 'g')) AS value FROM raw_lines)
        WHERE NOT regexp_matches(value, '^[=*\\\\d \\t\\n\\x0b\\f\\r]*\\z')""",
    "uniq_lines": """SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY pos) AS previous
        FROM squeezed) WHERE previous IS NULL OR previous <> value""",
    "train_words": """SELECT doc_id, pos, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (
        SELECT doc_id, pos, list_filter(string_split(translate(lower(text),
            '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33)), ' '),
            lambda w: w <> '') AS ws FROM pool)""",
    "vocab": """SELECT word, n AS count, row_number() OVER (ORDER BY n DESC, d, p, i)::INTEGER AS idx FROM (
        SELECT word, count(*) AS n, min(row(doc_id, pos, place)) AS seen,
            min(row(doc_id, pos, place))[1] AS d, min(row(doc_id, pos, place))[2] AS p,
            min(row(doc_id, pos, place))[3] AS i FROM train_words GROUP BY word)
        QUALIFY row_number() OVER (ORDER BY n DESC, d, p, i) <= 9999""",
    "looked_up": """SELECT v.word, v.idx, e.embedding AS vector FROM vocab v
        LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = v.idx""",
}


def sql(body: str) -> str:
    """The statement with the tables it needs in front of it."""
    needed: list[str] = []
    text = body
    for name in reversed(list(TABLES)):
        if _mentions(text, name):
            needed.append(name)
            text += " " + TABLES[name]
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in reversed(needed))
    return f"WITH {ctes}\n{body}" if ctes else body


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(w == name and words[i - 1].upper() in ("FROM", "JOIN") for i, w in enumerate(words) if i)


def check(name: str, oracle: str | None = None):
    """Register a query, with the SQL it must agree with where SQL can say it."""
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return query
    return register


def joined(column: Column | str, separator: str = ",") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), separator)


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def firsts(spark: SparkSession, folder: str, *columns: str, where: str = "true") -> DataFrame:
    """First verse per language and text, with the given columns."""
    wanted = dict.fromkeys([*KEY, *ORDER, "length", *columns])
    return dedup_first(fixtures.verses(spark, folder).filter(where).select(*wanted), KEY, ORDER)


def kept(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return keep_lengths(firsts(spark, folder, *columns))


def external(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return keep_lengths(firsts(spark, folder, *columns, where="source = 'b'"))


def pool(spark: SparkSession, folder: str, *columns: str, held: DataFrame | None = None) -> DataFrame:
    """Lines of the first corpus that do not occur in the external test set, which may be given."""
    held = external(spark, folder) if held is None else held
    free = remove_leakage(firsts(spark, folder, *columns, where="source = 'a'"), held, KEY)
    return keep_lengths(free)
