"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansio.llm import (
    bpe, chat, lexical, licenses, negatives, neighbours, packing, quality, repeats, simhash, tokens, topk, urls,
)
from scansio.llm.common import bound_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

RULES = (
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither their path nor their folder has it, and bound their batches."""
    bound_batches(spark)
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if root in known or getattr(context, "_scansio_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="scansio-"), "scansio.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "scansio")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._scansio_shipped = True


def query(name: str, oracle: str | None = None):
    def register(work):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return work(spark, folder)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_digests(documents(spark, folder), JSON, PATTERN, added=True)


@query("op2_license_scans", licenses.scan_sql())
def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


@query("op3_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, folder), RANKS, PATTERN)


@query("op4_topk_search", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, rank, vec_id, score FROM (SELECT *,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    WHERE rank <= 20""")
def topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digests(documents(spark, folder), table(spark, folder, "labels", "doc_id", "quality"))


@query("op6_bpe_codec")
def bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), RANKS, PATTERN)


@query("op7_embedding_dedup", """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        AND list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION
        SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN least ON least.a = e.vec_id
    LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id""")
def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op8_simhash_dedup")
def simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digests(documents(spark, folder))


@query("op9_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(documents(spark, folder))


@query("op10_url_filters", """WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
    split AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
    ruled AS (SELECT *, '.' || host AS dotted FROM split)
    SELECT page_id, host, path,
        CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
             WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
             WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
             WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
             WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
        CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""")
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages", "page_id", "url"), RULES)


@query("op11_hard_negatives", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id
            ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, folder, "embeddings", "vec_id", "label", "embedding").withColumn("label", moved))


@query("op12_ranked_search", lexical.RANK_SQL)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.rank(documents(spark, folder), table(spark, folder, "benchmark", "item_id", "text"))


@query("op13_chat_format", chat.digests_sql(f"SELECT conv_id, turn, role, text FROM conversations UNION ALL {chat.smuggled()}"))
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    more = spark.sql(f"SELECT * FROM ({chat.smuggled()}) AS t(conv_id, turn, role, text)").to(turns.schema)
    return chat.digests(chat.text_parts(turns.unionByName(more)))
