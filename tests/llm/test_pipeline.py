"""The pipeline's stages, and the registered queries against SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from scansio.llm.queries import ORACLES, QUERIES
from scansio.session import stage
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, duck, data, name):
    problem = compare(spark, duck, data, name, QUERIES[name], ORACLES[name])
    assert problem is None


def test_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known and {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def odd(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source",
                                    "cast(null as bigint) as n_chars")
    none = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    names = {"row": F.lit("r"), "kept": F.lit(1), "tag": F.lit(2), "score": F.lit("s"), "quality_score": F.lit(0), "hash": F.lit("h")}
    return docs.unionByName(docs.limit(5)).unionByName(more).unionByName(none).withColumns(names)


def test_stages(spark, data):
    docs = stage(odd(spark, data), "odd")
    counts = [docs.count()]
    for name, work in corpus_pipeline.STAGES:
        out = stage(work(spark, docs, data), name)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            counts.append(out.count())
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_nothing(spark, data):
    docs = stage(odd(spark, data).limit(0), "nothing")
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, docs, data).count() == 0


def test_planted_copies_and_passages_go_through_all_stages(spark, data):
    """Exact copies leave one document, a passage of two documents stays in the first, clean documents stay whole."""
    clean = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").join(
        spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1"), "doc_id").select("doc_id", "text")
        .filter("length(text) between 1500 and 4000").orderBy("doc_id").limit(8).collect()]
    passage = " ".join(f"keeper{i * i} counted {i} boats" for i in range(60))
    texts = [*clean[:4], clean[0], clean[0], clean[4] + "\n" + passage, passage + "\n" + clean[5]]
    rows = [(900_000 + i, t, "en", "planted", len(t)) for i, t in enumerate(texts)]
    real = spark.read.parquet(f"{data}/documents.parquet")
    docs = stage(real.filter("doc_id < 0").unionByName(spark.createDataFrame(rows, real.schema)), "planted")
    monotone = [docs]
    for name, work in corpus_pipeline.STAGES[1:]:
        monotone.append(stage(work(spark, monotone[-1], data), name))
    kept = {r["doc_id"] - 900_000: r["text"] for r in monotone[2].collect()}
    assert sorted(kept) == [0, 1, 2, 3, 6, 7]
    assert kept[6] == texts[6][:len(kept[6])] and passage in kept[6] and passage[50:150] not in kept[7]
    assert clean[5][200:] in kept[7] and all(len(kept[i]) > 0.9 * len(texts[i]) for i in (1, 2, 3))
    packed = monotone[3].groupBy("doc_id").count().collect()
    assert sorted(r["doc_id"] - 900_000 for r in packed) == sorted(kept)
