import pytest

import __spark_entry__
from scansio.checks import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.plans import plan_text

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas",
                "FlatMapGroupsInArrow", "FlatMapCoGroupsInPandas", "FlatMapCoGroupsInArrow")
#: Fitted models and a user's predictor see rows in Python; nothing else does.
IN_PYTHON = ("batch_score", "few_shot_adapted", "few_shot_curve", "ngram_report", "ngram_vectors", "sweep_best")
PAIRWISE_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, data, name):
    """The rows are those of the SQL, and the plan neither pairs rows nor leaves the JVM."""
    df = QUERIES[name](spark, data)
    assert compare(spark, duck, data, name, lambda *_: df, ORACLES.get(name)) is None
    banned = PAIRWISE_NODES if name in IN_PYTHON else (*PAIRWISE_NODES, *PYTHON_NODES)
    assert not any(node in plan_text(df) for node in banned)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_leakage_reuses_the_partitioning(spark, data):
    """Both sides are shuffled once, by their de-duplication; the anti-join adds nothing."""
    text = plan_text(QUERIES["leak_anti_join"](spark, data))
    assert text.count("Exchange hashpartitioning(lang") == 2


def test_encoding_reuses_the_partitioning(spark, data):
    text = plan_text(QUERIES["encode_tokens"](spark, data))
    assert text.count("Exchange hashpartitioning(lang") == 1 and "BroadcastHashJoin" in text
    frame = plan_text(QUERIES["sequence_frame"](spark, data))
    assert frame.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in frame


def test_token_counts_are_hash_aggregated(spark, data):
    from scansio.checks.registry import pool
    from scansio.operators.features import token_counts

    text = plan_text(token_counts(pool(spark, data), "text", "doc_id", "pos"))
    assert "HashAggregate(keys=[word" in text and "SortAggregate(key=[word" not in text


def test_only_drawn_vectors_are_moved(spark, data):
    """The pool is scanned next to the broadcast picks; its vectors are not shuffled to be indexed."""
    text = plan_text(QUERIES["episodes"](spark, data))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_cap_is_applied_before_the_shuffle(spark, data):
    text = plan_text(QUERIES["cap_per_group"](spark, data))
    assert text.count("WindowGroupLimit") == 4
