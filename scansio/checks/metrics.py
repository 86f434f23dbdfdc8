"""Aggregations and quality measures."""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio.checks.registry import KEY, check, kept, r6
from scansio.functions import meter as M
from scansio.functions.text import normalise_answer
from scansio.operators import metrics, runs, sampling
from scansio.plans import evaluate


@check("exact_match", """SELECT lang, count(*) AS rows,
    round(avg((substr(pred, 1, 12) = meter)::INTEGER::DOUBLE), 6) AS accuracy FROM kept GROUP BY lang""")
def exact_match(spark, folder):
    scored = evaluate.through_labels(kept(spark, folder, "meter", "pred"), "pred")
    return scored.groupBy("lang").agg(
        F.count("*").alias("rows"), r6(metrics.exact_match("meter", "pred")).alias("accuracy"))


@check("baseline_match", """SELECT lang, round(avg((coalesce(sota, '') = meter)::INTEGER::DOUBLE), 6) AS accuracy
    FROM kept GROUP BY lang""")
def baseline_match(spark, folder):
    return kept(spark, folder, "meter", "sota").groupBy("lang").agg(
        r6(metrics.exact_match("meter", "sota")).alias("accuracy"))


@check("pooled_match", """SELECT lang, count(*)::BIGINT AS rows,
    round(avg((pred = meter)::INTEGER::DOUBLE), 6) AS accuracy FROM kept GROUP BY GROUPING SETS ((lang), ())""")
def pooled_match(spark, folder):
    return metrics.pooled_match(kept(spark, folder, "meter", "pred"), "meter", "pred").select(
        "lang", "rows", r6("accuracy").alias("accuracy"))


@check("macro_baseline", """SELECT round(avg(a), 6) AS macro_accuracy FROM (
    SELECT avg((sota = meter)::INTEGER::DOUBLE) AS a FROM kept GROUP BY lang)""")
def macro_baseline(spark, folder):
    return metrics.macro_match(kept(spark, folder, "meter", "sota"), "meter", "sota").select(
        r6("macro_accuracy").alias("macro_accuracy"))


@check("score_table", """SELECT lang, model, count(*)::BIGINT AS rows,
    round(avg((guess = meter)::INTEGER::DOUBLE), 6) AS accuracy FROM (
    SELECT lang, meter, 'model' AS model, pred AS guess FROM kept
    UNION ALL SELECT lang, meter, 'baseline', sota FROM kept)
    GROUP BY GROUPING SETS ((lang, model), (model))""")
def score_table(spark, folder):
    rows = kept(spark, folder, "meter", "pred", "sota")
    return evaluate.score(rows, {"model": "pred", "baseline": "sota"}).select(
        "lang", "model", "rows", r6("accuracy").alias("accuracy"))


@check("split_counts", "SELECT lang, split, count(*) AS rows FROM three_way GROUP BY lang, split")
def split_counts(spark, folder):
    return metrics.split_counts(sampling.split_three_way(kept(spark, folder), ["lang"], KEY))


@check("class_counts", "SELECT meter, count(*) AS rows FROM kept GROUP BY meter")
def class_counts(spark, folder):
    return metrics.class_counts(kept(spark, folder, "meter"), "meter")


@check("class_summary", """SELECT lang, count(DISTINCT meter) AS patterns, max(length) AS longest
    FROM kept GROUP BY lang""")
def class_summary(spark, folder):
    return kept(spark, folder, "meter").groupBy("lang").agg(
        F.count_distinct("meter").alias("patterns"), F.max("length").alias("longest"))


_SETS = """SELECT lang, list_filter(range(0, length(meter)), lambda i: substr(meter, i + 1, 1) = '+') AS gold,
    list_filter(range(0, length(meter)), lambda i: scores[i + 1] >= 0.5) AS pred FROM kept"""


def _label_sets(spark, folder):
    return kept(spark, folder, "meter", "scores").select(
        "lang", M.stress_labels("meter").alias("gold"), M.threshold_labels("scores").alias("pred"))


@check("label_precision_recall", f"""SELECT lang,
    round(sum(len(list_intersect(gold, pred)))::DOUBLE / sum(len(pred)), 6) AS "precision",
    round(sum(len(list_intersect(gold, pred)))::DOUBLE / sum(len(gold)), 6) AS recall
    FROM ({_SETS}) GROUP BY lang""")
def label_precision_recall(spark, folder):
    return _label_sets(spark, folder).groupBy("lang").agg(
        r6(metrics.label_precision("gold", "pred")).alias("precision"),
        r6(metrics.label_recall("gold", "pred")).alias("recall"))


@check("set_exact_match", f"""SELECT lang, round(avg((gold = pred)::INTEGER::DOUBLE), 6) AS accuracy
    FROM ({_SETS}) GROUP BY lang""")
def set_exact_match(spark, folder):
    return _label_sets(spark, folder).groupBy("lang").agg(
        r6(metrics.label_set_match("gold", "pred")).alias("accuracy"))


def _places(column):
    return (f"array_to_string(list_transform(list_filter(range(0, length({column})), "
            f"lambda i: substr({column}, i + 1, 1) = '+'), lambda i: i + 1), ', ')")


_GENERATIVE = f"""SELECT lang AS prefix, lang, text, {_places('meter')} AS target_text,
    [{_places('all_predicted[1]')}, {_places('all_predicted[2]')}, {_places('all_predicted[3]')}] AS candidates
    FROM kept"""
_NORMAL = ("trim(regexp_replace(regexp_replace(translate(lower({0}), "
           "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))")
_TOKENS = "list_filter(string_split(" + _NORMAL + ", ' '), lambda w: w <> '')"
_F1 = f"""SELECT prefix, lang, text, CASE WHEN len(g) = 0 OR len(p) = 0 THEN (len(g) = len(p))::INTEGER::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(list_distinct(g), list_distinct(p)),
        lambda w: least(len(list_filter(g, lambda x: x = w)), len(list_filter(p, lambda x: x = w))))), 0)
        / (len(g) + len(p)) END AS f1,
    (ng = np)::INTEGER::DOUBLE AS exact, (target_text = candidates[1])::INTEGER::DOUBLE AS top1,
    list_contains(candidates, target_text)::INTEGER::DOUBLE AS any_hit FROM (
    SELECT *, {_TOKENS.format('target_text')} AS g, {_TOKENS.format('candidates[1]')} AS p,
        {_NORMAL.format('target_text')} AS ng, {_NORMAL.format('candidates[1]')} AS np FROM ({_GENERATIVE}))"""


def _generative(spark, folder):
    rows = kept(spark, folder, "meter", "all_predicted")
    candidates = F.transform("all_predicted", M.stress_text)
    return rows.select(F.col("lang").alias("prefix"), "lang", "text", M.stress_text("meter").alias("target_text"),
                       candidates.alias("all_predicted"))


_FIRST = "all_predicted[0]"


@check("token_f1", f"SELECT lang, text, round(f1, 6) AS f1 FROM ({_F1})")
def token_f1(spark, folder):
    rows = _generative(spark, folder)
    return rows.select("lang", "text", r6(metrics.token_f1("target_text", F.expr(_FIRST))).alias("f1"))


@check("normalised_text", """SELECT lang, text, array_to_string(list_filter(string_split(regexp_replace(
    translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+', ' ', 'g'), ' '),
    lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ') AS answer FROM kept""")
def normalised_text(spark, folder):
    """Verse text, accents and all, as the answer measures compare it."""
    return kept(spark, folder).select("lang", "text", normalise_answer("text").alias("answer"))


@check("normalised_exact", f"SELECT lang, round(avg(exact), 6) AS exact FROM ({_F1}) GROUP BY lang")
def normalised_exact(spark, folder):
    return _generative(spark, folder).groupBy("lang").agg(
        r6(F.avg(metrics.normalised_hit("target_text", F.expr(_FIRST)))).alias("exact"))


@check("top1_match", f"SELECT lang, round(avg(top1), 6) AS accuracy FROM ({_F1}) GROUP BY lang")
def top1_match(spark, folder):
    return _generative(spark, folder).groupBy("lang").agg(
        r6(F.avg(metrics.top1_hit("target_text", "all_predicted"))).alias("accuracy"))


@check("hit_any", f"""SELECT lang, sum(any_hit)::BIGINT AS hits, round(avg(any_hit), 6) AS rate
    FROM ({_F1}) GROUP BY lang""")
def hit_any(spark, folder):
    any_hit = metrics.any_hit("target_text", "all_predicted")
    return _generative(spark, folder).groupBy("lang").agg(
        F.sum(any_hit).cast("bigint").alias("hits"), r6(F.avg(any_hit)).alias("rate"))


@check("by_task", f"""SELECT prefix, round(avg(f1), 6) AS f1, round(avg(exact), 6) AS exact,
    round(avg(top1), 6) AS accuracy, sum(any_hit)::BIGINT AS any_hits, round(avg(any_hit), 6) AS any_rate
    FROM ({_F1}) GROUP BY prefix""")
def by_task(spark, folder):
    scores = metrics.generative_scores(_generative(spark, folder))
    return scores.select("prefix", "any_hits", *[r6(c).alias(c) for c in ("f1", "exact", "accuracy", "any_rate")])


# One document in eleven has no prediction: its rows count and are wrong.
_HOLES = "CASE WHEN doc_id % 11 <> 0 THEN {0} END"


def _holes(df, *columns):
    return df.withColumns({c: F.when(F.col("doc_id") % 11 != 0, F.col(c)) for c in columns}).drop("doc_id")


@check("by_task_missing", f"""SELECT prefix, round(avg(if(answered, f1, 0)), 6) AS f1,
    round(avg(if(answered, exact, 0)), 6) AS exact, round(avg(if(answered, top1, 0)), 6) AS accuracy,
    sum(if(answered, any_hit, 0))::BIGINT AS any_hits, round(avg(if(answered, any_hit, 0)), 6) AS any_rate
    FROM (SELECT f.*, k.doc_id % 11 <> 0 AS answered FROM ({_F1}) f JOIN kept k ON k.lang = f.lang AND k.text = f.text)
    GROUP BY prefix""")
def by_task_missing(spark, folder):
    rows = _holes(kept(spark, folder, "meter", "all_predicted"), "all_predicted").select(
        F.col("lang").alias("prefix"), M.stress_text("meter").alias("target_text"),
        F.transform("all_predicted", M.stress_text).alias("all_predicted"))
    scores = metrics.generative_scores(rows)
    return scores.select("prefix", "any_hits", *[r6(c).alias(c) for c in ("f1", "exact", "accuracy", "any_rate")])


@check("set_exact_match_missing", f"""SELECT s.lang, round(avg((k.doc_id % 11 <> 0 AND s.gold = s.pred)::INTEGER::DOUBLE), 6)
    AS accuracy FROM ({_SETS.replace('SELECT lang,', 'SELECT lang, text,')}) s
    JOIN kept k ON k.lang = s.lang AND k.text = s.text GROUP BY s.lang""")
def set_exact_match_missing(spark, folder):
    rows = _holes(kept(spark, folder, "meter", "scores"), "scores").select(
        "lang", M.stress_labels("meter").alias("gold"), M.threshold_labels("scores").alias("pred"))
    return rows.groupBy("lang").agg(r6(metrics.label_set_match("gold", "pred")).alias("accuracy"))


@check("position_confusion_missing", f"""SELECT lang, i::INTEGER AS position, substr(meter, i, 1) AS gold,
    substr(coalesce({_HOLES.format('pred')}, ''), i, 1) AS predicted, count(*) AS rows
    FROM (SELECT lang, doc_id, meter, pred, unnest(range(1, length(meter) + 1)) AS i FROM kept) GROUP BY ALL""")
def position_confusion_missing(spark, folder):
    rows = _holes(kept(spark, folder, "meter", "pred"), "pred")
    return metrics.position_confusion(rows, "meter", "pred", ["lang"])


@check("flat_accuracy", """SELECT lang, round(avg((strpos(meter, '+') - 1
    = list_position(scores, list_max(scores)) - 1)::INTEGER::DOUBLE), 6) AS accuracy FROM kept GROUP BY lang""")
def flat_accuracy(spark, folder):
    first = F.expr("instr(meter, '+') - 1")
    return kept(spark, folder, "meter", "scores").groupBy("lang").agg(
        r6(metrics.flat_accuracy(first, "scores")).alias("accuracy"))


@check("class_accuracy", """SELECT lang, round(avg((strpos(meter, '+') = strpos(pred, '+'))::INTEGER::DOUBLE), 6)
    AS accuracy FROM kept GROUP BY lang""")
def class_accuracy(spark, folder):
    rows = kept(spark, folder, "meter", "pred").select(
        "lang", F.expr("instr(meter, '+')").alias("label"), F.expr("instr(pred, '+')").alias("predicted"))
    return rows.groupBy("lang").agg(r6(metrics.exact_match("label", "predicted")).alias("accuracy"))


@check("vector_moments", """SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
    FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)""")
def vector_moments(spark, folder):
    moments = metrics.vector_moments(fixtures.table(spark, folder, "embeddings"), "embedding")
    return moments.select("n", r6("mean").alias("mean"), r6("std").alias("std"))


@check("best_run", """SELECT lang, model, round(accuracy, 6) AS accuracy FROM (
    SELECT lang, model, i, avg((all_predicted[i] = meter)::INTEGER::DOUBLE) AS accuracy
    FROM kept, (VALUES (1, 'baseline'), (2, 'model'), (3, 'mixed')) m(i, model) GROUP BY lang, model, i)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY accuracy DESC, i) = 1""")
def best_run(spark, folder):
    rows = kept(spark, folder, "meter", "all_predicted")
    models = ("baseline", "model", "mixed")
    sums = [metrics.exact_match("meter", F.get("all_predicted", F.lit(i))).alias(m) for i, m in enumerate(models)]
    accuracies = rows.groupBy("lang").agg(*sums).unpivot("lang", list(models), "model", "accuracy")
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    best = runs.best_run(accuracies.withColumn("run", place), ["lang"], "run")
    return best.select("lang", "model", r6("accuracy").alias("accuracy"))


@check("wrong_predictions", "SELECT lang, text, meter, pred FROM kept WHERE pred <> meter")
def wrong_predictions(spark, folder):
    wrong = metrics.wrong_predictions(kept(spark, folder, "meter", "pred"), "meter", "pred")
    return wrong.select("lang", "text", "meter", "pred")


@check("position_confusion", """SELECT lang, i::INTEGER AS position, substr(meter, i, 1) AS gold,
    substr(pred, i, 1) AS predicted, count(*) AS rows
    FROM (SELECT lang, meter, pred, unnest(range(1, length(meter) + 1)) AS i FROM kept) GROUP BY ALL""")
def position_confusion(spark, folder):
    return metrics.position_confusion(kept(spark, folder, "meter", "pred"), "meter", "pred", ["lang"])


@check("run_report", """SELECT 'multi' AS model_lang, lang AS data_lang,
    round(avg((pred = meter)::INTEGER::DOUBLE) FILTER (WHERE split = 'dev'), 6) AS eval_accuracy,
    round(avg((pred = meter)::INTEGER::DOUBLE) FILTER (WHERE split = 'test'), 6) AS test_accuracy,
    round(avg((sota = meter)::INTEGER::DOUBLE) FILTER (WHERE split = 'test'), 6) AS sota
    FROM three_way GROUP BY lang""")
def run_report(spark, folder):
    rows = sampling.split_three_way(kept(spark, folder, "meter", "pred", "sota"), ["lang"], KEY)
    return evaluate.run_report(rows, "multi").select(
        "model_lang", "data_lang", *[r6(m).alias(m) for m in ("eval_accuracy", "test_accuracy", "sota")])
