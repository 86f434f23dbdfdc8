"""Splits, caps, rebalancing and episodes."""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio.checks.registry import KEY, check, external, kept, pool, r6
from scansio.functions.text import clean_label
from scansio.operators import adaptation, episodes, sampling
from scansio.plans import corpus
from scansio.session import stage

_H = "md5('42|' || lang || '|' || text)"


@check("split_exact", f"""SELECT lang, text, CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE))
    THEN 'dev' ELSE 'train' END AS split FROM (SELECT lang, text, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS rn FROM pool)""")
def split_exact(spark, folder):
    return sampling.split_exact(pool(spark, folder), ["lang"], KEY, 0.25).select("lang", "text", "split")


@check("split_three_way", "SELECT lang, text, split FROM three_way")
def split_three_way(spark, folder):
    return sampling.split_three_way(kept(spark, folder), ["lang"], KEY).select("lang", "text", "split")


def _quotas(rows, by, strata, size):
    """Largest-remainder shares in SQL."""
    return f"""SELECT *, whole + (turn <= size - sum(whole) OVER ({by}))::INTEGER AS quota FROM (
        SELECT *, row_number() OVER ({by} ORDER BY part DESC, {strata}) AS turn FROM (
        SELECT *, (n::HUGEINT * size) // total AS whole, (n::HUGEINT * size) % total AS part FROM (
        SELECT *, {size} AS size FROM (SELECT *, sum(n) OVER ({by}) AS total FROM ({rows})))))"""


_STANZA_QUOTAS = _quotas("SELECT stanza, count(*) AS n FROM labelled_stanzas GROUP BY stanza", "", "stanza",
                         "ceil(CAST(total AS DOUBLE) * CAST(0.25 AS DOUBLE))::BIGINT")


STANZA_SPLIT = f"""SELECT s.stanza_id, s.stanza, CASE WHEN row_number() OVER (PARTITION BY s.stanza
    ORDER BY md5('42|' || s.stanza_id)) <= q.quota THEN 'dev' ELSE 'train' END AS split
    FROM labelled_stanzas s JOIN ({_STANZA_QUOTAS}) q ON q.stanza = s.stanza"""


@check("split_stratified", STANZA_SPLIT)
def split_stratified(spark, folder):
    rows = fixtures.stanzas(spark, folder).withColumn("stanza", clean_label("stanza")).select("stanza_id", "stanza")
    return sampling.split_stratified(rows, [], "stanza", [F.col("stanza_id").cast("string")], 0.25)


_SIZES = """SELECT lang, p AS pool, t AS external, (p + t - goal) // 2 AS dev,
    (p + t - goal) // 2 + goal - p AS moved, goal + (p + t - goal) // 2 - ((p + t - goal) // 2) AS train FROM (
    SELECT lang, p, t, floor(CAST(p + t AS DOUBLE) * CAST(0.7 AS DOUBLE))::BIGINT AS goal FROM (
    SELECT lang, sum(p)::BIGINT AS p, sum(t)::BIGINT AS t FROM (
    SELECT lang, 1 AS p, 0 AS t FROM pool UNION ALL SELECT lang, 0, 1 FROM external) GROUP BY lang))"""


@check("rebalance_sizes", f"SELECT *, external - moved AS test FROM ({_SIZES})")
def rebalance_sizes(spark, folder):
    return sampling.rebalance_sizes(pool(spark, folder), external(spark, folder), ["lang"])


_PARTS = f"""SELECT lang, text, length, 'pool' AS part FROM pool UNION ALL
    SELECT e.lang, e.text, e.length, CASE WHEN row_number() OVER (PARTITION BY e.lang
        ORDER BY md5('42|' || e.lang || '|' || e.text)) <= s.moved THEN 'moved' ELSE 'test' END
    FROM external e JOIN ({_SIZES}) s ON s.lang = e.lang"""


def _rebalanced(spark, folder, strata=None):
    outside = stage(external(spark, folder), "external")
    return sampling.rebalanced(pool(spark, folder, held=outside), outside, ["lang"], KEY, strata)


@check("rebalance", f"SELECT lang, text, part FROM ({_PARTS})")
def rebalance(spark, folder):
    return _rebalanced(spark, folder).select("lang", "text", "part")


_LENGTH_QUOTAS = _quotas(
    f"""SELECT r.lang, r.length, count(*) AS n, any_value(s.dev) AS wanted FROM ({_PARTS}) r
        JOIN ({_SIZES}) s ON s.lang = r.lang WHERE r.part <> 'test' GROUP BY r.lang, r.length""",
    "PARTITION BY lang", "length", "wanted")


@check("split_stratified_n", f"""SELECT r.lang, r.text, CASE WHEN row_number() OVER (PARTITION BY r.lang, r.length
    ORDER BY md5('42|' || r.lang || '|' || r.text)) <= q.quota THEN 'dev' ELSE 'train' END AS split
    FROM ({_PARTS}) r JOIN ({_LENGTH_QUOTAS}) q ON q.lang = r.lang AND q.length = r.length WHERE r.part <> 'test'""")
def split_stratified_n(spark, folder):
    rows = _rebalanced(spark, folder, "length")
    return rows.filter("part <> 'test'").select("lang", "text", "split")


@check("cap_per_group", f"""SELECT lang, text, meter FROM kept
    QUALIFY row_number() OVER (PARTITION BY meter ORDER BY {_H}) <= 50""")
def cap_per_group(spark, folder):
    return sampling.cap_per_group(kept(spark, folder, "meter"), ["meter"], KEY, 50).select("lang", "text", "meter")


_RANKED = """SELECT doc_id, pos, lang, value, CASE WHEN rn <= n * 75 // 100 THEN 'train' ELSE 'eval' END AS split
    FROM (SELECT doc_id, pos, lang, value, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY {}) AS rn FROM uniq_lines)"""


@check("split_positional", _RANKED.format("doc_id, pos"))
def split_positional(spark, folder):
    rows = corpus.lm_corpus(fixtures.raw_lines(spark, folder), ["lang"], "doc_id", "pos")
    return rows.select("doc_id", "pos", "lang", "value", "split")


@check("split_positional_shuffled", _RANKED.format("md5('42|' || doc_id || '|' || pos)"))
def split_positional_shuffled(spark, folder):
    lines = corpus.clean_lines(fixtures.raw_lines(spark, folder), "doc_id", "pos")
    key = [F.col(c).cast("string") for c in ("doc_id", "pos")]
    return sampling.split_positional_shuffled(lines, ["lang"], key).select("doc_id", "pos", "lang", "value", "split")


_CLASSES = """SELECT label, rn::INTEGER AS class_rank, CASE WHEN rn <= 4 THEN 'train' WHEN rn <= 7 THEN 'validation'
    ELSE 'test' END AS part FROM (SELECT label, row_number() OVER (ORDER BY md5('42|' || label)) AS rn
    FROM (SELECT DISTINCT label FROM embeddings))"""


def _parts(spark, folder):
    return sampling.class_partition(
        fixtures.table(spark, folder, "embeddings"), "label", {"train": 4, "validation": 3}, "test")


@check("class_partition", _CLASSES)
def class_partition(spark, folder):
    return _parts(spark, folder)


_HASH = "md5('42|' || {0}.episode || '|' || {0}.part || '|' || {1})"
_NUMBER = f"('0x' || substr({_HASH.format('t', 'i')}, 1, 8))::BIGINT % (t.classes - 2 + i)"
_MEMBERS = f"""SELECT c.label, c.part, z.size, row_number() OVER (PARTITION BY c.part ORDER BY c.label) - 1 AS number
    FROM ({_CLASSES}) c JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY label) z ON z.label = c.label"""


def _draws(shots):
    return f"""SELECT d.episode, d.part, d.slot, d.label, e.vec_id, e.embedding,
        CASE WHEN d.pick < {shots} THEN 'support' ELSE 'query' END AS role FROM (
        SELECT s.episode, s.part, s.slot, m.label, k.pick,
            (('0x' || substr({_HASH.format('s', 's.slot')}, 9, 8))::BIGINT + k.pick) % m.size AS place FROM (
        SELECT episode, part, unnest(numbers) AS number, unnest([0, 1, 2])::INTEGER AS slot FROM (
        SELECT t.episode, t.part, list_reduce([0, 1, 2], lambda seen, i: list_append(seen,
            CASE WHEN list_contains(seen, {_NUMBER}) THEN t.classes - 3 + i ELSE {_NUMBER} END), []::BIGINT[]) AS numbers
        FROM (SELECT v.vec_id AS episode, c.part, c.classes FROM embeddings v,
            (SELECT part, count(*) AS classes FROM ({_MEMBERS}) GROUP BY part) c) t)) s
        JOIN ({_MEMBERS}) m ON m.part = s.part AND m.number = s.number,
        (SELECT unnest(range({shots + 1})) AS pick) k) d
        JOIN (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label
            ORDER BY md5('42|' || vec_id)) - 1 AS place FROM embeddings) e
        ON e.label = d.label AND e.place = d.place"""


def _episodes(spark, folder, shots):
    pool_rows = fixtures.table(spark, folder, "embeddings")
    tasks = pool_rows.select(F.col("vec_id").alias("episode"))
    return episodes.episode_rows(pool_rows, tasks, _parts(spark, folder), "label", "vec_id", 3, shots)


@check("episodes", f"""SELECT episode, part, slot, label, vec_id, role FROM ({_draws(1)})
    UNION ALL SELECT episode, part, slot, label, vec_id, role || '5' FROM ({_draws(5)})""")
def episodes_(spark, folder):
    columns = ["episode", "part", "slot", "label", "vec_id"]
    five = _episodes(spark, folder, 5).select(*columns, F.concat("role", F.lit("5")).alias("role"))
    return _episodes(spark, folder, 1).select(*columns, "role").unionByName(five)


def _centroids(shots):
    return f"""SELECT q.episode, q.part, q.slot, arg_max(s.slot, list_cosine_similarity(q.v, s.c))::INTEGER
        AS predicted FROM (SELECT episode, part, slot, embedding::DOUBLE[] AS v FROM ({_draws(shots)})
            WHERE role = 'query') q
        JOIN (SELECT episode, part, slot, list(x ORDER BY i) AS c FROM (
            SELECT episode, part, slot, i, sum(x) AS x FROM (
                SELECT episode, part, slot, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i
                FROM ({_draws(shots)}) WHERE role = 'support') GROUP BY episode, part, slot, i)
            GROUP BY episode, part, slot) s ON s.episode = q.episode AND s.part = q.part
        GROUP BY q.episode, q.part, q.slot"""


def _scores(spark, folder, shots=5):
    rows = _episodes(spark, folder, shots).withColumnRenamed("vec_id", "row_key")
    return episodes.centroid_scores(rows, "embedding", 3)


@check("few_shot_centroid", _centroids(5))
def few_shot_centroid(spark, folder):
    return _scores(spark, folder).select("episode", "part", "slot", "predicted")


@check("episode_accuracy", f"""SELECT part, episode, round(avg((slot = predicted)::INTEGER::DOUBLE), 6) AS accuracy
    FROM ({_centroids(5)}) GROUP BY part, episode""")
def episode_accuracy(spark, folder):
    return episodes.episode_accuracy(_scores(spark, folder)).select("part", "episode", r6("accuracy").alias("accuracy"))


@check("episode_summary", f"""SELECT part, count(*) AS iterations,
    round(arg_min(accuracy, iteration), 6) AS first_accuracy, round(max(accuracy), 6) AS best_accuracy FROM (
    SELECT part, episode // 32 AS iteration, avg(accuracy) AS accuracy FROM (
    SELECT part, episode, avg((slot = predicted)::INTEGER::DOUBLE) AS accuracy FROM ({_centroids(5)})
    GROUP BY part, episode) GROUP BY part, iteration) GROUP BY part""")
def episode_summary(spark, folder):
    summary = episodes.episode_summary(episodes.episode_accuracy(_scores(spark, folder)))
    return summary.select("part", "iterations", r6("first_accuracy").alias("first_accuracy"),
                          r6("best_accuracy").alias("best_accuracy"))


def _learner(spark, folder):
    """A head fitted on all episodes of the train classes, its curve, and the rows of all episodes."""
    rows = stage(_episodes(spark, folder, 5).withColumnRenamed("vec_id", "row_key"), "episodes")
    return rows, *adaptation.meta_fit(rows.filter("part = 'train'"), "embedding", 3, tasks_per_step=256, hidden=32)


@check("few_shot_curve", f"""SELECT episode // 256 AS iteration, count(DISTINCT episode) AS episodes, true AS sound
    FROM ({_draws(5)}) WHERE part = 'train' GROUP BY iteration""")
def few_shot_curve(spark, folder):
    """Episodes, loss and accuracy of each iteration of meta-learning."""
    _, _, curve = _learner(spark, folder)
    sound = F.col("accuracy").between(0.0, 1.0) & (F.col("loss") > 0) & (F.col("loss") < 10)
    return curve.select("iteration", "episodes", sound.alias("sound"))


@check("few_shot_adapted", f"""SELECT episode, part, slot, true AS shares, true AS repeated FROM ({_draws(5)})
    WHERE role = 'query' AND part <> 'train'""")
def few_shot_adapted(spark, folder):
    """Every query row of classes that the head has not met, scored by a copy adapted to its episode; two adaptations agree."""
    rows, head, _ = _learner(spark, folder)
    unseen = rows.filter("part <> 'train'")
    key = ["episode", "part", "slot"]
    one, two = (adaptation.adapted_scores(head, unseen, "embedding") for _ in range(2))
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x))
    return one.join(two.select(*key, F.col("scores").alias("again")), key).select(
        *key, (F.abs(total - 1) < 1e-9).alias("shares"), (F.col("scores") == F.col("again")).alias("repeated"))
