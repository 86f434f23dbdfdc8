"""Few-shot episodes: n classes by k rows, and nearest-centroid scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions.binding import once
from scansio.operators.joins import join_null_safe
from scansio.operators.metrics import arg_max, hit
from scansio.operators.sampling import LEAF_ROWS, SEED, hash_key, number_rows
from scansio.session import bounded, stage


def index_rows(pool: DataFrame, label: str, key: str, seed: int = SEED,
               cell_rows: int = LEAF_ROWS) -> DataFrame:
    """0-based place of each row in its class, in draw order.

    A class may hold a third of all rows, so places are counted inside cells of
    the leading hash digits and shifted by the size of the cells before them.
    There are as many digits as keep a cell near ``cell_rows`` rows even if one
    class holds them all.
    """
    staged = stage(pool.withColumn("h", hash_key(F.col(key).cast("string"), seed=seed)), "pool")
    hex_digits = 1
    total = staged.count()
    while total > cell_rows * 16 ** hex_digits:
        hex_digits += 1
    rows = staged.withColumn("cell", F.substring("h", 1, hex_digits))
    sizes = rows.groupBy(label, "cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(label).orderBy("cell")) - F.col("rows")
    shifts = sizes.select(label, "cell", before.alias("shift"))
    place = F.row_number().over(Window.partitionBy(label, "cell").orderBy("h")) - 1
    return (rows.withColumn("place", place).transform(join_null_safe, bounded(shifts, "cells"), [label, "cell"])
            .withColumn("place", F.col("place") + F.col("shift")).drop("h", "cell", "shift"))


def draw_episodes(tasks: DataFrame, classes: DataFrame, label: str, ways: int, shots: int,
                  queries: int = 1, seed: int = SEED) -> DataFrame:
    """Which row of which class each task uses: ``episode, part, slot, label, place, role``.

    ``classes`` holds ``label, part, size``; the classes of a part are numbered
    by name.  A task draws ``ways`` distinct numbers by Floyd's rule: the i-th is
    a hash modulo ``classes - ways + i + 1``, and a number drawn before is
    replaced by the largest one of that range.  So a task costs ``ways`` hashes,
    however many classes there are, and an equi-join finds the classes.  The rows
    of a class are consecutive places from a drawn start.  A part needs at least
    ``ways`` classes of ``shots + queries`` rows; smaller classes are an error.
    """
    # numbered over all parts at once: a part may hold any number of classes
    places = number_rows(classes.select(label, "part", "size"), ["part", label], "place")
    firsts = places.groupBy("part").agg(F.min("place").alias("first"))  # a few rows, as the parts are
    numbered = stage(places.join(F.broadcast(firsts), "part").select(
        label, "part", "size", (F.col("place") - F.col("first")).alias("number")), "classes")
    parts = numbered.groupBy("part").agg(F.count("*").alias("classes"), F.min("size").alias("least")).collect()
    for part in parts:
        if part.least < shots + queries:
            raise ValueError(f"a class of part {part.part} has fewer than {shots + queries} rows")
        if part.classes < ways:
            raise ValueError(f"part {part.part} has fewer than {ways} classes")
    each = [F.struct(F.lit(p.part).alias("part"), F.lit(p.classes).cast("bigint").alias("classes")) for p in parts]
    rows = tasks.select("episode", F.explode(F.array(*each)).alias("p")).select("episode", "p.part", "p.classes")

    def drawn(slot, start):
        """Eight hex digits of the hash of a slot, as a number."""
        h = hash_key(F.col("episode").cast("string"), "part", slot.cast("string"), seed=seed)
        return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")

    def add(numbers, slot):
        last = F.col("classes") - ways + slot
        return once(F.pmod(drawn(slot, 1), last + 1),
                    lambda n: F.array_append(numbers, F.when(F.array_contains(numbers, n), last).otherwise(n)))

    numbers = F.aggregate(F.sequence(F.lit(0), F.lit(ways - 1)), F.array().cast("array<bigint>"), add)
    slots = rows.select("episode", "part", F.posexplode(numbers).alias("slot", "number")).join(
        numbered, ["part", "number"])
    picks = F.sequence(F.lit(0), F.lit(shots + queries - 1))
    return (slots.select("episode", "part", "slot", label, "size", drawn(F.col("slot"), 9).alias("start"),
                         F.explode(picks).alias("pick"))
            .select("episode", "part", "slot", label,
                    F.pmod(F.col("start") + F.col("pick"), F.col("size")).alias("place"),
                    F.when(F.col("pick") < shots, "support").otherwise("query").alias("role")))


def episode_rows(pool: DataFrame, tasks: DataFrame, parts: DataFrame, label: str, key: str,
                 ways: int, shots: int, queries: int = 1, seed: int = SEED) -> DataFrame:
    """Rows of all episodes with their slot, the class number inside the episode.

    Only class and key of the pool are shuffled to find the drawn rows; vectors
    and other columns are joined to the drawn keys, whose staged size tells
    Catalyst whether the pool has to move at all.
    """
    indexed = index_rows(pool.select(label, key), label, key, seed)
    sizes = pool.groupBy(label).agg(F.count("*").alias("size"))
    classes = sizes.join(parts.select(label, "part"), label)
    draws = draw_episodes(tasks, classes, label, ways, shots, queries, seed)
    picks = stage(draws.join(indexed, [label, "place"]), "picks")
    return pool.join(picks, [label, key])


def centroid_scores(rows: DataFrame, vector: str, ways: int) -> DataFrame:
    """Nearest class centroid by cosine: ``episode, part, slot, predicted, correct`` per query.

    An episode is ``ways * (shots + queries)`` rows by construction, so it is
    gathered once and scored with array expressions.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    item = F.struct("slot", "role", F.col("row_key"), v.alias("v"))
    episodes = rows.groupBy("episode", "part").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def centroid(slot):
        members = F.filter("items", lambda i: (i["slot"] == slot) & (i["role"] == "support"))
        zero = F.transform(members[0]["v"], lambda x: F.lit(0.0))
        return F.aggregate(members, zero, lambda s, i: F.zip_with(s, i["v"], lambda a, b: a + b))

    def norm(x):
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a))

    def cosine(a, b):
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return dot / (norm(a) * norm(b))

    centroids = F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), centroid)
    asked = F.filter("items", lambda i: i["role"] == "query")
    queries = (episodes.select("episode", "part", centroids.alias("centroids"), asked.alias("asked"))
               .select("episode", "part", "centroids", F.explode("asked").alias("q")))
    scores = F.transform("centroids", lambda c: cosine(F.col("q.v"), c))
    return (queries.select("episode", "part", F.col("q.slot").alias("slot"),
                           F.col("q.row_key").alias("row_key"), scores.alias("scores"))
            .withColumn("predicted", arg_max("scores")))


def episode_accuracy(scores: DataFrame, label: str = "slot") -> DataFrame:
    """Arg-max accuracy of each episode."""
    return scores.groupBy("part", "episode").agg(F.avg(hit(label, arg_max("scores"))).alias("accuracy"))


def episode_summary(accuracies: DataFrame, per_iteration: int = 32) -> DataFrame:
    """Mean accuracy per iteration of ``per_iteration`` tasks; the first and the best one."""
    iterations = (accuracies
                  .withColumn("iteration", F.floor(F.col("episode") / per_iteration).cast("bigint"))
                  .groupBy("part", "iteration").agg(F.avg("accuracy").alias("accuracy")))
    return iterations.groupBy("part").agg(
        F.count("*").alias("iterations"),
        F.min_by("accuracy", "iteration").alias("first_accuracy"),
        F.max("accuracy").alias("best_accuracy"))
