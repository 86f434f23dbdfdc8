"""Seeded splits, caps and rebalancing with exact sizes.

A draw is the order of ``md5(seed|key)``.  An exact split needs the key of the
k-th row in that order, not the order itself: ``rank_cuts`` finds it by counting
rows per leading digits of the key (group sizes come from the same counts) and
looking only into the cell that holds the k-th row.  Counts are combined on the map side, no row is moved, and the split
itself is a comparison with the cut, a narrow projection.  A group that holds a
third of all rows costs what any other group costs.

Rows with equal keys are told apart by their place in the staged table, so sizes
stay exact whether or not rows were de-duplicated first.  An empty list of group
columns makes all rows one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scansio.operators.joins import join_null_safe
from scansio.session import bounded, stage

SEED = 42
LEAF_ROWS = 1_000_000
#: Draw order: the hash of the key, then the place in the staged table.
DRAW = ["h", "turn"]
#: Group column of rows that have none.
ALL = "all_rows"


def any_group(work: Callable) -> Callable:
    """Let ``work(*frames, by, ...)`` take an empty ``by``: all rows are one group of a stored column."""
    @wraps(work)
    def run(*frames_by, **options):
        at = next(i for i, x in enumerate(frames_by) if not isinstance(x, DataFrame))
        frames, by, rest = frames_by[:at], list(frames_by[at]), frames_by[at + 1:]
        if by:
            return work(*frames, by, *rest, **options)
        if options.get("sizes") is not None:
            options["sizes"] = stage(options["sizes"].withColumn(ALL, F.lit(0)), "sizes")
        frames = [f if ALL in f.columns else f.withColumn(ALL, F.lit(0)) for f in frames]
        return work(*frames, [ALL], *rest, **options).drop(ALL)
    return run


def hash_key(*key: Column | str, seed: int = SEED) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_digits(h: str) -> list[Column]:
    """Leading digits of a hash, 12 bits at a time."""
    return [F.substring(h, 1 + 3 * i, 3) for i in range(5)]


def id_digits(df: DataFrame, column: str) -> list[Column]:
    """Leading digits of a non-negative id, 16 bits at a time, from its highest bit."""
    top = df.agg(F.max(column)).first()[0] or 0
    shifts = list(range(max(0, int(top).bit_length() - 16), 0, -16)) + [0]
    return [F.shiftright(F.col(column), s) for s in shifts]


def rank_cuts(df: DataFrame, by: Sequence[str], order: Sequence[str], digits: Sequence[Column],
              sizes: DataFrame | Sequence[Column] | Callable[[DataFrame], DataFrame], names: Sequence[str],
              leaf_rows: int = LEAF_ROWS, also: Sequence[str] = ()) -> DataFrame:
    """The order keys with which the named parts of each group end: ``by..., cut_<name>...``.

    ``sizes`` says how many rows each part has: expressions of ``n``, the rows
    of the group, a table ``by..., names...``, or a function from the table
    ``by..., n`` to one.  The first pass counts rows per group and first digit,
    which gives group sizes as well as cells.  Expressions named in ``also`` are
    returned with the cuts.  ``digits``
    are leading parts of the order key, each with at most 65,536 values once the
    earlier ones are fixed.  They are used until every cell left holds at most
    ``leaf_rows`` rows, which are then ranked.
    """
    by, group = list(by), Window.partitionBy(*by)
    keep = df.select(*by, *order, *[d.alias(f"digit{i}") for i, d in enumerate(digits)])

    def ends_here(cells: DataFrame) -> DataFrame:
        """Cells that hold the k-th row, with k counted from the start of the cell."""
        before = F.col("upto") - F.col("cell_rows")
        return (cells.filter((F.col("k") <= F.col("upto")) & (F.col("k") > before))
                .withColumn("k", F.col("k") - before).drop("upto"))

    histogram = keep.groupBy(*by, "digit0").agg(F.count("*").alias("cell_rows"))
    if callable(sizes):
        histogram = stage(histogram, "histogram")
        sizes = sizes(histogram.groupBy(*by).agg(F.sum("cell_rows").alias("n")))
    counts = histogram.withColumn("upto", F.sum("cell_rows").over(group.orderBy("digit0")))
    if isinstance(sizes, DataFrame):
        counts = join_null_safe(counts, sizes.select(*by, *names), by)
    else:
        counts = counts.withColumn("n", F.sum("cell_rows").over(group)).select("*", *sizes)
    total, ends = F.lit(0), []
    for name in names:
        total = total + F.col(name)
        ends.append(F.struct(F.lit(name).alias("target"), total.cast("bigint").alias("k")))
    cells = bounded(ends_here(counts.select(*by, *also, "digit0", "cell_rows", "upto", F.inline(F.array(*ends)))), "cells")
    prefix = ["digit0"]
    for i in range(1, len(digits)):
        if cells.filter(F.col("cell_rows") > leaf_rows).isEmpty():
            break
        rows = join_null_safe(keep, cells.select(*by, *prefix).distinct(), by + prefix, "left_semi")
        upto = F.sum("cell_rows").over(Window.partitionBy(*by, *prefix).orderBy(f"digit{i}"))
        counts = (rows.groupBy(*by, *prefix, f"digit{i}").agg(F.count("*").alias("cell_rows"))
                  .withColumn("upto", upto))
        cells = bounded(ends_here(join_null_safe(counts, cells.drop("cell_rows"), by + prefix)), "cells")
        prefix = prefix + [f"digit{i}"]
    rank = F.row_number().over(Window.partitionBy(*by, "target").orderBy(*order))
    # dealt by group, which serves the ranking of cells as well as the cuts
    last = (join_null_safe(keep, cells, by + prefix).repartition(*by).withColumn("rank", rank)
            .filter(F.col("rank") == F.col("k")))
    cuts = [F.first(F.when(F.col("target") == name, F.struct(*order)), ignorenulls=True).alias(f"cut_{name}")
            for name in names]
    return bounded(last.groupBy(*by).agg(*cuts, *[F.first(c).alias(c) for c in also]), "cuts")


def label_by_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], digits: Sequence[Column],
                  sizes: DataFrame | Sequence[Column] | Callable[[DataFrame], DataFrame], names: Sequence[str],
                  rest: str, column: str = "split",
                  leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Name the first ``sizes[names[0]]`` rows of each group after the first name, and so on.

    ``df`` is scanned three times, so pass a staged table.
    """
    cuts = rank_cuts(df, by, order, digits, sizes, names, leaf_rows)
    here = F.struct(*order)
    label = F.when(F.lit(False), rest)
    for name in names:
        label = label.when(here <= F.col(f"cut_{name}"), name)
    return (join_null_safe(df, cuts, by, "left").withColumn(column, label.otherwise(rest))
            .drop(*[f"cut_{n}" for n in names]))


def part_size(rows: Column | str, fraction: float) -> Column:
    """``ceil(rows * fraction)`` in double precision."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.ceil(rows.cast("double") * F.lit(float(fraction))).cast("bigint")


def with_hash(df: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Stage the rows with their draw order."""
    return stage(df.withColumn("h", hash_key(*key, seed=seed)).withColumn("turn", F.monotonically_increasing_id()), "draw")


@any_group
def split_exact(df: DataFrame, by: Sequence[str], key: Sequence[str], fraction: float,
                held: str = "dev", rest: str = "train", seed: int = SEED,
                leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Hold out ``ceil(n * fraction)`` rows of each group."""
    rows = with_hash(df, key, seed)
    return label_by_rank(rows, by, DRAW, hash_digits("h"), [part_size("n", fraction).alias(held)], [held], rest,
                         leaf_rows=leaf_rows).drop(*DRAW)


def three_way_sizes(rows: Column | str, test: float = 0.15, dev: float = 0.176) -> list[Column]:
    n = F.col(rows) if isinstance(rows, str) else rows
    n_test = part_size(n, test)
    return [n_test.alias("test"), part_size(n - n_test, dev).alias("dev")]


@any_group
def split_three_way(df: DataFrame, by: Sequence[str], key: Sequence[str], test: float = 0.15,
                    dev: float = 0.176, seed: int = SEED, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Test, then dev from what is left, then train; both cuts from the same counts."""
    rows = with_hash(df, key, seed)
    return label_by_rank(rows, by, DRAW, hash_digits("h"), three_way_sizes("n", test, dev), ["test", "dev"], "train",
                         leaf_rows=leaf_rows).drop(*DRAW)


def quotas(counts: DataFrame, by: Sequence[str], strata: str, size: Column, held: str) -> DataFrame:
    """Largest-remainder shares of ``size`` rows per class.

    ``counts`` holds ``by..., strata, n``; ``size`` may use ``total``, the rows of
    the group.  Ties go to the class that sorts first.  Products are exact: they
    are decimals, not doubles.
    """
    by = list(by)
    group = Window.partitionBy(*by)
    exact = "cast(n as decimal(19,0)) * cast(size as decimal(19,0))"
    shares = (counts.withColumn("total", F.sum("n").over(group))
              .withColumn("size", size.cast("bigint"))
              .withColumn("whole", F.expr(f"{exact} div total"))
              .withColumn("part", F.expr(f"({exact}) % total"))
              .withColumn("spare", F.col("size") - F.sum("whole").over(group))
              .withColumn("turn", F.row_number().over(group.orderBy(F.desc("part"), strata))))
    extra = (F.col("turn") <= F.col("spare")).cast("bigint")
    return shares.select(*by, strata, (F.col("whole") + extra).alias(held))


@any_group
def split_stratified(df: DataFrame, by: Sequence[str], strata: str, key: Sequence[str],
                     fraction: float | None = None, sizes: DataFrame | None = None,
                     held: str = "dev", rest: str = "train", seed: int = SEED,
                     leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Hold out rows so that each class keeps its share.

    Either a fraction of the rows of each group or ``sizes``, a table
    ``by..., size`` of absolute sizes.
    """
    by = list(by)
    rows = with_hash(df, key, seed)

    def shares(counts: DataFrame) -> DataFrame:
        if sizes is None:
            return quotas(counts, by, strata, part_size("total", fraction), held)
        wanted = join_null_safe(counts, sizes.withColumnRenamed("size", "wanted"), by)
        return quotas(wanted, by, strata, F.col("wanted"), held)

    return label_by_rank(rows, [*by, strata], DRAW, hash_digits("h"), shares, [held], rest,
                         leaf_rows=leaf_rows).drop(*DRAW)


def cap_per_group(df: DataFrame, by: Sequence[str], key: Sequence[str], cap: int,
                  seed: int = SEED, salts: int = 64) -> DataFrame:
    """At most ``cap`` rows per group, those first in draw order.

    Each group is capped per salt first.  Spark also limits both windows before
    their shuffle, so a popular pattern sends at most ``cap`` rows per map task
    and its last window sees at most ``cap * salts``.
    """
    rows = df.withColumn("h", hash_key(*key, seed=seed)).withColumn(
        "salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    for keys in ([*by, "salt"], list(by)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")
    return rows.drop("h", "salt")


def rebalance_sizes(pool: DataFrame, test: DataFrame, by: Sequence[str], train: float = 0.7) -> DataFrame:
    """Sizes after moving external test rows to the pool: ``train, dev, test, moved``.

    The share of train rows is cut to a whole number in double precision; dev
    and test get half of the rest each.  Too small a test set is an error.
    """
    by = list(by) or [ALL]
    if by == [ALL]:
        pool, test = pool.withColumn(ALL, F.lit(0)), test.withColumn(ALL, F.lit(0))
    sides = (pool.select(*by, F.lit(1).alias("p"), F.lit(0).alias("t"))
             .unionByName(test.select(*by, F.lit(0).alias("p"), F.lit(1).alias("t"))))
    counts = sides.groupBy(*by).agg(F.sum("p").alias("pool"), F.sum("t").alias("external"))
    total = F.col("pool") + F.col("external")
    sizes = (counts.withColumn("goal", F.floor(total.cast("double") * F.lit(float(train))).cast("bigint"))
             .withColumn("dev", F.floor((total - F.col("goal")) / 2).cast("bigint"))
             .withColumn("moved", F.col("dev") + F.col("goal") - F.col("pool")))
    checked = F.when((F.col("moved") >= 0) & (F.col("moved") <= F.col("external")), F.col("moved"))
    return sizes.select(
        *by, "pool", "external", "dev",
        F.coalesce(checked, F.raise_error(F.lit("test set cannot supply the rows to move"))
                   .cast("bigint")).alias("moved"),
        (F.col("pool") + F.col("moved") - F.col("dev")).alias("train"),
        (F.col("external") - F.col("moved")).alias("test"))


def rebalance(pool: DataFrame, test: DataFrame, sizes: DataFrame, by: Sequence[str],
              key: Sequence[str], seed: int = SEED, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Pool and test rows with ``part``: ``pool``, ``moved`` (test rows that join the pool), ``test``."""
    if not by:
        by, test, sizes = [ALL], test.withColumn(ALL, F.lit(0)), stage(sizes, "sizes")
    drawn = label_by_rank(with_hash(test, key, seed), by, DRAW, hash_digits("h"),
                          sizes.select(*by, "moved"), ["moved"], "test", "part", leaf_rows).drop(*DRAW)
    return pool.withColumn("part", F.lit("pool")).unionByName(drawn.drop(ALL), allowMissingColumns=True)


@any_group
def rebalanced(pool: DataFrame, test: DataFrame, by: Sequence[str], key: Sequence[str], strata: str | None = None,
               train: float = 0.7, seed: int = SEED, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``rebalance`` and the draw of dev from one table of both sides: ``part``, and with ``strata`` also ``split``.

    Pool rows come first in the order of the cut, so the pool and the rows that
    move are its first ``train + dev`` rows, and that number follows from the
    rows of both sides together: one histogram gives sizes and moves.  A second
    one, of the rows that are left to fit on, gives the shares of each class and
    the cells of their cuts.  Both sides are written once, with their draw order.
    """
    by = list(by)
    both = pool.withColumn("side", F.lit(0)).unionByName(test.withColumn("side", F.lit(1)), allowMissingColumns=True)
    rows = with_hash(both, key, seed)
    goal = F.floor(F.col("n").cast("double") * F.lit(float(train))).cast("bigint")
    dev = F.floor((F.col("n") - goal) / 2).cast("bigint")
    order = ["side", *DRAW]
    first, *later = hash_digits("h")
    cuts = rank_cuts(rows, by, order, [F.concat("side", first), *later],
                     [(goal + dev).alias("fit"), dev.alias("wanted")], ["fit"], leaf_rows, ["wanted"])
    fit = F.coalesce(F.struct(*order) <= F.col("cut_fit"), F.lit(False))
    marked = join_null_safe(rows, cuts, by, "left").withColumn("fit", fit).drop("cut_fit", "wanted")
    inside, short = F.col("side") == 0, F.lit("test set cannot supply the rows to move")
    part = (F.when(inside & F.col("fit"), "pool").when(inside, F.raise_error(short).cast("string"))
            .when(F.col("fit"), "moved").otherwise("test"))
    if strata is None:
        return marked.withColumn("part", part).drop("side", "fit", *DRAW)

    def shares(counts: DataFrame) -> DataFrame:
        return quotas(join_null_safe(counts, cuts.select(*by, "wanted"), by), by, strata, F.col("wanted"), "dev")

    held = rank_cuts(marked.filter("fit"), [*by, strata], DRAW, hash_digits("h"), shares, ["dev"], leaf_rows)
    split = (F.when(F.col("part") == "test", "test").when(F.struct(*DRAW) <= F.col("cut_dev"), "dev")
             .otherwise("train"))
    return (join_null_safe(marked.withColumn("part", part), held, [*by, strata], "left")
            .withColumn("split", split).drop("side", "fit", "cut_dev", *DRAW))


@any_group
def split_positional(df: DataFrame, by: Sequence[str], source: str, position: str,
                     percent: int = 75, first: str = "train", rest: str = "eval",
                     leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The first ``percent`` of the rows of each group, in source order, and the rest.

    Counted per block of source ids, so no row is sorted or moved.
    """
    rows = stage(df, "lines")
    sizes = [F.expr(f"n * {int(percent)} div 100").alias(first)]
    return label_by_rank(rows, by, [source, position], id_digits(rows, source), sizes, [first], rest,
                         leaf_rows=leaf_rows)


@any_group
def split_positional_shuffled(df: DataFrame, by: Sequence[str], key: Sequence[str], percent: int = 75,
                              first: str = "train", rest: str = "eval", seed: int = SEED,
                              leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """As ``split_positional`` on lines put in draw order first."""
    rows = with_hash(df, key, seed)
    sizes = [F.expr(f"n * {int(percent)} div 100").alias(first)]
    return label_by_rank(rows, by, DRAW, hash_digits("h"), sizes, [first], rest,
                         leaf_rows=leaf_rows).drop(*DRAW)


def number_rows(df: DataFrame, order: Sequence[Column | str], number: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in the given order, from ``first``; missing values come first.

    Rows are dealt out by ranges and sorted where they lie.  The stored table
    keeps partition and place in one number, so what is missing is one count for
    each partition, added up on the driver: no task sees more than its range.
    Over distinct values this is their dense rank.
    """
    place = "place_in_range"
    sorted_ = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        place, F.monotonically_increasing_id()), "ranges")
    range_ = F.shiftright(place, 33)
    # one row for each partition
    sizes = sorted(tuple(r) for r in sorted_.groupBy(range_.alias("range")).count().collect())
    starts = [(r, s) for (r, _), s in zip(sizes, accumulate((n for _, n in sizes), initial=first))]
    offsets = df.sparkSession.createDataFrame(starts, "range bigint, start bigint")
    return (sorted_.withColumn("range", range_).join(F.broadcast(offsets), "range")
            .withColumn(number, F.col("start") + F.col(place).bitwiseAND((1 << 33) - 1)).select(*df.columns, number))


def class_partition(df: DataFrame, column: str, sizes: dict[str, int], rest: str,
                    seed: int = SEED) -> DataFrame:
    """Shuffle the classes and cut them into parts: ``column, class_rank, part``.

    Works on the class table, one row per class, which may be of any size.
    """
    classes = df.select(column).distinct().withColumn("h", hash_key(F.col(column).cast("string"), seed=seed))
    ranked = number_rows(classes, ["h", column], "class_rank", 1).drop("h").withColumn("class_rank", F.col("class_rank").cast("int"))
    part, total = F.when(F.lit(False), rest), 0
    for name, size in sizes.items():
        total += size
        part = part.when(F.col("class_rank") <= total, name)
    return ranked.withColumn("part", part.otherwise(rest))
