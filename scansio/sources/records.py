"""Records of one large JSON value, read in many tasks.

A JSON array or object has no line breaks to split at, so a file of it is one
task for a JSON reader.  Here the file is read in pieces that end at a closing
brace, which Spark splits like lines.  Whether a brace ends a record depends on
all that stands before it: whether a string is open there, and how deep the
braces are.  Both are sums over the pieces before, so each is found by a running
sum inside a block of the file and the sums of the blocks before it:

1. the parity of quotes before a piece says whether it starts inside a string;
2. with that known, the braces of a piece count, and their sum is the depth;
3. a piece that comes down to the depth of a record ends one, and the number of
   such pieces before it is its record's number.

This takes numbers alone, a few bytes for a piece, and what it finds is a row for
each block: where its first record ends, and which block that record begins in.
Then the files are read once more, and each piece goes to the block that its
record begins in, where records are numbered, put together and parsed.  So the
text is moved once and stored nowhere else; a block is never read by a task that
has another one, and rows of different blocks meet only for a record between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scansio.session import bounded, stage

#: A piece's place: file, block of the file, row in the block.
BLOCK = ["file", "block"]


def outside(piece: Column) -> Column:
    """What of a piece that starts outside a string lies outside strings."""
    return F.regexp_replace(piece, '"[^"]*("|$)', "")


def braces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row, value``, sizes, and what a piece adds: quotes, and braces for either way it may start."""
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("bytes"),
        F.monotonically_increasing_id().alias("row"), "value")
    # patterns are matched only where there is something to find; what is outside for one way of starting is inside for the other
    plain = read.withColumn("plain", F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"\\.", "")).otherwise(F.col("value")))
    opened = plain.withColumn("opened", braces(F.col("plain"))).withColumn(
        "open_outside", F.when(F.col("opened") == 0, 0).otherwise(braces(outside(F.col("plain")))))
    return opened.select(
        *BLOCK, "length", "row", "value", "bytes", (F.length("plain") - F.length(F.replace("plain", F.lit('"')))).alias("quotes"),
        "open_outside", (F.col("opened") - F.col("open_outside")).alias("open_inside"))


def before(amount: Column, *rows: str) -> Column:
    """The sum of ``amount`` over all rows before in the order of ``rows[1:]``, among those of one ``rows[0]`` of a file."""
    over = Window.partitionBy("file", rows[0]).orderBy(*rows[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount.cast("bigint")).over(over), F.lit(0))


def in_blocks(read: DataFrame, depth: int) -> DataFrame:
    """One row for each block of a file.

    ``least`` and ``most``: its rows; ``first_end``: the last row of the record that
    goes on from before, none if that does not end here and -1 where a file begins;
    ``began`` and ``began_at``: the block that this record begins in and the number
    of the first record that begins there; ``here_at``: the number of the first that
    begins in this block; ``last_row``, ``final`` and ``broken``: the file's last row,
    if it is here, whether that has no brace, and whether no whole value ends there.
    """
    numbers = stage(read.select(*BLOCK, "length", "row", "bytes", (F.octet_length("value") + 1).alias("size"), (F.col("quotes") % 2).alias("odd"),
                                "open_outside", "open_inside"), "pieces")
    # one row for each file; a file that ends with a brace has no piece without one
    ends = numbers.groupBy("file").agg(F.max(F.struct("block", "row")).alias("end"), (F.sum("size") - F.max("bytes")).alias("more"))
    whole = F.when(F.col("more").isin(0, 1), F.col("more") == 1).otherwise(
        F.raise_error(F.concat(F.lit("not a plain text file: "), "file")).cast("boolean"))
    ends = bounded(ends.select("file", "end", whole.alias("whole")), "ends")
    # brought to the pieces: dealt by file, those of a large file would meet in one task
    known = numbers.join(ends, "file").withColumn("is_last", F.struct("block", "row") == F.col("end")).withColumn(
        "final", F.col("is_last") & F.col("whole"))
    # for a block that starts outside a string, and for one that starts inside
    turned = known.withColumn("turns", before(F.col("odd"), "block", "row") % 2)
    deltas = turned.withColumns({f"delta{p}": delta(F.col("turns") + p) for p in (0, 1)})
    deep = stage(deltas.select(*BLOCK, "length", "row", "odd", "turns", "is_last", "final", "delta0", "delta1",
                               *[(before(F.col(f"delta{p}"), "block", "row") + F.col(f"delta{p}")).alias(f"after{p}") for p in (0, 1)]), "deep")
    blocks = deep.groupBy(*BLOCK).agg(F.sum("odd").alias("odd"), *[F.sum(f"delta{p}").alias(f"delta{p}") for p in (0, 1)])
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("starts", F.coalesce(F.sum("odd").over(by_file), F.lit(0)) % 2)
    down = F.when(F.col("starts") == 1, F.col("delta1")).otherwise(F.col("delta0"))
    blocks = bounded(blocks.select(*BLOCK, "starts", F.coalesce(F.sum(down).over(by_file), F.lit(0)).alias("depth")), "blocks")
    after = F.col("depth") + F.when(F.col("starts") == 1, F.col("after1")).otherwise(F.col("after0"))
    open_at_end = (F.col("turns") + F.col("starts") + F.col("odd")) % 2 == 1
    ended = ~F.col("final") & ~open_at_end & (after == depth)
    # an array ends with a bracket, so behind its last brace
    broken = F.col("is_last") & (open_at_end | (after != 0) | (~F.col("final") if depth == 0 else F.lit(False)))
    found = deep.join(blocks, BLOCK).groupBy(*BLOCK, "length").agg(
        F.min("row").alias("least"), F.max("row").alias("most"), F.min(F.when(ended, F.col("row"))).alias("first_end"),
        F.sum(ended.cast("bigint")).alias("ended"), F.max(F.when(F.col("is_last"), F.col("row"))).alias("last_row"),
        F.max("final").alias("final"), F.max(broken).alias("broken"))
    # one row for each block of a file
    number = F.coalesce(F.sum("ended").over(by_file), F.lit(0))
    opens = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    found = found.withColumn("here_at", F.when(opens, 0).otherwise(number + 1)).withColumn("first_end", F.when(opens, -1).otherwise(F.col("first_end")))
    origin = F.last(F.when(F.col("first_end").isNotNull(), F.struct(F.col("block").alias("began"), F.col("here_at").alias("began_at"))),
                    ignorenulls=True).over(by_file)
    return bounded(found.withColumn("origin", origin).select(*BLOCK, "length", "least", "most", "first_end", "origin.*", "here_at", "last_row",
                                                             "final", "broken"), "in_blocks")


def delta(quotes_before: Column) -> Column:
    """How much deeper a piece ends than it starts, with so many quotes before it: its own brace counts outside strings."""
    open_at_end = (quotes_before + F.col("odd")) % 2 == 1
    return F.when(quotes_before % 2 == 1, F.col("open_inside")).otherwise(F.col("open_outside")) - F.when(
        F.col("final") | open_at_end, 0).otherwise(1)


def records(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """``file, record, value, last`` for each record of the JSON value in each file.

    A record ends where the braces come back to ``depth``: 0 for an array of
    objects, 1 for an object of objects.  ``value`` also holds what stands before
    the record, ``last`` marks what stands behind the last one.  A file that ends
    inside a string or at another depth is an error.
    """
    read = pieces(spark, path)
    known = read.drop("bytes").join(in_blocks(read, depth), [*BLOCK, "length"], "left")
    # both readings must cut and number the files alike
    alike = F.coalesce(F.col("row").between(F.col("least"), F.col("most")), F.lit(False))
    is_last, goes_on = F.coalesce(F.col("row") == F.col("last_row"), F.lit(False)), F.col("first_end").isNull() | (F.col("row") <= F.col("first_end"))
    # the file's own name in the error, and no row of a broken file
    value = F.when(~alike, F.raise_error(F.concat(F.lit("changed while it was read: "), "file")).cast("string")).when(
        is_last & F.col("broken"), F.raise_error(F.concat(F.lit("not a whole JSON value: "), "file")).cast("string")).otherwise(
        F.concat("value", F.when(is_last & F.col("final"), "").otherwise("}")))
    homes = known.select(*BLOCK, "row", value.alias("value"), (F.col("quotes") % 2).alias("odd"), "open_outside", "open_inside",
                         (is_last & F.col("final")).alias("final"), F.when(goes_on, F.col("began")).otherwise(F.col("block")).alias("home"),
                         F.when(goes_on, F.col("began_at")).otherwise(F.col("here_at")).alias("at"))
    place = ["home", "block", "row"]
    # a home starts behind the end of a record, but for a file's first
    turned = homes.withColumn("turns", before(F.col("odd"), *place) % 2).withColumn("delta", delta(F.col("turns")))
    after = F.when(F.col("at") == 0, 0).otherwise(depth) + F.col("before") + F.col("delta")
    ends = ~F.col("final") & ((F.col("turns") + F.col("odd")) % 2 == 0) & (after == depth)
    deep = turned.withColumn("before", before(F.col("delta"), *place)).withColumn("ends", ends.cast("int"))
    numbered = deep.withColumn("record", F.col("at") + before(F.col("ends"), *place))
    parts = numbered.select("file", "home", "record", F.struct("block", "row", "value").alias("part"), "ends")
    # the pieces of a home are together
    return parts.groupBy("file", "home", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "").alias("value"),
        (F.max("ends") == 0).alias("last")).drop("home")


def checked(value: Column, pattern: str, file: Column) -> Column:
    """The first group of the pattern, which the whole value must match."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1)).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON value of records: "), file)).cast("string"))


def read_array(spark: SparkSession, path: str, schema: T.StructType, order: str = "line_id") -> DataFrame:
    """The objects of JSON arrays, one array to a file of any size, with their place in ``order`` (file, record).

    Other elements than objects, a truncated file, and fields of other types are errors.
    """
    found = records(spark, path)
    whole = F.when(F.col("last"), checked(F.col("value"), r"(?s)^\s*\[?\s*(\])\s*$", F.col("file"))).otherwise(
        checked(F.col("value"), r"(?s)^\s*[\[,]\s*(\{.*\})$", F.col("file")))
    parsed = found.select("file", "record", "last", whole.alias("value")).filter(
        ~F.col("last") | F.isnull("value")).withColumn("one", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return parsed.select(*[F.col(f"one.`{f.name}`") for f in schema], F.struct("file", "record").alias(order))


def read_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``key, value`` of JSON objects of objects, one object to a file of any size; ``schema`` is that of the values.

    Entries may be null; a truncated file is an error.
    """
    found = records(spark, path, 1)
    rest = checked(F.col("value"), r"(?s)^\s*[{,]?(.*)$", F.col("file"))
    entries = F.concat(F.lit("{"), rest, F.when(F.col("last"), "").otherwise("}"))
    parsed = F.from_json(entries, f"map<string,{schema}>", {"mode": "FAILFAST"})
    return found.select(F.explode(parsed).alias("key", "value"))
