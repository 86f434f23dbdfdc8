"""Vocabulary, padded sequences and embedding lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scansio.functions.text import tokenise
from scansio.operators.joins import join_null_safe
from scansio.operators.metrics import vector_moments
from scansio.operators.sampling import number_rows
from scansio.session import bounded, stage

MAX_FEATURES = 10_000
MAX_LENGTH = 24


def first_seen(source: str, position: str, place: str) -> Column:
    """Order of a token as one number: source, position, place in the line.

    A decimal is a fixed-width aggregation buffer, so the token count stays a
    hash aggregation; a struct would turn it into a sort of all tokens.  Room:
    19 digits of source id, 10 of position, 9 of place.
    """
    wide = "decimal(38,0)"
    return F.expr(
        f"cast(cast({source} as decimal(19,0)) * 10000000000000000000 as {wide})"
        f" + cast(cast({position} as decimal(10,0)) * 1000000000 + {place} as {wide})").cast(wide)


def token_counts(df: DataFrame, text: str, source: str, position: str) -> DataFrame:
    """Frequency and first occurrence per token, combined on the map side."""
    tokens = df.select(source, position, F.posexplode(tokenise(text)).alias("place", "word"))
    return tokens.groupBy("word").agg(
        F.count("*").alias("count"),
        F.min(first_seen(source, position, "place")).alias("seen"))


def vocabulary(df: DataFrame, text: str, source: str, position: str,
               max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features - 1`` commonest words, ranked from 1: ``word, count, idx``.

    Ties go to the word seen first.  Each task keeps its own best words, so the
    ranking window sees no more than the vocabulary.  The result is computed once.
    """
    order = [F.desc("count"), F.asc("seen")]
    top = token_counts(df, text, source, position).orderBy(*order).limit(max_features - 1)
    rank = F.row_number().over(Window.orderBy(*order))
    return bounded(top.withColumn("idx", rank).select("word", "count", "idx"), "vocabulary")


def vocabulary_by_threshold(df: DataFrame, text: str, source: str, position: str, max_features: int = MAX_FEATURES,
                            sample: int = 64, buckets: int = 1 << 18) -> DataFrame:
    """As ``vocabulary``, for corpora with far more different words than the vocabulary holds.

    Lines are read three times, so pass a staged table, and words that cannot
    make it are never shuffled one by one:

    1. One line in ``sample`` names candidates.  They decide the cost, not the result.
    2. Candidates are counted exactly over all lines, all other words together
       per hash bucket, so a task sends at most as many rows as there are
       candidates and buckets.  The count of the last candidate that would fill
       the vocabulary is the threshold.
    3. Words of buckets that reach the threshold are counted one by one.  A word
       in any other bucket is rarer than each of ``max_features - 1`` candidates.

    Fewer candidates than places make the threshold zero: all words are counted.
    """
    size = max_features - 1
    order = [F.desc("count"), F.asc("seen")]
    tokens = df.select(source, position, F.posexplode(tokenise(text)).alias("place", "word"))
    picked = df.filter(F.pmod(F.xxhash64(source, position), F.lit(sample)) == 0)
    candidates = bounded(token_counts(picked, text, source, position).orderBy(*order).limit(2 * size)
                         .select("word"), "candidates")
    counting = [F.count("*").alias("count"), F.min(first_seen(source, position, "place")).alias("seen")]
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    known = F.col("known").isNotNull()
    totals = stage(
        tokens.join(candidates.withColumn("known", F.lit(1)), "word", "left")
        .groupBy(F.when(known, F.col("word")).alias("word"), F.when(~known, bucket).alias("bucket"))
        .agg(*counting), "totals")
    exact = totals.filter(F.col("word").isNotNull()).select("word", "count", "seen")
    last = exact.orderBy(F.desc("count")).limit(size).agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    threshold = last["least"] if last["n"] == size else 0
    open_buckets = bounded(totals.filter(F.col("word").isNull() & (F.col("count") >= threshold)).select("bucket"), "buckets")
    others = (tokens.withColumn("bucket", bucket).join(open_buckets, "bucket", "left_semi")
              .join(candidates, "word", "left_anti").groupBy("word").agg(*counting))
    top = exact.unionByName(others).orderBy(*order).limit(size)
    rank = F.row_number().over(Window.orderBy(*order))
    return bounded(top.withColumn("idx", rank).select("word", "count", "idx"), "vocabulary")


def encode_tokens(df: DataFrame, key: Sequence[str], text: str, vocab: DataFrame,
                  partitioned: bool = False) -> DataFrame:
    """Lines as vocabulary indexes in word order; unknown words are dropped.

    Lines are shuffled whole, before they are exploded; the broadcast lookup
    keeps that partitioning, so words never move.  Pass ``partitioned`` for rows
    that come out of a shuffle on some of the ``key`` columns (``dedup_first``).
    """
    if not partitioned:
        df = df.repartition(*key)
    words = df.select(*key, F.posexplode_outer(tokenise(text)).alias("place", "word"))
    known = words.join(bounded(vocab.select("word", "idx"), "vocabulary"), "word", "left")
    item = F.when(F.col("idx").isNotNull(), F.struct("place", "idx"))
    return (known.groupBy(*key).agg(F.collect_list(item).alias("items"))
            .select(*key, F.transform(F.array_sort("items"), lambda x: x["idx"]).alias("sequence")))


def pad_tokens(sequence: Column | str, width: int = MAX_LENGTH) -> Column:
    """Zeros after short rows; long rows keep their last ``width`` items."""
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    tail = F.slice(s, F.greatest(F.size(s) - width + 1, F.lit(1)), F.lit(width))
    return F.concat(tail, F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(s), F.lit(0))))


def vector_lookup(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """``word, idx, vector`` with a lower-case fallback; unknown words keep a null.

    The vector table is far larger than the vocabulary, so it is first cut, in
    one scan, to the words asked for.
    """
    vocab = bounded(vocab.select("word", "idx"), "vocabulary")
    wanted = bounded(
        vocab.select("word").unionByName(vocab.select(F.lower("word").alias("word"))).distinct(), "wanted")
    hits = stage(vectors.join(wanted, "word", "left_semi"), "vectors")
    lower = hits.select(F.col("word").alias("lower_word"), F.col("vector").alias("lower_vector"))
    return (vocab.join(hits, "word", "left")
            .join(lower, F.lower("word") == F.col("lower_word"), "left")
            .select("word", "idx", F.coalesce("vector", "lower_vector").alias("vector")))


def vector_coverage(looked_up: DataFrame) -> DataFrame:
    known = F.col("vector").isNotNull().cast("bigint")
    return looked_up.agg(F.count("*").alias("words"), F.sum(known).alias("known"),
                         F.avg(known.cast("double")).alias("coverage"))


def gaussian(mean: Column, std: Column, *key: Column) -> Column:
    """A repeatable normal draw for a key (Box-Muller on two hashes)."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53) + 1)

    return mean + std * F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """One vector per vocabulary index: the known one, or a draw from N(mean, std) of the table."""
    moments = vector_moments(vectors, vector, width=True).first()
    width = moments["width"]
    found = vector_lookup(vocab, vectors)
    if not width:
        return found
    mean, std = F.lit(float(moments["mean"])), F.lit(float(moments["std"]))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(width)),
                        lambda d: gaussian(mean, std, F.col("word"), d).cast("float"))
    return found.select("idx", "word", F.coalesce("vector", drawn).alias("vector"),
                        F.col("vector").isNotNull().alias("known"))


def collate_tokens(df: DataFrame, batch: str, tokens: str, pad: int, left_pad: bool = False,
                   eos: int | None = None, move_eos_to_beginning: bool = False) -> DataFrame:
    """Pad token rows to the longest row of their batch, on the right or on the left.

    With ``move_eos_to_beginning`` the end marker goes first, and a row that does
    not end with it is an error.  The width per batch is a map-side maximum.
    """
    width = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("width"))
    row = F.col(tokens)
    if move_eos_to_beginning:
        last = F.get(row, F.size(row) - 1)
        moved = F.concat(F.slice(row, F.size(row), F.lit(1)), F.slice(row, F.lit(1), F.size(row) - 1))
        row = F.when(last.eqNullSafe(F.lit(eos)), moved).otherwise(
            F.raise_error(F.lit("a row does not end with the end marker")).cast("array<int>"))
    fill = F.array_repeat(F.lit(pad), F.col("width") - F.size(tokens))
    padded = F.concat(fill, row) if left_pad else F.concat(row, fill)
    return join_null_safe(df, width, [batch]).withColumn(tokens, padded).drop("width")


def label_index(df: DataFrame, column: str, index: str = "label") -> DataFrame:
    """0-based index of a class in the sorted class names; a missing class comes first.

    Classes are numbered by ranges, so there may be any number of them, and the
    class table is broadcast only as far as ``bounded`` allows.
    """
    numbered = number_rows(df.select(column).distinct(), [column], index).withColumn(index, F.col(index).cast("int"))
    return join_null_safe(df, bounded(numbered, "classes"), [column])
