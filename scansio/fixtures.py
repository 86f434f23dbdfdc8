"""Stand-in corpora derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansio.functions.text import delete_marks, squeeze_whitespace

# Stated so that no read opens a file to learn its columns.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a scan of fewer splits than cores: a test table may be one row group, which one task would clean.

    A scan of many splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "lang", "text", *columns), "doc_id")


def _pattern(stressed: str) -> str:
    return f"array_join(transform(split(text, ' '), w -> if({stressed}, '+', '-')), '')"


_MODEL = "length(w) >= 5 and not (length(w) = 5 and right(w, 1) = 'e')"


def verses(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated verse lines: text, gold pattern, shipped baseline and a model's output."""
    pieces = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n")
    # cleaned inside the array: a filter on a projected expression would clean twice
    marked = F.transform(pieces, lambda p: F.struct(p.alias("raw"), delete_marks(p).alias("text")))
    cleaned = F.transform(marked, lambda m: F.struct(m["raw"].alias("raw"),
                                                     squeeze_whitespace(m["text"]).alias("text")))
    lines = documents(spark, folder).select("doc_id", "lang", F.posexplode(cleaned).alias("pos", "line"))
    return (lines.filter("line.text <> ''").selectExpr("doc_id", "lang", "pos", "line.raw", "line.text")
            .selectExpr(
                "*", f"{_pattern('length(w) >= 5')} as meter", f"{_pattern('length(w) >= 6')} as sota",
                f"{_pattern(_MODEL)} as pred", "if(doc_id % 10 < 4, 'b', 'a') as source",
                "doc_id % 7 <> 0 as manually_checked",
                "transform(split(text, ' '), w -> "
                f"cast(if({_MODEL}, 5, 0) + length(w) % 5 as double) / 10) as scores")
            .selectExpr(
                "*", "length(meter) as length",
                "if((doc_id + pos) % 97 = 0, 'irregular', "
                "concat('(', substr(meter, 1, 2), ')|', substr(meter, 3))) as raw_pattern",
                "array(sota, pred, if(doc_id % 3 = 0, meter, pred)) as all_predicted"))


def stanzas(spark: SparkSession, folder: str) -> DataFrame:
    """Stanzas with a class; some classes are missing or the text ``None``."""
    stanza = (F.when(F.col("doc_id") % 50 == 0, F.lit(None).cast("string"))
              .when(F.col("doc_id") % 50 == 1, "None").otherwise(F.col("lang")))
    return documents(spark, folder).select(F.col("doc_id").alias("stanza_id"), "text", stanza.alias("stanza"))


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines of every document with their position."""
    return documents(spark, folder).select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "value"))


def vectors(spark: SparkSession, folder: str, vocab: DataFrame) -> DataFrame:
    """Word vectors of the vocabulary entries of even rank."""
    rows = table(spark, folder, "embeddings")
    even = vocab.filter(F.col("idx") % 2 == 0).select("word", F.col("idx").cast("bigint").alias("vec_id"))
    return rows.join(even, "vec_id").select("word", F.col("embedding").alias("vector"))
