import re
import sys

from pyspark.sql import functions as F

from scansio.functions import text as X
from scansio.operators.filters import drop_junk


def apply(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("s")).alias("x")).collect()]


def test_deletions_follow_one_another(spark):
    cases = {
        "/“/ab": "ab", "/,/x": "//x", "//a////b/ //": "ab/", " .": "", "": "", "a//b": "ab", "///": "/",
        "\xa0a b\x1c c \x85": "a b c", " «Hola», dijo; adiós. ": "Hola dijo adiós",
        "\tuno\n\n dos\r\n": "uno dos", "a  b": "a b",
    }
    assert apply(spark, list(cases), X.clean_text) == list(cases.values())
    assert apply(spark, ["  ¡AY, “Él”!  "], X.clean_text_lower) == ["¡ay él!"]
    assert apply(spark, [None], X.clean_text) == [None]


def test_whitespace_is_what_python_calls_whitespace(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    want = {c for c in points if re.fullmatch(r"\s", chr(c))}
    rows = spark.range(1, sys.maxunicode + 1).filter("id < 55296 or id > 57343")
    # four bytes of UTF-32 make any code point
    text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    squeezed = X.squeeze_whitespace(F.concat(F.lit("a"), text, F.lit("b")))
    got = {r.id for r in rows.filter(squeezed == "a b").select("id").collect()}
    assert got == want


def test_labels_and_lines(spark):
    assert apply(spark, [None, "None", "soneto"], X.clean_label) == ["unknown", "unknown", "soneto"]
    assert apply(spark, ["  a \t b  ", "a\xa0 b"], X.squeeze_line) == ["a b", "a\xa0 b"]


def test_junk_lines(spark):
    values = ["", "===", "* * *", "\\dd", "12", "a", "= b", "== "]
    rows = spark.createDataFrame([(v,) for v in values], "value string")
    assert [r.value for r in drop_junk(rows).collect()] == ["12", "a", "= b", "== "]
    assert "12" not in [r.value for r in drop_junk(rows, digits=True).collect()]
    assert "\\dd" in [r.value for r in drop_junk(rows, digits=True).collect()]


def test_tokens(spark):
    assert apply(spark, ["L'Amour, est-il? (oui)"], X.tokenise) == [["l'amour", "est", "il", "oui"]]
    assert apply(spark, ["...", ""], X.tokenise) == [[], []]
    assert apply(spark, ["The cat, a dog & an  Owl!"], X.normalise_answer) == ["cat dog owl"]
    assert apply(spark, ["España, a año; theía an"], X.normalise_answer) == ["españa año theía"]


def test_stream_takes_the_same_expressions(spark, tmp_path):
    source = str(tmp_path / "lines")
    spark.createDataFrame([("“Uno”, dos",), ("tres.",)], "value string").write.text(source)
    stream = spark.readStream.schema("value string").text(source).select(X.clean_text("value").alias("text"))
    query = (stream.writeStream.format("memory").queryName("cleaned")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    query.processAllAvailable()
    query.stop()
    assert sorted(r.text for r in spark.table("cleaned").collect()) == ["Uno dos", "tres"]
