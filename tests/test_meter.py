from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scansio.functions import meter as M


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("m")).alias("x")).collect()]


def test_encode_pads_and_cuts(spark):
    assert column(spark, ["+-+", "", "irregular", "+" * 5, None], lambda m: M.encode_meter(m, 4)) == [
        [1, 0, 1, 0], [0, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1], None]


def test_round_trip(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="+-", max_size=12), min_size=1, max_size=40))
    def run(patterns):
        decoded = column(spark, patterns, lambda m: M.fit_to_gold(M.decode_meter(M.encode_meter(m)), F.length(m)))
        assert decoded == patterns

    run()


def test_stress_forms(spark):
    assert column(spark, ["-+-+", "--", ""], M.stress_index) == [[1, 3], [], []]
    assert column(spark, ["-+-+"], M.stress_labels) == [["__label__syll-2", "__label__syll-4"]]
    assert column(spark, ["-+-+", "--"], M.stress_text) == ["2, 4", ""]
    assert column(spark, ["(+-)|-+"], M.strip_marks) == ["+--+"]


def test_threshold(spark):
    row = spark.createDataFrame([([0.5, 0.49, 0.9],)], "s array<double>")
    assert row.select(M.threshold_labels("s")).first()[0] == ["__label__syll-1", "__label__syll-3"]


def test_widen(spark):
    rows = spark.createDataFrame([("a", "+-"), ("b", "-++")], "text string, m string")
    wide = M.widen_from_data(rows, "m").orderBy("text")
    assert wide.columns == ["text", "m", "pos1", "pos2", "pos3"]
    assert [tuple(r)[2:] for r in wide.collect()] == [(1.0, 0.0, 0.0), (0.0, 1.0, 1.0)]
