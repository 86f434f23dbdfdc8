import json

import pytest
from pyspark.sql import functions as F

from scansio import schema as S
from scansio.operators import dedup
from scansio.plans import corpus
from scansio.sources import readers, writers
from tests.plans import plan_text


def test_json_arrays_in_order(spark, tmp_path):
    lines = [{"line_text": f"verso {i % 3}", "metrical_pattern": "+" * i, "manually_checked": i % 2 == 0, "x": 1}
             for i in range(12)]
    (tmp_path / "a.json").write_text(json.dumps(lines[:6], indent=1))
    (tmp_path / "b.json").write_text(json.dumps(lines[6:]))
    rows = readers.read_corpus(spark, str(tmp_path), S.ADSO)
    assert rows.count() == 12 and {"corpus", "lang", "text", "meter", "line_id"} <= set(rows.columns)
    first = dedup.dedup_first(rows.select("text", "meter", "line_id"), ["text"], ["line_id"]).collect()
    assert {r.text: len(r.meter) for r in first} == {"verso 0": 0, "verso 1": 1, "verso 2": 2}


def test_csv_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [('say "hi", you', "a"), ("two\nlines", "b"), ("  kept  ", "c"), ("back\\slash", None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "Stanza_text string, ST_Correct string").write.csv(path, header=True, **writers.CSV)
    got = readers.read_corpus(spark, path, S.STANZAS).select("text", "stanza").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(text=a, stanza=b)) for a, b in rows)


def test_files_of_splits_follow_their_size(spark, tmp_path):
    """Six small folders are six files; a folder with most of the bytes is cut at the advisory size."""
    names = spark.range(0, 40_000, numPartitions=16).select(
        F.when(F.col("id") % 8 == 0, F.concat(F.lit("l"), F.col("id") % 3)).otherwise("l0").alias("lang"),
        F.when(F.col("id") % 16 == 0, "dev").otherwise("train").alias("split"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("text"),
        F.lit("+-").alias("meter"), F.lit(2).alias("length"))
    writers.write_splits(names, str(tmp_path / "few"))
    files = [str(p.parent.relative_to(tmp_path / "few")) for p in (tmp_path / "few").rglob("part-*")]
    assert len(files) == len(set(files)) == 6
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(1 << 20))
    try:
        writers.write_splits(names, str(tmp_path / "cut"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = [str(p.parent.relative_to(tmp_path / "cut")) for p in (tmp_path / "cut").rglob("part-*")]
    assert files.count("lang=l0/split=train") > 1 and len(files) < 3 * 16
    assert readers.read_splits(spark, str(tmp_path / "cut"), None).count() == 40_000


def test_raw_lines_break_at_newlines_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("uno\rdos\n\ntres\n".encode())
    (tmp_path / "extra.txt").write_bytes(b"cuatro\n")
    main, extra = str(tmp_path / "a.txt"), str(tmp_path / "extra.txt")
    rows = readers.read_raw_lines(spark, main).orderBy("line_id").collect()
    assert [r.value for r in rows] == ["uno\rdos", "", "tres"]
    assert readers.read_raw_lines(spark, main, extra).count() == 4


def test_last_vector_wins_across_blocks(spark, tmp_path):
    lines = ["900 2"] + [f"w{i % 300} {i} {i + 1} " for i in range(900)]
    (tmp_path / "v.vec").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {r.word: list(r.vector) for r in readers.read_vectors(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"w{i}": [600.0 + i, 601.0 + i] for i in range(300)}


def test_poem_map_drops_nulls(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"1": {"text": "a\nb", "title": "t"}, "2": None, "3": {"text": "c"}}, indent=2))
    got = {r.poem_id: r.text for r in readers.read_poem_map(spark, str(tmp_path)).collect()}
    assert got == {"1": "a\nb", "3": "c"}


def test_labelled_lines(spark, tmp_path):
    rows = spark.createDataFrame([("el mar", "-+"), ("sin nada", "--"), ("", "+")], "text string, meter string")
    path = str(tmp_path / "l")
    writers.write_labelled(rows, path)
    raw = sorted(r.value for r in spark.read.text(path).collect())
    assert raw == [" sin nada", "__label__syll-1 ", "__label__syll-2 el mar"]
    got = {r.text: r.labels for r in readers.read_labelled(spark, path).collect()}
    assert got == {"el mar": ["__label__syll-2"], "sin nada": [], "": ["__label__syll-1"]}


def test_run_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "# heading\n\n- Accuracy [es:es]: 0.5 (own/model)\n- Accuracy [multi]: 0.25 (b)\n"
        "- Accuracy [es:es]: 0.5 (own/model)\nAccuracy EVAL [x:y]: 1 (z)\nINFO:root:SOTA [x:y]: 1e-05\nAccuracy: 0.5\n")
    got = readers.read_run_log(spark, str(tmp_path)).orderBy("line_id").drop("line_id").collect()
    assert [tuple(r) for r in got] == [
        ("es", "es", "accuracy", "own/model", 0.5), ("multi", "multi", "accuracy", "b", 0.25),
        ("es", "es", "accuracy", "own/model", 0.5), ("x", "y", "eval", "z", 1.0), ("x", "y", "sota", None, 1e-05)]


def test_splits_read_only_the_languages_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([("a, “b”", "+", None, 1, "es", "train"), ("c", "-", "-", 1, "en", "test")], S.SPLIT_ROW)
    path = str(tmp_path / "s")
    writers.write_splits(rows, path)
    got = readers.read_splits(spark, path, ["es"])
    assert [tuple(r) for r in got.collect()] == [("a, “b”", "+", None, 1, "es", "train")]
    assert "(lang" in plan_text(got).split("PartitionFilters")[1]
    assert readers.read_splits(spark, path, ["multi"]).count() == 2


def test_delimited_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "es.csv").write_text("id,rantanplan,line_text,metrical_pattern\n7,--,\"Uno, dos\",+-\n")
    row = readers.read_corpus(spark, str(tmp_path), S.ADSO_SCANNED).first()
    assert (row.text, row.meter, row.sota, row.lang) == ("Uno, dos", "+-", "--", "es")
    with pytest.raises(ValueError, match="no column verse"):
        readers.read_corpus(spark, str(tmp_path), S.PO_EMO)


def test_splits_without_a_baseline(spark, tmp_path):
    """The layout of prepared files: train and dev have no baseline column."""
    for split, head, line in (("train", "text,meter,length", "a,++,2"), ("test", "text,meter,sota,length", "b,+-,--,2")):
        (tmp_path / "lang=es" / f"split={split}").mkdir(parents=True)
        (tmp_path / "lang=es" / f"split={split}" / "f.csv").write_text(f"{head}\n{line}\n")
    got = sorted(map(tuple, readers.read_splits(spark, str(tmp_path)).collect()))
    assert got == [("a", "++", None, 2, "es", "train"), ("b", "+-", "--", 2, "es", "test")]
    with pytest.raises(FileNotFoundError):
        readers.read_splits(spark, str(tmp_path / "lang=es"))


def test_written_splits_hold_the_contract(spark, tmp_path):
    rows = spark.createDataFrame([("x", "a", "+", 1, "es", "train", ("f", 1))],
                                 "corpus string, text string, meter string, length int, lang string, split string, "
                                 "line_id struct<file:string,row:int>")
    writers.write_splits(rows, str(tmp_path / "s"))
    assert [tuple(r) for r in readers.read_splits(spark, str(tmp_path / "s")).collect()] == [("a", "+", None, 1, "es", "train")]
    with pytest.raises(ValueError, match="no column meter"):
        writers.write_splits(rows.drop("meter"), str(tmp_path / "t"))


@pytest.mark.parametrize("name, text, read", [
    ("a.json", '[{"line_text": "x", "manually_checked": tru]', readers.read_lines),
    ("p.json", '{"1": {"text": "a"}, "2": {"te', lambda s, p: readers.read_poem_map(s, p)),
    ("v.vec", "9 2\nword 1 2\nalone\n", readers.read_vectors),
])
def test_broken_files_fail(spark, tmp_path, name, text, read):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception):
        read(spark, str(tmp_path)).collect()


def test_vectors_with_any_white_space(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 1\n a\t1.5\nb  2\n7 3.0\n")
    assert {r.word: list(r.vector) for r in readers.read_vectors(spark, str(tmp_path)).collect()} == {
        "a": [1.5], "b": [2.0], "7": [3.0]}


def test_places_of_lines_across_blocks(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{name} line {k}" for k in range(400)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = corpus.numbered_lines(readers.read_raw_lines(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.source, r.position): r.value for r in lines.collect()}
    assert got == {(i, k): f"{name} line {k}" for i, name in enumerate("ab") for k in range(400)}
