"""JSON arrays and objects read in pieces, against a reader of whole files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scansio import schema as S
from scansio.sources import readers, records


def lines(n, seed=1):
    draw = random.Random(seed)
    odd = ["}", "{", "\"", "\\", "],[", "\\\"}", "é", "\n", " ", "null", "{\"a\": 1}", "𝄞"]
    return [{"line_text": "".join(draw.choices(odd, k=draw.randint(0, 12))), "metrical_pattern": draw.choice(["+-", None, "}"]),
             "manually_checked": draw.random() < 0.5, "more": [{"x": {}}, "}"]} for _ in range(n)]


@pytest.fixture
def blocks(spark):
    """Files are split every 512 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_arrays(spark, tmp_path, blocks):
    """Strings with braces, quotes and backslashes, nested values, any white space, several files, an empty array."""
    made = lines(200)
    (tmp_path / "a.json").write_text(json.dumps(made[:120], indent=2, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" \n[" + ",\n".join(json.dumps(x) for x in made[120:]) + "]\n\n")
    (tmp_path / "c.json").write_text("[ ]")
    got = readers.read_lines(spark, str(tmp_path), split=True)
    assert records.pieces(spark, str(tmp_path)).select("block").distinct().count() > 20
    rows = got.orderBy("line_id").collect()
    assert [(r["line_text"], r["metrical_pattern"], r["manually_checked"]) for r in rows] == [
        (x["line_text"], x["metrical_pattern"], x["manually_checked"]) for x in made]
    whole = readers.read_lines(spark, str(tmp_path)).drop("line_id").filter("manually_checked is not null")
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.drop("line_id").collect()))


def test_maps(spark, tmp_path, blocks):
    poems = {f"k}}{i}": None if i % 3 == 0 else {"text": f"t{{{i}\" \\ }}", "x": {"y": [1]}} for i in range(90)}
    for name, part in (("a", dict(list(poems.items())[:50])), ("b", dict(list(poems.items())[50:])), ("c", {}), ("d", {"only": None})):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=1))
    got = readers.read_poem_map(spark, str(tmp_path), split=True).collect()
    assert {r["poem_id"]: r["text"] for r in got} == {k: v["text"] for k, v in poems.items() if v} and len(got) == 60
    assert sorted(map(str, got)) == sorted(map(str, readers.read_poem_map(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("text", ['[{"line_text": "a"}, {"line_text": "b"', '[{"line_text": "a"}', '[{"line_text": "a"} {"line_text": "b"}]',
                                  '[1, {"line_text": "a"}]', '[{"line_text": "a}]', '{"line_text": "a"}', '[{"line_text": "a"}] x', '[{"manually_checked": "x"}]'])
def test_broken_arrays_are_errors(spark, tmp_path, blocks, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        readers.read_lines(spark, str(tmp_path / "a.json"), split=True).collect()


def test_other_names_and_missing_languages(spark, tmp_path):
    from scansio.sources import writers

    rows = spark.createDataFrame([("a", "+", None, 1, "de", "train"), ("b", "-", None, 1, "es", "train")], S.SPLIT_ROW)
    writers.write_splits(rows, str(tmp_path / "s"))
    assert [r["text"] for r in readers.read_splits(spark, str(tmp_path / "s"), ["ge"]).collect()] == ["a"]
    assert readers.read_splits(spark, str(tmp_path / "s"), ["multi"]).count() == 2
    with pytest.raises(FileNotFoundError, match="en"):
        readers.read_splits(spark, str(tmp_path / "s"), ["en"])


def test_pieces_of_a_file_do_not_meet(spark, tmp_path, monkeypatch):
    """No join deals pieces by file alone, and large inputs are several files, each one value."""
    from scansio.checks import sources
    rows = spark.range(400).select("id", F.format_string('{"line_text": "a }%d", "metrical_pattern": "+"}', "id").alias("value"))
    monkeypatch.setattr(sources, "FILE_BYTES", 4000)
    sources._large_files(rows, ["id"], f"{tmp_path}/many", "[]")
    files = sorted(p for p in (tmp_path / "many").iterdir() if p.name.startswith("part-"))
    assert len(files) > 3 and all(p.stat().st_size < 12000 for p in files)
    found = [x["line_text"] for p in files for x in json.loads(p.read_text())]
    assert found == [f"a }}{i}" for i in range(400)]
    back = readers.read_lines(spark, f"{tmp_path}/many", split=True)
    assert sorted(r["line_text"] for r in back.collect()) == sorted(found)
    seen, real = [], records.stage

    def staged(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(records, "stage", staged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records.records(spark, f"{tmp_path}/many").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and not [p for p in seen if re.search(r"SortMergeJoin \[file#\d+\],", p)]


def test_text_is_stored_nowhere_but_in_its_files(spark, tmp_path, blocks, monkeypatch):
    """Splitting stages a few bytes for a piece and moves its text once; values staged for large files go with their shuffle."""
    import os
    from scansio.checks import sources
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = spark.range(300).select("id", F.format_string('{"line_text": "%s", "metrical_pattern": "}"}', F.repeat(F.sha2(F.col("id").cast("string"), 256), 8)).alias("value"))
    monkeypatch.setattr(sources, "FILE_BYTES", 60000)
    sources._large_files(rows, ["id"], f"{tmp_path}/many", "[]")
    assert set(os.listdir(folder)) == before
    found = records.records(spark, f"{tmp_path}/many")
    new = [os.path.join(at, x) for name in set(os.listdir(folder)) - before for at, _, xs in os.walk(os.path.join(folder, name)) for x in xs if x.endswith(".parquet")]
    columns = {c for p in new for c in spark.read.parquet(p).columns}
    assert new and "value" not in columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert found.filter("not last").count() == 300


def test_records_between_blocks(spark, tmp_path):
    """Records longer than a block, shorter than one, and blocks without the end of any, whatever strings hold."""
    made = [{"line_text": "{}\"\\[" * n, "metrical_pattern": None, "manually_checked": True} for n in (1, 400, 0, 3, 900, 2, 2, 60)]
    (tmp_path / "a.json").write_text(json.dumps(made))
    (tmp_path / "b.json").write_text(json.dumps(made[::-1], indent=1))
    for size in ("512", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = readers.read_lines(spark, str(tmp_path), split=True).orderBy("line_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r["line_text"] for r in rows] == [x["line_text"] for x in made + made[::-1]]
        assert [r["line_id"]["record"] for r in rows] == [*range(8)] * 2
