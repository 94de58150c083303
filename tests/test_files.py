"""Readers and writers: round trips, odd cells, archives, images, checkpoints, reports."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldweave.sinks import files as K
from fieldweave.sources import files as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_records(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,name,note\n1, nan ,"two\nlines, ""q"""\n2,NULL,x\n')
    rows = {r.id: r for r in S.records(spark, path, ["id", "country"], "id").collect()}
    assert rows["1"].name == "" and rows["1"].note == 'two\nlines, "q"' and rows["2"].country == ""
    path = put(tmp_path / "b.csv", "id,name\n,a\n7,b\n")
    first, again = (sorted(r.id for r in S.records(spark, path, ["id"], "id").collect()) for _ in range(2))
    assert first == again and all(i.startswith("record-") for i in first) and len(set(first)) == 2


def test_images_ids_and_aliases(spark):
    rows = spark.createDataFrame([("p1", "o1", "u.jpg", "x"), ("", "o2", "v.jpg", "y"), ("", "", "w.jpg", "z"), ("p4", "o4", " ", "q")], "persistentID string, occurrenceID string, jpegURL string, extra string")
    got = S.with_images(rows, "jpegURL", ["persistentID", "occurrenceID"], "id", ["jpegURL", "missing"])
    assert got.columns == ["id", "jpegURL"] and sorted(r.id for r in got.collect())[1:] == ["o2", "p1"]
    named = S.aliased(rows, {"id": ["occurrenceid"], "image": ["jpeg"], "country": ["land"]}, ["id", "image", "country"], 2, "image")
    assert sorted(r.id for r in named.collect()) == ["o1", "o2"]


def test_json_lines_and_families(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    K.json_lines(rows, f"{tmp_path}/j")
    K.json_lines(rows.filter("k = 1"), f"{tmp_path}/j")
    assert sorted(r.k for r in S.json_lines(spark, f"{tmp_path}/j", "k int, v string").collect()) == [1, 1, 2]
    put(tmp_path / "d" / "lean_x_outputs.jsonl", '{"k": 1}\n\n{"k": 2}\n')
    put(tmp_path / "d" / "old_y_outputs.jsonl", '{"k": 3}\n')
    assert S.by_family(spark, f"{tmp_path}/d", ["none", "lean"]).count() == 2 and S.by_family(spark, f"{tmp_path}/d", ["none"]).count() == 3


def test_splits(spark, tmp_path):
    a, b = put(tmp_path / "demo.csv", "id,x\n1,a\n2,b\n"), put(tmp_path / "eval.csv", "id,x\n3,c\n")
    assert {(r.id, r.split) for r in S.splits(spark, {"demo": a, "eval": b}, "id").collect()} == {("1", "demo"), ("2", "demo"), ("3", "eval")}
    with pytest.raises(ValueError, match="1"):
        S.splits(spark, {"demo": a, "eval": put(tmp_path / "c.csv", "id,x\n1,c\n")}, "id")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/a.jsonl", '{"k": 1}\r\n\n{"k": 2}')
        z.writestr("in/c.csv", "k\n1\n")
    assert [(r.archive, r.member, bytes(r.content)) for r in S.zip_members(spark, f"{tmp_path}/b.zip", ".csv").collect()] == [("b.zip", "in/c.csv", b"k\n1\n")]
    assert sorted(r.k for r in S.zip_lines(spark, f"{tmp_path}/b.zip", "k int").collect()) == [1, 2]


def test_image_files_and_names(spark, tmp_path):
    put(tmp_path / "i" / "a.png", b"\x89PNG\r\n\x1a\n" + b"0" * 100)
    put(tmp_path / "i" / "b.jpg", b"not an image" * 10)
    put(tmp_path / "i" / "c.jpg", b"\xff\xd8")
    assert {r.file: r.status for r in S.images(spark, f"{tmp_path}/i", 10).collect()} == {"a.png": "valid", "b.jpg": "undecodable", "c.jpg": "too_small"}
    rows = spark.createDataFrame([("_a b/ç.", "http://x/y.PNG?z=1"), (None, "http://x/y.exe")], "n string, u string")
    assert [tuple(r) for r in rows.select(S.safe_name(F.col("n")), S.suffix_of(F.col("u"))).collect()] == [("a_b", ".png"), ("", ".jpg")]


def test_csv_stages_and_stage_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b\nc', [1, 2]), (2, None, [])], "k int, v string, l array<int>")
    paths = K.stages({"eval": rows}, str(tmp_path), "v2_")
    assert sorted(paths) == ["eval", "v2_eval"]
    back = {r.k: r for r in S.records(spark, paths["v2_eval"], ["k"]).collect()}
    assert back["1"].v == 'a "q", b\nc' and back["1"].l == "[1,2]" and back["2"].v == ""
    assert S.stage_or(spark, f"{tmp_path}/none", lambda: rows.limit(0)).count() == 0
    rows.write.parquet(f"{tmp_path}/stage")
    assert S.stage_or(spark, f"{tmp_path}/stage", lambda: rows.limit(0)).count() == 2


def test_checkpoints_and_caches(spark, tmp_path):
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    seen = []

    def work(rows):
        seen.append(sorted(r.name for r in rows.collect()))
        return rows.withColumn("found", F.upper("name"))

    got = K.cached(spark, asked, f"{tmp_path}/c", "name", work)
    assert sorted((r.name, r.found) for r in got.collect()) == [("a", "A"), ("b", "B")]
    K.cached(spark, asked.unionByName(spark.createDataFrame([("z",)], "name string")), f"{tmp_path}/c", "name", work)
    assert seen == [["a", "b"], ["z"]]


def test_sanitised_required_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, json.dumps({"key": "s", "x": "1"}))], "eval_a int, raw_b int, meta string")
    assert [tuple(r) for r in K.sanitised(rows, ["eval_"], ["key"], "meta").collect()] == [(1, '{"x":"1"}')]
    with pytest.raises(FileNotFoundError, match="nothing"):
        K.require(spark, [str(tmp_path), f"{tmp_path}/nothing"])
    text = K.markdown(spark.createDataFrame([("a|b", 0.5), (None, None)], "k string, v double"), "T", 1)
    assert text.startswith("## T\n\n| k | v |") and "a\\|b | 0.500" in text and "Only the first 1" in text
    K.report({"T": rows}, f"{tmp_path}/r", spark)
    assert spark.read.text(f"{tmp_path}/r").filter("value like '## T%'").count() == 1
