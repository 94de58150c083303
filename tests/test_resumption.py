"""Interrupted and overlapping runs, restarted streams, checked images, frozen splits and stage files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fieldweave.sinks import files as K
from fieldweave.sinks import ledger
from fieldweave.sources import files as S
from fieldweave.sources import pictures
from fieldweave.streaming import resumable


def png(width=3, height=2):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


def jpeg(width=5, height=4):
    segment = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + segment(0xC0, frame) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 7, 6, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 7, 6, 0) + b"\x02\x02\x4c\x01\x00" + b"\x3b"


def tiff(order="<"):
    entries = [(256, 4, 1, 9), (257, 4, 1, 8), (273, 4, 1, 8), (279, 4, 1, 6)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 14)
    return head + b"pixels" + struct.pack(f"{order}H", 4) + b"".join(struct.pack(f"{order}HHII", *e) for e in entries) + b"\0" * 4


def webp():
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + bytes([9, 0, 0, 4, 0, 0])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp():
    return b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<Iii", 40, 2, -3) + b"\0" * 32


WHOLE = {"png": (png(), 3, 2), "jpeg": (jpeg(), 5, 4), "gif": (gif(), 7, 6), "tiff": (tiff(), 9, 8), "webp": (webp(), 10, 5), "bmp": (bmp(), 2, 3)}


@pytest.mark.parametrize("kind", WHOLE)
def test_every_cut_of_an_image_is_seen(kind):
    data, width, height = WHOLE[kind]
    assert pictures.inspect(data) == ("valid", kind, width, height)
    least = 8 if kind in ("png", "gif") else 4
    for n in range(least, len(data) - (4 if kind == "tiff" else 0)):
        assert pictures.inspect(data[:n])[0] in ("truncated", "invalid", "undecodable"), n
    assert pictures.inspect(tiff(">"))[:2] == ("valid", "tiff")


def test_broken_images():
    good = png()
    assert pictures.inspect(good[:20] + b"\xff" + good[21:])[0] == "invalid"  # a checksum
    assert pictures.inspect(png(0, 2))[0] == "invalid" and pictures.inspect(b"\xff\xd8\xff\xd9")[0] == "invalid"
    assert pictures.inspect(b"") == pictures.inspect(b"text") == ("undecodable", None, None, None)


def test_checked_files(spark, tmp_path):
    for name, data in {"a.png": png(), "b.jpg": jpeg(), "c.jpg": png(), "d.png": png()[:-5], "e.gif": b"", "f.jpg": b"text that is no image", "noname": jpeg()}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file"]: r for r in pictures.checked(spark, str(tmp_path), 1).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.png": "valid", "b.jpg": "valid", "c.jpg": "wrong_suffix", "d.png": "truncated", "e.gif": "too_small", "f.jpg": "undecodable", "noname": "wrong_suffix"}
    assert (got["b.jpg"]["width"], got["b.jpg"]["height"], got["c.jpg"]["kind"]) == (5, 4, "png")


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    path, asked = f"{tmp_path}/ledger", spark.createDataFrame([(i, f"m{i % 2}") for i in range(6)], "record int, method string").repartition(3)
    seen = []

    def work(rows):
        seen.append(rows.count())
        return rows.withColumn("answer", F.col("record") * 10)

    def fails(rows):
        return rows.withColumn("answer", F.when(F.col("record") < 5, F.col("record")).otherwise(F.raise_error(F.lit("stop"))))

    keys = ["record", "method"]
    with pytest.raises(Exception, match="stop"):
        ledger.resumed(spark, asked, path, keys, fails)
    assert ledger.kept(spark, path, keys) is None
    assert ledger.resumed(spark, asked.filter("record < 3"), path, keys, work).count() == 3
    # Two runs over the same rows, neither of which saw the other.
    for n in (1, 2):
        work(asked.filter("record >= 2")).withColumn("answer", F.lit(n)).write.parquet(f"{path}/run-overlap{n}")
    got = {r["record"]: r["answer"] for r in ledger.resumed(spark, asked, path, keys, work).collect()}
    assert sorted(got) == list(range(6)) and seen[-1] == 0 and got[5] == 1


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    source, out, at = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/at"
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("".join(f'{{"record": {r}, "method": "m"}}\n' for r in rows))
    stream = lambda: spark.readStream.schema("record long, method string").option("maxFilesPerTrigger", 1).json(str(source))
    calls = []

    def work(rows):
        calls.append(sorted(r["record"] for r in rows.collect()))
        return rows.withColumn("n", F.lit(len(calls)))

    def stops(rows):
        found = work(rows)
        return found.withColumn("n", F.when(F.col("record") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("n")))

    put("1.json", [1, 2, 2])
    keys = ["record", "method"]
    resumable.extract(stream(), out, at, keys, work).awaitTermination()
    put("2.json", [2, 3, 4])
    with pytest.raises(Exception, match="stop"):
        resumable.extract(stream(), out, at, keys, stops).awaitTermination()
    assert sorted(r["record"] for r in resumable.results(spark, out).collect()) == [1, 2]
    put("3.json", [4, 5])
    resumable.extract(stream(), out, at, keys, work).awaitTermination()
    assert sorted(r["record"] for r in resumable.results(spark, out).collect()) == [1, 2, 3, 4, 5]
    assert calls == [[1, 2], [3, 4], [3, 4], [5]]
    resumable.extract(stream(), out, at, keys, work).awaitTermination()
    assert resumable.results(spark, out).count() == 5
    last = resumable.latest(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 0, "c")], "k int, at int, v string"), ["k"], "at")
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [(1, "b"), (2, "c")]


def test_frozen_splits_drawn_down(spark, tmp_path):
    demo, judged = tmp_path / "demo.csv", tmp_path / "eval.csv"
    demo.write_text("id,inst\n1,A\n2,B\n")
    judged.write_text("id,inst\n" + "".join(f"{i},{'K' if i % 4 else 'L'}\n" for i in range(10, 50)))
    paths = {"demo": str(demo), "eval": str(judged)}
    rows, summary = S.frozen(spark, paths, "id", "inst", {"eval": 8}, 42)
    assert {(r["split"], r["stratum"]): r["n"] for r in summary.collect()} == {("demo", "A"): 1, ("demo", "B"): 1, ("eval", "K"): 6, ("eval", "L"): 2}
    again, _ = S.frozen(spark, paths, "id", "inst", {"eval": 8}, 42)
    assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in again.collect())


def test_stages_written_as_csv_are_found(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = K.stages({"eval": rows}, str(tmp_path))["eval"]
    got = S.stage_or(spark, path, lambda: rows.limit(0))
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("1", "a"), ("2", "")]
