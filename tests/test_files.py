"""Sources and sinks of files: subtitle files, named files, numbered lines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linewright.sources import logs, named_files, subtitle_files, subtitles


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    for k in range(3):
        blocks = ["WEBVTT"]
        for i in range(40):
            stamp = f"00:{i:02d}:{rng.randrange(60):02d}{rng.choice(',.')}{rng.randrange(1000):03d}"
            lines = [str(i)] * rng.randrange(2) + [f"{stamp} --> {stamp}"] + rng.choices(["<i>größer</i> &amp;lt;", ">> hi > there", "42", "Kind: x", "", "  "], k=rng.randrange(4))
            blocks.append("\n".join(x for x in lines if x.strip()) if rng.random() < 0.9 else "no stamps here")
        text = "".join(b + rng.choice(["\n\n", "\n \t\n\n", "\n\n\n"]) for b in blocks)
        (tmp_path / f"t{k}.vtt").write_bytes((text.replace("\n", "\r\n") if k == 1 else text).encode())
    return tmp_path


@pytest.mark.parametrize("dialect", sorted(subtitles.DIALECTS))
def test_every_cut_of_a_file(spark, folder, dialect):
    wanted = sorted((r["file"], *r[1:]) for r in subtitles.read_tracks(spark, str(folder), dialect).select(F.substring_index("track_id", "/", -1).alias("file"), "pos", "idx", "start_ms", "end_ms", "text", "lines").collect())
    for size in (70, 333, 1 << 20):
        found = subtitle_files.read_subtitles(spark, str(folder), dialect, partitionBytes=str(size))
        assert sorted(tuple(r)[:-1] for r in found.where("error is null").collect()) == wanted


def test_blocks_at_every_place(tmp_path):
    data = b"\xef\xbb\xbfa\nb\n\n \t\n\nc\n\nlong line of words\n\n\n\nd"
    (tmp_path / "x.srt").write_bytes(data)
    system, place = subtitle_files.file_system(str(tmp_path / "x.srt"))
    whole = list(subtitle_files.blocks_of(system.open_input_file(place), 0, len(data), True))
    assert [x for _, x in whole] == [b"\xef\xbb\xbfa\nb", b"c", b"long line of words", b"d"]
    for cut in range(len(data) + 1):
        parts = [list(subtitle_files.blocks_of(system.open_input_file(place), a, b, True)) for a, b in ((0, cut), (cut, len(data))) if b > a]
        assert sum(parts, []) == whole, cut


def test_malformed_files(spark, tmp_path):
    (tmp_path / "good.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    (tmp_path / "none.srt").write_text("nothing here")
    (tmp_path / "empty.srt").write_text("")
    (tmp_path / "bytes.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\n\xff\n\n2\n00:00:03,000 --> 00:00:04,000\ny\n")
    found = subtitle_files.read_subtitles(spark, str(tmp_path))
    assert sorted((r["file"], r["pos"] or 0, r["text"] or "", r["error"] or "") for r in found.collect()) == [
        ("bytes.srt", 0, "", "not UTF-8 at byte 32"), ("bytes.srt", 1, "y", ""), ("empty.srt", 0, "", "no cues"), ("good.srt", 1, "x", ""), ("none.srt", 0, "", "no cues")]
    assert subtitle_files.read_subtitles(spark, str(tmp_path), mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="no cues|not UTF-8"):
        subtitle_files.read_subtitles(spark, str(tmp_path), mode="FAILFAST").collect()
    assert subtitle_files.read_subtitles(spark, str(tmp_path), joiner="|", keep_empty="true", suffixes="good.srt").count() == 1


def test_pruned_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(subtitle_files.SubtitleFiles)
        every = spark.read.format("subtitles").option("pushdown", "true").load(str(folder))
        assert {r["file"] for r in every.where("file in ('t1.vtt', 'x') and start_ms >= 0").collect()} == {"t1.vtt"}
        assert {r["file"] for r in every.where("file = 't2.vtt'").select("file").distinct().collect()} == {"t2.vtt"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file()}


def test_named_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", "é\n"), ("b/c.txt", None), ("b/d.txt", "x")], "name string, text string").repartition(3)
    for _ in range(2):  # a second run replaces the first
        named_files.write_named(rows, str(out), F.col("name"))
        assert files(out) == {"a.txt": "é\n".encode(), "b/c.txt": b"", "b/d.txt": b"x"}
    with pytest.raises(Exception, match="a.txt"):
        named_files.write_named(rows.where("name = 'a.txt'"), str(out), F.col("name"), mode="append")
    named_files.write_named(rows.where("name = 'a.txt'").withColumn("name", F.lit("e.bin")).withColumn("content", F.unhex(F.lit("00ff"))), str(out), F.col("name"), "content", mode="append")
    assert files(out)["e.bin"] == b"\0\xff" and len(files(out)) == 4


def test_failed_jobs_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    fails = spark.range(0, 100, 1, 4).select(F.format_string("n%d", "id").alias("name"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="lost"):
        named_files.write_named(fails, str(out), F.col("name"))
    # a task that outlives the abort may still write below the staging folder, which readers skip
    seen = lambda: [p for p in out.rglob("*") if p.is_file() and "_staging" not in p.parts]
    assert not seen()
    twice = spark.createDataFrame([("a", "x"), ("./a", "y")], "name string, text string")
    with pytest.raises(Exception, match="two rows have one name"):
        named_files.write_named(twice, str(out), F.col("name"))
    for name in ("", "/etc/x", "../x", "b/../../x", "_staging/x"):
        with pytest.raises(Exception, match="not a name"):
            named_files.write_named(spark.createDataFrame([(name, "x")], "name string, text string"), str(out), F.col("name"))
    assert not seen()


@pytest.mark.parametrize("size", ["7", "64", "1000", "10000000"])
def test_numbered_lines(spark, tmp_path, size):
    rng = random.Random(3)
    wanted = set()
    for k in range(3):
        lines = ["x" * rng.randrange(0, 30) + str(i) for i in range(200)]
        (tmp_path / f"l{k}.txt").write_text("\n".join(lines))
        wanted |= {(f"l{k}.txt", i, x) for i, x in enumerate(lines, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = [tuple(r) for r in logs.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == len(wanted) and set(rows) == wanted
