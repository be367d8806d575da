"""Sound by the second, table functions, chained script conversion, and repeats within a text, against plain loops."""

from __future__ import annotations

import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.functions import scripts, tables
from linewright.functions.unescape import without_inner_repeats
from linewright.operators import reading_plans
from linewright.sources import audio


def wave(samples, bits=16, channels=1, rate=8, tag=1, extra=b"", cut=0, form=None):
    data = {8: lambda: (samples + 128).astype(np.uint8).tobytes(), 16: lambda: samples.astype("<i2").tobytes(), 32: lambda: samples.astype("<f4" if tag == 3 else "<i4").tobytes()}[bits]()
    form = form or struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = struct.pack("<4sI", b"fmt ", len(form)) + form + extra + struct.pack("<4sI", b"data", len(data)) + data
    return (struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body)[: -cut or None]


def test_sound(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = rng.integers(-20_000, 20_000, 8 * 100 + 3)
    (tmp_path / "long.wav").write_bytes(wave(long))
    (tmp_path / "two.wav").write_bytes(wave(rng.integers(-100, 100, 32), channels=2))
    (tmp_path / "odd.wav").write_bytes(wave(np.array([1, -2, 3]), bits=8, extra=struct.pack("<4sI", b"LIST", 5) + b"12345\0"))
    (tmp_path / "cut.wav").write_bytes(wave(np.full(20, 300), cut=5))
    (tmp_path / "none.wav").write_bytes(b"RIFF")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "nodata.wav").write_bytes(wave(np.array([], int))[:-8])
    (tmp_path / "blank.wav").write_bytes(wave(np.array([], int)))
    (tmp_path / "law.wav").write_bytes(wave(np.array([1]), bits=8, tag=6))
    every = None
    for size in (50, 400, 1 << 20):
        rows = audio.read_waves(spark, str(tmp_path), partitionBytes=str(size)).collect()
        found = {(r.file, r.second): r for r in rows}
        assert len(found) == len(rows)
        for k in range(101):
            own = long[8 * k : 8 * k + 8].astype(float)
            r = found["long.wav", k]
            assert (r.n_samples, r.whole, r.peak) == (len(own), len(own) == 8, abs(own).max()) and abs(r.rms - np.sqrt((own**2).mean())) < 1e-9
        assert [found["two.wav", k].n_samples for k in (0, 1)] == [16, 16] and ("two.wav", 2) not in found
        assert found["odd.wav", 0].peak == 3 * 256 and not found["odd.wav", 0].whole
        assert found["cut.wav", None].error == "truncated" and found["cut.wav", 1].n_samples == 8 and found["cut.wav", 2].n_samples == 1
        assert {r.file: r.error for r in rows if r.error and r.file != "cut.wav"} == {"none.wav": "not RIFF/WAVE", "empty.wav": "not RIFF/WAVE", "nodata.wav": "no samples", "law.wav": "encoding 6 of 8 bits"}
        assert every is None or set(every) == set(found)
        every = found
    quiet = audio.silence(audio.read_waves(spark, str(tmp_path)), ["file"], 500.0)
    shares = {r.file: (r.n_seconds, r.silent, r.threshold) for r in quiet.collect()}
    assert shares["two.wav"] == (2, 1.0, 2.0) and shares["long.wav"][1:] == (0.0, 1.0)


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "0\nMark a\n1\nMark b"), (2, None), (3, ""), (4, "Mark")], "k int, text string").createOrReplaceTempView("texts_of_test")
    found = spark.sql("SELECT k, s.* FROM texts_of_test, LATERAL text_sections(text, '^Mark') s").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 0, None, 1, "0"), (1, 1, "Mark a", 2, "Mark a\n1"), (1, 2, "Mark b", 1, "Mark b"), (3, 0, None, 1, ""), (4, 1, "Mark", 1, "Mark")], key=str)
    assert spark.sql("SELECT * FROM subtitle_cues(NULL, 'captions')").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT * FROM subtitle_cues('1\n00:01,000 --> 00:02,000\n&lt;a\n\nx', 'captions')").collect()] == [(1, 1, 1000, 2000, "<a")]
    assert spark.sql("SELECT unescape_html('&eacute;') AS x").first().x == "é"
    sizes = spark.createDataFrame([(e, n) for e in (0, 399, 400, 799, 1500, 9000) for n in (0, 10, 537, 5000, 36001)], "entries int, n_lines int")
    for preset in reading_plans.PRESETS:
        plain = reading_plans.sampling_plan(sizes, preset).select("entries", "n_lines", "part", "offset", "length", "label").collect()
        assert sorted(map(tuple, plain)) == sorted((r.entries, r.n_lines, i, *p) for r in sizes.collect() for i, p in enumerate(reading_plans.plan_of(r.entries, r.n_lines, preset)))


def longest_first(text, table):
    most, out, i = max(map(len, table)), [], 0
    while i < len(text):
        size = next((k for k in range(min(most, len(text) - i), 0, -1) if text[i : i + k] in table), 0)
        out.append(table[text[i : i + size]] if size else text[i])
        i += size or 1
    return "".join(out)


def test_chained_conversion(spark):
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choices("abcdef简繁體", k=rng.randrange(a, b)))
    steps = [dict((word(1, 5), word(0, 4)) for _ in range(60)) for _ in range(3)]
    rows = [("x", i, 1, s, t) for i, table in enumerate(steps) for s, t in table.items()]
    rows += [("x", 0, 2, s, "overridden") for s in steps[0]] + [("y", 0, 0, "a", "b"), ("x", 0, 0, "", "z"), ("x", 0, 0, "q", None)]
    table = spark.createDataFrame(rows, "config string, step int, rank int, source string, target string")
    texts = [word(0, 80) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, text, changed in scripts.convert_script(df, table, "x").collect():
        wanted = texts[i]
        if wanted is not None:
            for own in steps:
                wanted = longest_first(wanted, own)
        assert text == wanted
        assert changed == (None if wanted is None else sum(a != b for a, b in zip(texts[i], wanted)))
    with pytest.raises(ValueError, match="no entries"):
        scripts.convert_script(df, table, "z")
    with pytest.raises(ValueError, match="more than 5"):
        scripts.convert_script(df, table, "x", most_entries=5)


def test_large_tables(spark):
    table = spark.range(50_000).select(F.lit("x").alias("config"), F.lit(0).alias("step"), F.lit(0).alias("rank"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("source"), F.col("id").cast("string").alias("target"))
    df = spark.range(100).select(F.concat(F.lit("-k"), F.lpad((F.col("id") * 499).cast("string"), 6, "0"), F.lit("k1-")).alias("text"))
    assert {r.text for r in scripts.convert_script(df, table, "x").collect()} == {f"-{i * 499}k1-" for i in range(100)}


def slowly(text):
    words = text.split()
    if len(words) < 6:
        return text
    kept, at = [], 0
    while at < len(words):
        size = next((k for k in range(min(len(kept), len(words) - at), 2, -1) if kept[-k:] == words[at : at + k]), 0)
        at += size or 1
        if not size:
            kept.append(words[at - 1])
    return " ".join(kept)


def test_inner_repeats():
    rng = random.Random(1)
    for _ in range(3000):
        text = " ".join(rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(60)))
        assert without_inner_repeats(text) == slowly(text)
    for _ in range(20):
        text = " ".join(w for _ in range(100) for w in ("x", "x", "x", f"y{rng.randrange(4)}"))
        assert without_inner_repeats(text) == slowly(text)


def test_inner_repeats_of_whole_documents(spark):
    from linewright.plans import catalogue

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {r.doc_id: r.text for r in catalogue.queries()["inner_repeats_whole"](spark, data).collect()}
    assert found.keys() == texts.keys()
    assert all(found[i] == slowly(t) for i, t in texts.items() if len(t) < 20_000)


@pytest.mark.parametrize("kind", ["one word", "two words", "many starts", "nested"])
def test_inner_repeats_in_long_texts(kind):
    words = {"one word": ["a"] * 40_000, "two words": random.Random(3).choices("ab", k=40_000), "many starts": [w for i in range(10_000) for w in ("x", "z", "x", f"y{i}")], "nested": ("a b c " * 20 + "d e f " * 20).split() * 300}[kind]
    began = time.process_time()
    without_inner_repeats(" ".join(words))
    assert time.process_time() - began < 12


def test_lists_that_are_errors(spark):
    from linewright.sources import sinks, specs

    of = lambda *rows: spark.createDataFrame([(r,) for r in rows], "spec string")
    assert specs.checked_pairs(of("", " \n", None, "a=b")).collect()[0].wrong == "a"
    for bad, separators in (("nothing here", r"[,|;\n]"), ("=x;y=", r"[,|;\n]"), ("a=" + "b;c=d" * 8, ",")):
        with pytest.raises(Exception, match="no pair in|holds separators"):
            specs.checked_pairs(of("a=b", bad), separators=separators).collect()
    assert specs.checked_pairs(of("a=b;c"), separators=",").first().correct == "b;c"
    with pytest.raises(Exception, match="malformed pair"):
        specs.parse_pairs(of("a=b\nc="), separators=r"\n", strict=True).collect()
    notes = spark.createDataFrame([(1, 1, "x", "a-01-x"), (1, 2, "y", "b-02-y")], "book int, number int, title string, file string")
    with pytest.raises(Exception, match="several prefixes"):
        sinks.index_table(notes, ["book"]).collect()


def test_presets_and_halves(spark):
    from linewright.sources import books

    lines = ["CHAPTER 3", "Chapter 3", "第12章", "第12章節", "CH2-1", "CH2-10", "1   P R O L O G U E", "1  Prologue"]
    found = {p: [i for i, x in enumerate(lines) if spark.sql("select rlike(:a, :b) x", {"a": x, "b": m}).first().x] for p, m in books.MARKERS.items()}
    assert found == {"english": [0], "chinese-numbered": [2], "chinese-section": [4], "incerto": [6]}
    # half to even, as plans round
    assert reading_plans.plan_of(500, 5, "podcast")[1][0] == 2 and spark.range(1).select(F.bround(F.lit(5) * 0.30)).first()[0] == 2


def test_overlaps():
    from linewright.functions.unescape import without_overlap

    rng = random.Random(6)
    for _ in range(4000):
        before, words = (rng.choices("ab"[: rng.randrange(1, 3)], k=rng.randrange(9)) for _ in range(2))
        size = next((k for k in range(min(len(before), len(words)), 0, -1) if before[-k:] == words[:k]), 0)
        assert without_overlap(before, words) == words[size:]
    began = time.process_time()
    assert without_overlap(["a"] * 200_000, ["a"] * 199_999 + ["b"]) == ["b"]
    assert time.process_time() - began < 3


def test_dominant_characters_of_long_lines(spark):
    from linewright.functions import text as T

    rng = random.Random(7)
    line = "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(100_000)) + "  \x85" * 9 + "中" * 20_000
    most = max(line.count(c) for c in set(line) if not c.isspace())
    rows = spark.createDataFrame([(line,), ("a b\x1cb",), (" 　",), (None,)], "line string").repartition(1)
    began = time.time()
    found = {r.line: r.share for r in rows.select("line", T.dominant_share(F.col("line")).alias("share")).collect()}
    assert time.time() - began < 8
    assert found == {line: most / 120_000, "a b\x1cb": 0.5, " 　": 0.0, None: 0.0}


def test_inner_repeats_by_either_way(monkeypatch):
    from linewright.functions import unescape

    rng = random.Random(8)
    for few, vain in ((64, 8), (0, 8), (2, 0)):
        monkeypatch.setattr(unescape, "_FEW", few)
        monkeypatch.setattr(unescape, "_VAIN", vain)
        for _ in range(1500):
            text = " ".join(rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(80)))
            assert without_inner_repeats(text) == slowly(text)
    monkeypatch.undo()
    text = " ".join(f"w{rng.randrange(3000)}" for _ in range(200_000))
    began = time.process_time()
    without_inner_repeats(text)
    assert time.process_time() - began < 1.5
