"""Dyadic bins, prefix scans and folds in pieces, against windows and whole-track loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linewright.operators import align, captions, folds, scans
from linewright.operators import sequences as S


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_dyadic_cover(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 100, 5000])) for a in (rng.randrange(-300, 5000) for _ in range(300))] + [(5, 3), (-7, 10**13)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("bins", align.dyadic_cover(F.col("a"), F.col("b"), 10)).collect()
    for a, b, bins in rows:
        if b <= a:
            assert bins is None
            continue
        first, last = a // 10, (b - 1) // 10 + 1
        assert len(bins) <= 2 * (last - first).bit_length()
        assert sum(1 << x.level for x in bins) == last - first
        if last - first < 10_000:
            units = [u for x in bins for u in range(x.node << x.level, (x.node + 1) << x.level)]
            assert sorted(units) == list(range(first, last))


def cues(rng, n, longest=400):
    out = []
    for i in range(n):
        start = rng.randrange(2000)
        out.append((i % 3, i, start, start + rng.choice([-5, 0, 1, rng.randrange(60), rng.randrange(longest)]), f"t{i}"))
    return [*out, (0, n, -50, 10**9, "whole"), (3, n + 1, 0, 5, "alone")]


def test_eligible_partners(spark):
    rng = random.Random(3)
    rows = [(i % 2, i, s, s + rng.randrange(1, 60), f"t{i}") for i, s in enumerate(sorted(rng.randrange(2000) for _ in range(3000)))]
    rows += [(k, i + 3000, s, e, f"u{i}") for k, i, s, e, _ in rows]
    other = spark.createDataFrame(rows, "k long, _opos long, _os long, _oe long, _text string")
    kept = align._eligible(other, ["k"], 16).collect()
    # neither copies nor dense records grow what is left: some records for each stretch
    assert len(kept) < 1000 and all(r._text[0] == "t" for r in kept)
    for k, pos, s, e, _ in rng.sample(rows, 200):
        best = lambda some: max((min(e, r[3]) - max(s, r[2]), -r[1], r[4]) for r in some if r[0] == k)  # noqa: B023, E731
        assert best(rows) == best([(r.k, r._opos, r._os, r._oe, r._text) for r in kept])


def test_empty_intervals(spark):
    rng = random.Random(4)
    ours, theirs = cues(rng, 150), cues(rng, 150)
    make = lambda rows: spark.createDataFrame(rows, "k long, pos long, start_ms long, end_ms long, text string")
    found = {(r.k, r.pos): r.other_text for r in align.overlap_join(make(ours), make(theirs[:-2]), ["k"], width_ms=16, placeholder="-", empty=True).collect()}
    for k, pos, s, e, _ in ours:
        met = [(min(e, oe) - max(s, os), -op, t) for ok, op, os, oe, t in theirs[:-2] if ok == k and os < e and s < oe]
        assert found[k, pos] == (max(met)[2] if met else "-")


def test_interval_joins(spark):
    rng = random.Random(2)
    ours, theirs = cues(rng, 150), cues(rng, 150)
    make = lambda rows: spark.createDataFrame(rows, "k long, pos long, start_ms long, end_ms long, text string")
    found = {(r.k, r.pos): r.other_text for r in align.overlap_join(make(ours), make(theirs), ["k"], width_ms=16, placeholder="-").collect()}
    for k, pos, s, e, _ in ours:
        met = [(min(e, oe) - max(s, os), -op, t) for ok, op, os, oe, t in theirs if ok == k and os < e and s < oe and s < e and os < oe]
        assert found[k, pos] == (max(met)[2] if met else "-")
    windows = spark.createDataFrame([(k, s, e) for k, _, s, e, _ in ours], "k long, win_start long, win_end long").distinct()
    for k, s, e, n in align.window_counts(windows, make(theirs), ["k"], 16).collect():
        assert n == sum(ok == k and s <= os < e for ok, _, os, _, _ in theirs)
    patch = [(k, p, s, e, t, p % 5) for k, p, s, e, t in theirs if p % 10 == 0]
    kept = align.patch_ranges(make(ours), spark.createDataFrame(patch, "k long, pos long, start_ms long, end_ms long, text string, patch_id long"), ["k"], width_ms=16)
    ranges = {}
    for k, _, s, e, _, i in patch:
        lo, hi = ranges.get((k, i), (s, e))
        ranges[k, i] = min(lo, s), max(hi, e)
    wanted = [r for r in ours if not any(k == r[0] and lo <= r[2] < hi for (k, _), (lo, hi) in ranges.items())] + [r[:5] for r in patch]
    assert rows_of(kept) == sorted(wanted, key=str)


def test_whole_track_interval_costs_little(spark):
    one = spark.createDataFrame([(1, 0, 10**12)], "k long, start_ms long, end_ms long")
    assert align._spread(one, "start_ms", "end_ms", 1000).count() <= 60


@pytest.fixture(scope="module")
def track(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, *range(-3, 9)]), rng.choice("aab"), (i // 10) * 7 + rng.randrange(7)) for k in (None, 1, 2) for i in range(300)]
    return spark.createDataFrame(rows, "k long, i long, x long, v string, t long").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_scans_equal_windows(track, size):
    chunk = F.floor(F.col("i") / size)
    w = Window.partitionBy("k").orderBy("i")
    found = scans.scanned(track, ["k"], ["i"], chunk, {"s": F.col("x")}, {"m": F.col("x")}, {"p": F.col("x"), "q": F.col("v")}, "n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wanted = track.select("*", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), F.row_number().over(w), F.max("x").over(before), F.lag("x").over(w), F.lag("v").over(w))
    assert rows_of(found.select("k", "i", "x", "v", "t", "s", "n", "m", "p", "q")) == rows_of(wanted)
    for plain, scan in (
        (S.collapse_runs(track, ["k"], ["i"], "v"), S.collapse_runs(track, ["k"], ["i"], "v", chunk=chunk)),
        (S.drop_adjacent_repeats(track, ["k"], ["i"], "x"), S.drop_adjacent_repeats(track, ["k"], ["i"], "x", chunk)),
        (S.segment_offsets(track, ["k"], ["i"], "x"), S.segment_offsets(track, ["k"], ["i"], "x", chunk)),
        (S.concat_batches(track, ["k"], "i", ["t"]), S.concat_batches(track, ["k"], "i", ["t"], chunk)),
        (S.sections(track, ["k"], ["i"], F.col("v") == "b"), S.sections(track, ["k"], ["i"], F.col("v") == "b", chunk)),
    ):
        assert rows_of(plain.select(*sorted(plain.columns))) == rows_of(scan.select(*sorted(plain.columns)))
    spans = track.where("k is not null").select("k", F.col("t").alias("gap_start"), (F.col("t") + F.coalesce("x", F.lit(0))).alias("gap_end"), "v")
    merged = [S.merge_intervals(spans, ["k"], pad_ms=1, label="v", chunk=c) for c in (None, F.floor(F.col("gap_start") / size))]
    assert rows_of(merged[0]) == rows_of(merged[1])


def collapsed(texts, look_ahead=3):
    out, i = [], 0
    while i < len(texts):
        current, j = texts[i], i + 1
        while j < len(texts) and j < i + look_ahead + 1:
            if current in texts[j]:
                current = texts[j]
            elif texts[j] not in current:
                break
            j += 1
        out.append(current)
        i = j
    return out


def segments(rows):
    out, start, text = [], None, ""
    for s, e, t in rows:
        text = t if text == "" else f"{text} {t}"
        start = s if start is None else start
        length, n = e - start, len(text.split())
        if length >= 6000 or length >= 2000 and text.rstrip('"').endswith((".", "!")) or length >= 3500 and text.endswith(",") or length >= 4000 and n >= 12 or n >= 25:
            out.append((start, e, text))
            start, text = e, ""
    return [*out, (start, rows[-1][1], text)] if text else out


def captions_of(spark, seed, n=400):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        words = rng.choices(["a", "ab", "abc", "b", "x y", "end.", "so,", 'stop!"'], k=rng.choice([1, 1, 2, 5, 30 if seed % 2 else 3]))
        length = rng.choice([300, 1500, 2500, 7000])
        start = max(0, at + rng.choice([0, 0, -2000 if seed % 3 else 0, 500]))
        rows.append((i % 2, i, start, start + length, " ".join(words)))
        at = start + length
    return rows, spark.createDataFrame(rows, "k long, i long, start_ms long, end_ms long, text string")


@pytest.mark.parametrize("seed", [1, 2, 3, 6])
def test_folds_in_pieces(spark, seed):
    rows, df = captions_of(spark, seed)
    for chunk in (None, F.floor(F.col("i") / 23)):
        found = captions.collapse_progressive(df, ["k"], ["i"], chunk=chunk).orderBy("k", "pos").collect()
        for k in (0, 1):
            own = [r for r in found if r.k == k]
            assert [r.pos for r in own] == list(range(1, len(own) + 1))
            assert [r.text for r in own] == collapsed([r[4] for r in rows if r[0] == k])
        found = captions.sentence_segments(df, ["k"], ["i"], chunk=chunk).orderBy("k", "pos").collect()
        for k in (0, 1):
            assert [(r.start_ms, r.end_ms, r.text) for r in found if r.k == k] == segments([r[2:] for r in rows if r[0] == k])


def test_a_long_track_is_cut(spark):
    """A million records of one track: many pieces, none large."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), F.concat(F.lit("w"), (F.col("id") % 1009).cast("string"), F.when(F.col("id") % 9 == 0, " a word.").otherwise("!")).alias("text"))
    chunk = F.floor(F.col("i") / 50_000)
    rows, names = captions._lags(df, ["k"], ["i"], 4, None)
    free = ~F.coalesce(F.contains("text", names[0]), F.lit(False))
    assert folds.pieces(rows.withColumn("f", free), ["k"], ["i"], F.col("f")).groupBy("_piece").count().agg(F.max("count")).first()[0] < 50
    assert captions.collapse_progressive(df, ["k"], ["i"], chunk=chunk).agg(F.max("pos"), F.count("*"), F.sum("end_ms")).first() is not None


def test_nulls_and_no_safe_break(spark):
    df = spark.createDataFrame([(1, i, i * 100, i * 100 + 50, None if i % 7 == 3 else "a" * (i % 3 + 1)) for i in range(200)], "k int, i int, start_ms long, end_ms long, text string")
    for fold in (captions.collapse_progressive, captions.sentence_segments):
        assert rows_of(fold(df, ["k"], ["i"])) == rows_of(fold(df, ["k"], ["i"], chunk=F.floor(F.col("i") / 11)))
        assert fold(df.limit(0), ["k"], ["i"]).count() == 0


def replaced(texts, pairs):
    import re

    for wrong, correct in pairs:
        texts = [t.replace(wrong, correct) for t in texts]
        old, new = wrong.split(), correct.split()
        if len(old) > 1 and len(old) == len(new):
            pattern = re.compile("([ \t\n\r\x0b\x0c\ue000]+)".join(map(re.escape, old)))
            texts = pattern.sub(lambda m, new=new: new[0] + "".join(m[i] + new[i] for i in range(1, len(new))), "\ue000".join(texts)).split("\ue000")
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_replacement_over_ends(spark, seed):
    """Against the whole track at once, with control characters in texts and pairs that feed each other."""
    rng = random.Random(seed)
    words = ["of", "the", "in", "x", "of the", "big", "cat", "", " ", "\0", "\x01\x02", "\x01", "a\0b", "the\n", "\tof"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(4))) for _ in range(300)]
    pairs = [("x", "of"), ("of the", "OF THE"), ("in the big", "IN A HUGE"), ("cat", "in"), ("big", "in the"), ("a", "$1\\")]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, text string")
    for chunk in (None, F.floor(F.col("i") / 17)):
        found = captions.replace_over_ends(df, ["k"], ["i"], pairs, chunk=chunk).orderBy("i").collect()
        assert [r.text for r in found] == replaced(texts, pairs)
    with pytest.raises(ValueError, match="characters"):
        captions.replace_over_ends(df, ["k"], ["i"], [("\0", "x")])


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_lags_and_run_edges_equal_windows(track, size):
    chunk = F.floor(F.col("i") / size)
    w = Window.partitionBy("k").orderBy("i")
    names = ["a", "b", "c"]
    found = scans.lagged(track, ["k"], ["i"], chunk, F.col("v"), names)
    assert rows_of(found) == rows_of(track.withColumns({c: F.lag("v", j).over(w) for j, c in enumerate(names, 1)}))
    few = track.withColumn("x", F.when(F.col("i") % 60 < 40, F.lit(1)).otherwise(F.col("x")))
    for rows in (track, few):
        runs = S.islands(rows, ["k"], ["i"], ~F.col("x").eqNullSafe(F.lag("x").over(w)), "r")
        wanted = runs.withColumns({"_begins": F.row_number().over(Window.partitionBy("k", "r").orderBy("i")) == 1, "_size": F.count("*").over(Window.partitionBy("k", "r"))}).drop("r")
        assert rows_of(scans.run_edges(rows, ["k"], ["i"], chunk, F.col("x"))) == rows_of(wanted)


@pytest.mark.parametrize(("name", "most"), [("one_track_runs", 8), ("one_track_collapse", 16)])
def test_one_track_is_shuffled_few_times(spark, name, most):
    from linewright.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most
