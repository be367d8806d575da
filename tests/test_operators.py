"""Boundary cases of the operators, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linewright.functions import text as T
from linewright.functions.unescape import converter, replace_across, unescape_html, without_inner_repeats
from linewright.operators import align, captions, checks, replies
from linewright.operators import sequences as S


def texts(spark, values):
    return spark.createDataFrame([("t", i, i * 1000, i * 1000 + 900, v) for i, v in enumerate(values)], "track string, pos int, start_ms long, end_ms long, text string")


def listed(df, column="text", order="pos"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_runs(spark):
    assert listed(S.collapse_runs(texts(spark, list("aabbbc")), ["track"], ["pos"], "text")) == ["a", "a", "b", "c"]
    assert listed(S.drop_adjacent_repeats(texts(spark, ["x", "x", "y", "x", None, None]), ["track"], ["pos"], "text")) == ["x", "y", "x", None]
    assert listed(S.drop_adjacent_repeats(texts(spark, [None, "x"]), ["track"], ["pos"], "text")) == [None, "x"]
    for n, left in ((20, 1), (19, 19)):
        assert S.collapse_short_streaks(texts(spark, ["ok"] * n), ["track"], ["pos"], "text").count() == left


def test_collapse_is_idempotent(spark):
    once = S.collapse_runs(texts(spark, list("aaabbbbccaaad")), ["track"], ["pos"], "text")
    assert listed(S.collapse_runs(once, ["track"], ["pos"], "text")) == listed(once)


def test_gaps(spark):
    cue = lambda rows: spark.createDataFrame([("t", *r) for r in rows], "track string, pos int, start_ms long, end_ms long, text string")
    assert S.time_jumps(cue([(0, 0, 1000, "a"), (1, 31000, 32000, "b")]), ["track"], ["pos"]).count() == 0
    assert S.time_jumps(cue([(0, 0, 1000, "a"), (1, 31001, 32000, "b")]), ["track"], ["pos"]).count() == 1
    assert S.repeated_characters(texts(spark, ["aaaa", "aaaaa"]), ["track", "pos"], "text").count() == 1
    blank = S.blank_blocks(texts(spark, ["", "x", "", " ", "y"]), ["track"], ["pos"], "text").collect()
    assert [(b.gap_start, b.gap_end) for b in blank] == [(2000, 3900)]
    for second, regions in ((15_000, 1), (15_001, 2)):
        gaps = spark.createDataFrame([("t", 0, 10_000), ("t", second, 20_000)], "track string, gap_start long, gap_end long")
        assert S.merge_intervals(gaps, ["track"]).count() == regions


def test_stamps(spark):
    rows = spark.createDataFrame([("t", 0, 5, 3), ("t", 1, 9, 700_000), ("t", 2, 99_999, 99_999), ("t", 3, 100_000, 99_000)], "track string, pos int, start_ms long, end_ms long")
    assert listed(S.stamp_faults(rows, ["track"], ["pos"]), "fault") == ["bad_end", None, "backward", "bad_end"]
    assert listed(S.repair_ends(rows, ["track"], ["pos"]), "end_ms") == [9, 700_000, 99_999, 103_000]
    stamps = spark.createDataFrame([("01:02:03,004", 3_723_004), ("02:03.004", 123_004), ("x", None)], "s string, ms long").select(T.stamp_to_ms(F.col("s")).alias("a"), "ms", T.ms_to_stamp(F.col("ms")).alias("b")).collect()
    assert all(r.a == r.ms for r in stamps) and stamps[0].b == "01:02:03,004"
    assert [r[0] for r in spark.createDataFrame([(61_000,), (3_661_000,)], "x long").select(T.short_clock(F.col("x"))).collect()] == ["01:01", "01:01:01"]


def test_batches(spark):
    sizes = lambda n, k: [r["count"] for r in S.batch_by_entry(texts(spark, ["x"] * n), ["track"], ["pos"], k).groupBy("batch_num").count().orderBy("batch_num").collect()]
    assert sizes(10, 4) == [3, 3, 3, 1] and sizes(4, 3) == [2, 2]
    timed = spark.createDataFrame([("t", 0, 25_000, 30_000), ("t", 1, 100_000, 100_000)], "track string, pos int, start_ms long, end_ms long")
    assert listed(S.batch_by_time(timed, ["track"], ["pos"], 4), "batch_num") == [2, 4]
    counts = spark.createDataFrame([(0,), (450,), (451,), (1200,), (1201,)], "n int")
    assert [r[0] for r in counts.select(S.auto_batches(F.col("n"))).collect()] == [2, 3, 3, 6, 5]
    segments = spark.createDataFrame([("t", 1, 10_000), ("t", 2, 20_000), ("t", 3, 30_000)], "track string, seg_no int, duration_ms long")
    cues = spark.createDataFrame([("t", 1, 0, 5), ("t", 3, 0, 5)], "track string, seg_no int, start_ms long, end_ms long")
    assert listed(S.merge_segments(cues, segments, ["track"]), "start_ms", "seg_no") == [0, 30_000]


def test_captions(spark):
    grown = texts(spark, ["a", "a b", "a b c", "a b c d", "a b c d e"])
    assert [(r.text, r.start_ms) for r in captions.collapse_progressive(grown, ["track"], ["pos"]).orderBy("start_ms").collect()] == [("a b c d", 3000), ("a b c d e", 4000)]
    assert without_inner_repeats("a b c d a b c d") == "a b c d" and without_inner_repeats("a b c a b") == "a b c a b"
    assert listed(captions.trim_overlaps(texts(spark, ["one two three", "two three four"]), ["track"], ["pos"])) == ["one two three", "four"]
    cues = spark.createDataFrame([("t", 0, 0, 1000, "Hi there."), ("t", 1, 1500, 2500, "Done now."), ("t", 2, 4000, 4500, "Bye")], "track string, i int, start_ms long, end_ms long, text string")
    assert [(r.start_ms, r.end_ms, r.text) for r in captions.sentence_segments(cues, ["track"], ["i"]).orderBy("pos").collect()] == [(0, 2500, "Hi there. Done now."), (2500, 4500, "Bye")]
    assert captions.clean_captions(grown, ["track"], ["pos"]).count() == 1


def test_joins(spark):
    schema = "track string, pos int, start_ms long, end_ms long, text string"
    master = spark.createDataFrame([("t", 0, 0, 10, "m"), ("t", 1, 10, 10, "empty")], schema)
    other = spark.createDataFrame([("t", 0, 0, 5, "A"), ("t", 1, 5, 10, "B"), ("t", 2, 10, 12, "C")], schema)
    assert listed(align.overlap_join(master, other, ["track"], placeholder="-"), "other_text") == ["A", "-"]
    assert listed(align.align_tracks(master, other.limit(2), ["track"], ["pos"]), "other_text") == ["A", "B"]
    long = spark.createDataFrame([("t", 0, 0, 10_000_000, "m")], schema)
    assert listed(align.overlap_join(long, other, ["track"], width_ms=3), "other_text") == ["A"]
    patch = spark.createDataFrame([("t", 7, 10, 20, "p", 1)], schema + ", patch_id int")
    base = spark.createDataFrame([("t", 0, 9, 9, "a"), ("t", 1, 10, 11, "b"), ("t", 2, 20, 21, "c")], schema)
    assert sorted(listed(align.patch_ranges(base, patch, ["track"]))) == ["a", "c", "p"]
    windows = spark.createDataFrame([("t", 0, 60_000), ("t", 60_000, 120_000), ("u", 0, 60_000)], "track string, win_start long, win_end long")
    cues = spark.createDataFrame([("t", i, i * 1000, i * 1000, "x") for i in (0, 1, 2, 3, 59, 60, 61, 62, 63)], schema)
    assert {(r.track, r.gap_start) for r in align.density_gaps(windows, cues, ["track"]).collect()} == {("t", 60_000), ("u", 0)}
    assert [r[0] for r in S.shift_patch(spark.createDataFrame([(0, 17_000), (0, 17_001)], "start_ms long, end_ms long"), 5, 17_000).select("end_ms").collect()] == [17_006]


def test_text(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]
    assert one(T.decode_entities_once, "&amp;quot;") == "&quot;" and one(T.decode_entities_amp_early, "&amp;quot;") == '"'
    assert one(lambda c: T.replace_pairs(c, [("obus", "Opus")]), "robust") == "rOpust"
    pairs = F.array(F.struct(F.lit("obus").alias("wrong"), F.lit("Opus").alias("correct")))
    assert one(lambda c: T.replace_pairs_column(c, pairs, True), "robust obus") == "robust Opus"
    assert one(T.comparable, "a　b") == "a b"
    assert one(lambda c: T.count_literal(c, "aXa"), "aXaXa") == 1
    for value, stuck in (("a" * 16 + "bcde", True), ("a" * 15 + "bcdef", False), ("a" * 19, False)):
        assert one(T.is_stuck_line, value) is stuck
    assert one(T.without_fences, "```md\nx\n```") == "x\n"
    assert one(T.from_first_heading, "hello\n# A\nb") == "# A\nb"
    assert one(lambda c: T.until_last(c, "</details>"), "x</details>y</details>z") == "x</details>y</details>"
    assert one(lambda c: T.strip_prefaces(c, ["wait,? ", "sorry\\. "]), "Wait, sorry. yes") == "yes"
    key = one(T.heading_key, "# Ch3：Title")
    assert (key.kind, key.number, key.title) == ("Ch", 3, "Title")
    assert one(T.slug, "Hello, World!  ") == "hello-world"
    assert one(T.caption_text, "&gt;&gt; <i>Hi</i> &amp;  you") == "Hi & you"
    assert one(unescape_html, "&eacute;&#x41;") == "éA"
    assert one(converter({"ab": "1", "a": "2"}), "aba") == "12"
    assert replace_across(["see open", "ai now"], [("open ai", "Open AI")]) == ["see Open", "AI now"]
    assert one(lambda c: T.url_member(c, F.lit("OEBPS")), "a%20b.html#x") == "OEBPS/a b.html"
    assert one(lambda c: T.language_hint(F.lit(""), F.lit("de-AT"), c, {}), "x") == "de"


def test_checks(spark):
    terms = spark.createDataFrame([("A", 10, 3, None), ("B", 3, 0, None), ("C", 2, 0, None), ("Cats", 9, 0, 9)], "term string, n_source long, n_target long, n_singular long")
    assert [r.term for r in checks.lost_terms(terms).collect()] == ["B"]
    quotes = spark.createDataFrame([(1, "a  b"), (2, "x y"), (3, "a b")], "quote_id long, text string")
    found, lost = checks.verify_quotes(quotes, spark.createDataFrame([("zz a b zz",), (None,)], "text string"))
    assert {r[0] for r in found.collect()} == {1, 3} and {r[0] for r in lost.collect()} == {2}
    verdicts = spark.createDataFrame([(3, 3), (9, 4), (9, 3)], "a int, b int").select(checks.verdict(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in verdicts] == ["equal", "tolerable", "fail"]
    track = lambda targets: spark.createDataFrame([("t", i, "x" * 10, "y" * n) for i, n in enumerate(targets, 1)], "track string, pos int, source string, target string")
    calm = checks.tail_drift(track([12, 1, 10, 10, 10, 10, 10]), ["track"]).first()
    assert calm.drift_start is None and calm.drift_range == 0
    drift = checks.tail_drift(track([10] * 6 + [50] * 4), ["track"]).first()
    assert drift.drift_start == 2 and drift.drift_range == 9
    odd = checks.tail_drift(track([10, 50, 10, 10, 10, 10, 50]), ["track"]).first()
    assert odd.drift_start == 2
    short = checks.track_drift(track([1] * 3).withColumnRenamed("source", "text"), track([1] * 5).withColumnRenamed("source", "text"), ["track"]).first()
    assert short.drift_range == 2
    samples = spark.createDataFrame([("t", [0, 0]), ("t", [1000, 1000])], "track string, samples array<int>")
    assert checks.silent_share(samples, ["track"]).first()["threshold"] == 2.0
    config = spark.createDataFrame([(1, "a"), (1, None)], "num int, title string")
    assert {tuple(r.errors) for r in checks.config_errors(config, [], ["title"]).collect()} == {("duplicate number 1",), ("missing title", "duplicate number 1")}


def test_replies(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 2, "z")], "msg int, key int, text string")
    assert {tuple(r) for r in replies.last_wins(rows, ["key"], ["msg"], ["text"]).collect()} == {(1, "x"), (2, "z")}
    assert {tuple(r) for r in replies.fill_missing(rows, ["key"], ["msg"], ["text"]).collect()} == {(1, "x"), (2, "y")}
    ties = spark.createDataFrame([("k", 0, "aa"), ("k", 1, "bb")], "key string, ord int, text string")
    assert replies.longest_wins(ties, ["key"], "ord", "text", ["text"]).first().text == "aa"
    reply = spark.createDataFrame([("r", "intro\n# Ch2: A\nx\n# Seg1: B\ny")], "r string, text string")
    assert [r.number for r in replies.split_sections(reply, "text").orderBy("number").collect()] == [2, 10_001]
    caption = spark.createDataFrame([("r", "```srt\n1\n00:00:01,000 --> 00:00:02,000\nhello\nyou\n\n2\nno stamp\n```")], "r string, text string")
    assert [(r.number, r.caption) for r in replies.keyed_captions(caption, ["r"]).collect()] == [(1, "hello\nyou")]


def test_sections(spark):
    book = spark.createDataFrame([("b", i, x) for i, x in enumerate(["front", "Chapter 1", "a", "Chapter 2"])], "book string, pos int, line string")
    assert [(r.section, r.text) for r in S.section_texts(book, ["book"], ["pos"], "line", r"^Chapter \d").orderBy("section").collect()] == [(0, "front"), (1, "Chapter 1\na"), (2, "Chapter 2")]
    markers = spark.createDataFrame([("b", 1, "letter", "A"), ("b", 5, "letter", "B"), ("b", 9, "letter", "C"), ("b", 12, "number", "7")], "book string, pos int, kind string, label string")
    assert [(r.label, r.pos, r.end) for r in S.appendix_ends(markers, ["book"], ["A", "C"]).orderBy("pos").collect()] == [("A", 1, 9), ("C", 9, 12)]
    chapters = spark.createDataFrame([("b", 0, "One"), ("b", 1, "(untitled-1)"), ("b", 2, "Two"), ("b", 3, "(untitled-3)")], "book string, i int, title string")
    assert S.drop_trailing_untitled(chapters, ["book"], "i").count() == 3


def test_strict_pairs(spark):
    from linewright.sources import specs

    spec = spark.createDataFrame([("a=b; c:d ;e",)], "spec string")
    assert [(r.wrong, r.correct) for r in specs.parse_pairs(spec).collect()] == [("a", "b"), ("c", "d")]
    with pytest.raises(Exception, match="malformed pair"):
        specs.parse_pairs(spec, strict=True).collect()
    assert sorted(spark.range(1).select(specs.selected_numbers(F.lit("1, 3,7-9"))).first()[0]) == [1, 3, 7, 8, 9]
    patches = spark.createDataFrame([("a:b.srt:12.5:3",), ("c.srt:-2",), ("bad",)], "spec string")
    assert {tuple(r) for r in specs.parse_patches(patches).collect()} == {("a:b.srt", 12_500, 3000), ("c.srt", -2000, 0)}


def test_reading_plans(spark):
    from linewright.operators import reading_plans as P

    plan = lambda entries, lines, preset: [(r.offset, r.length) for r in P.sampling_plan(spark.createDataFrame([(entries, lines)], "entries int, n_lines int"), preset).orderBy("part").collect()]
    assert plan(399, 600, "podcast") == [(0, 500), (500, 200)]
    assert plan(400, 1605, "podcast") == [(0, 400), (482, 400), (963, 400), (1405, 200)]
    assert plan(800, 3200, "podcast") == [(0, 300), (640, 400), (1344, 400), (2080, 400), (2964, 236)]
    assert [x[0] for x in plan(1500, 6000, "podcast")] == [0, 900, 1740, 2580, 3420, 4260, 5764]
    assert plan(399, 450, "reading") == [(0, 450), (250, 200)]
    assert plan(400, 1603, "reading") == [(0, 400), (400, 400), (800, 400), (1403, 200)]
    assert plan(800, 3200, "reading") == [(0, 300), (966, 400), (1632, 400), (2298, 400), (2964, 236)]
    assert [x[0] for x in plan(1500, 6000, "reading")] == [0, 1210, 2120, 3030, 3940, 4850, 5764]
    assert plan(400, 1605, "translation") == [(0, 500), (1405, 200)]
    spec = spark.createDataFrame([("t", 1000, [100.0, 500.0], 1000.0)], "track string, n_lines int, points array<double>, total_sec double")
    found = P.timeline_reads(spec, 3).orderBy("part").collect()
    assert [(r.offset, r.length, r.label) for r in found] == [(0, 400, "0:00~6:40 (covers TL: 1:40)"), (300, 400, "5:00~11:40 (covers TL: 8:20)"), (600, 400, "10:00~16:40")]


def test_quotes_in_chunks(spark):
    """More quotes than one automaton takes; the texts of an id count a source once."""
    quotes = spark.range(25_000).selectExpr("id as quote_id", "concat('q', id, ' end') as text").unionByName(spark.createDataFrame([(7, "second  text"), (9, "")], "quote_id long, text string"))
    sources = spark.createDataFrame([("x q7 end second text",), ("q24999  end q7 end",), (None,)], "text string")
    for options in ({}, {"chunk_bytes": 50_000}):
        found = {r.quote_id: r.n_sources for r in checks.found_quotes(quotes, sources, **options).collect()}
        assert found == {7: 2, 24_999: 1}
    assert checks.found_quotes(quotes.limit(0), sources).count() == 0


def test_queries_over_all_rows(spark, tmp_path):
    """Accents, underscores and other languages against plain models."""
    import re
    from collections import Counter

    from linewright.plans import catalogue

    values = ["Villaé Villa\nHouse of the_the the", "Élan Berlin “the” the_x ethe", "Das Haus_Tier Tiere Häuser Berlin", "Москва Theatre Moscow the", None, "Berlin Berlin Paris9 Paris Lands", "Lands Lands", "Land of the é"]
    rows = [(i, t, ["en", "de", "ru"][i % 3]) for i, t in enumerate(values * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    term = re.compile(r"(?<!\w)[A-Z][a-zA-Z]{3,}(?!\w)")
    every = [(i, term.findall(t or "")) for i, t, _ in rows]
    source, target = (Counter(w for i, ws in every if i % 2 == k for w in ws) for k in (0, 1))
    counted = lambda w: target[w[:-1]] if w[-1] == "s" and not target[w] and target[w[:-1]] else target[w]
    assert {(r.term, r.n_source, r.n_target, r.n_counted) for r in run("lost_terms_all")} == {(w, n, target[w], counted(w)) for w, n in source.items() if n >= 3 and counted(w) < 0.3 * n}
    titles = {w for _, t, _ in rows for w in term.findall((t or "").split("\n")[0])}
    assert {r.term for r in run("term_candidates_all")} == titles | {w for w, n in (source + target).items() if n >= 2}
    bounded = {r.doc_id: r.bounded for r in run("careful_replace_all")}
    assert bounded == {i: t and re.sub(r"(?<![^\W_])the(?![^\W_])", "THE", t) for i, t, _ in rows}
    data = "/root/testdata/sf0.001"
    events = [r.asDict() for r in catalogue.cues(spark, data).collect()]
    day = lambda e: e["start_ms"] // 86_400_000
    clicks, reach = [e for e in events if e["event_type"] == "click"], {}
    for e in clicks:
        lo, hi = reach.get((day(e), e["user_id"]), (e["start_ms"], e["end_ms"]))
        reach[day(e), e["user_id"]] = min(lo, e["start_ms"]), max(hi, e["end_ms"])
    stay = [e for e in events if e["event_type"] == "view" and not any(d == day(e) and lo <= e["start_ms"] < hi for (d, _), (lo, hi) in reach.items())]
    assert sorted(r.pos for r in catalogue.queries()["range_patch_all"](spark, data).collect()) == sorted(e["event_id"] for e in clicks + stay)


def test_pattern_counts_by_chunks(spark):
    """Counts don't overlap, equal patterns count each, and chunks add up."""
    from linewright.operators import checks

    df = spark.createDataFrame([("aaaa ab",), (None,), ("",), ("éé aa",)], "text string")
    pairs = spark.createDataFrame([(0, "aa"), (1, "a"), (2, "aa"), (3, ""), (4, "é"), (5, "zz"), (6, "ab")], "ord int, wrong string")
    for size in (4 << 20, 2):
        found = {r.ord: r.n for r in checks.pattern_counts(df, pairs, chunk_bytes=size).collect()}
        assert found == {0: 3, 1: 7, 2: 3, 3: 0, 4: 2, 5: 0, 6: 1}


def test_replacement_over_ends(spark):
    from linewright.operators import captions

    rows = [("t", 1, "see open"), ("t", 2, "ai now $1"), ("t", 3, None), ("u", 1, "open\x00ai"), ("v", 1, "a.b"), ("v", 2, "c 1x")]
    df = spark.createDataFrame(rows, "track string, pos int, text string")
    pairs = [("open ai", "Open AI"), ("a.b c", "A 2")]
    found = {(r.track, r.pos): r.text for r in captions.replace_over_ends(df, ["track"], ["pos"], pairs).collect()}
    assert found == {("t", 1): "see Open", ("t", 2): "AI now $1", ("t", 3): None, ("u", 1): "open\x00ai", ("v", 1): "A", ("v", 2): "2 1x"}
    assert captions.replace_over_ends(df.limit(0), ["track"], ["pos"], pairs).count() == 0


def test_inner_repeats_by_definition():
    """The rule word by word: the longest end of three or more kept words that comes again is skipped."""
    import random

    from linewright.functions.unescape import without_inner_repeats

    def by_rule(words):
        kept, rest = [], list(words)
        while rest:
            ends = [k for k in range(3, min(len(kept), len(rest)) + 1) if kept[len(kept) - k :] == rest[:k]]
            if not ends:
                kept.append(rest[0])
            rest = rest[max(ends, default=1) :]
        return kept

    rng = random.Random(2)
    for _ in range(2000):
        words = [rng.choice("abc") for _ in range(rng.randint(6, 24))]
        assert without_inner_repeats(" ".join(words)).split() == by_rule(words)
