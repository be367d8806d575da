"""Operators on ordered records: runs, gaps, intervals, batches and sections.

A track's records share the key columns ``by`` and are ordered by ``order``
(unique within the track).  Windows are partitioned by the key, so the work spreads
over the tracks.  Where a single track may hold much of the data, the operators
that take ``chunk``, a column that never falls along the order, compute the same by
prefix scans over chunks of the track (:mod:`.scans`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import numbered, run_edges, scanned


def _window(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: list[str], order: list[str], change: Column, name: str = "island") -> DataFrame:
    """Number the stretches of a track; ``change`` is true where a new one begins."""
    w = _window(by, order)
    flag = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(change.cast("int"), F.lit(0)))
    return df.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_flag")


def _runs(df: DataFrame, by: list[str], order: list[str], value: Column) -> DataFrame:
    before = F.lag("_value").over(_window(by, order))
    return islands(df.withColumn("_value", value), by, order, ~F.col("_value").eqNullSafe(before), "_run")


def mark_changes(df: DataFrame, by: list[str], order: list[str], value: str, name: str, chunk: Column) -> DataFrame:
    """``df`` with ``name``: whether the value differs from that of the record before, by a scan."""
    rows = scanned(df, by, order, chunk, previous={"_before": F.col(value), "_any": F.lit(True)})
    return rows.withColumn(name, F.col("_any").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_any")


def collapse_runs(df: DataFrame, by: list[str], order: list[str], value: str, least: int = 3, chunk: Column | None = None) -> DataFrame:
    """Of a run of at least ``least`` equal values the first record stays; shorter runs stay whole."""
    if chunk is not None:
        return run_edges(df, by, order, chunk, F.col(value)).where(F.col("_begins") | (F.col("_size") < least)).select(*df.columns)
    runs = _runs(df, by, order, F.col(value))
    size = F.count("*").over(Window.partitionBy(*by, "_run"))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order))
    return runs.withColumns({"_size": size, "_place": place}).where((F.col("_size") < least) | (F.col("_place") == 1)).drop("_value", "_run", "_size", "_place")


def run_sizes(df: DataFrame, by: list[str], order: list[str], value: str, least: int = 3) -> DataFrame:
    """n_in and n_out of each track: its records, and those that :func:`collapse_runs` leaves, by one window and sums over its runs."""
    runs = _runs(df, by, order, F.col(value)).groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(*by).agg(F.sum("_n").alias("n_in"), F.sum(F.when(F.col("_n") < least, F.col("_n")).otherwise(1)).alias("n_out"))


def drop_adjacent_repeats(df: DataFrame, by: list[str], order: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Records equal to the one before them go."""
    if chunk is not None:
        return mark_changes(df, by, order, value, "_begins", chunk).where("_begins").drop("_begins")
    w = _window(by, order)
    marked = df.withColumns({"_first": F.row_number().over(w) == 1, "_before": F.lag(value).over(w)})
    return marked.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def collapse_short_streaks(df: DataFrame, by: list[str], order: list[str], value: str, most_chars: int = 3, least: int = 20) -> DataFrame:
    """Of a maximal streak of at least ``least`` short records the first stays."""
    short = F.length(F.trim(F.coalesce(value, F.lit("")))) <= most_chars
    runs = _runs(df, by, order, short)
    size = F.count("*").over(Window.partitionBy(*by, "_run"))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order))
    kept = ~F.col("_value") | (F.col("_size") < least) | (F.col("_place") == 1)
    return runs.withColumns({"_size": size, "_place": place}).where(kept).drop("_value", "_run", "_size", "_place")


def clean_hallucinations(df: DataFrame, by: list[str], order: list[str], value: str, *, least: int = 3, drop_long: Column | None = None, strict: bool = False, most_chars: int = 3, streak: int = 20) -> DataFrame:
    """The clean-ups in their order, each on what the one before left: runs, long lines (``drop_long``), then short streaks."""
    out = collapse_runs(df, by, order, value, least)
    if drop_long is not None:
        out = out.where(~F.coalesce(drop_long, F.lit(False)))
    return collapse_short_streaks(out, by, order, value, most_chars, streak) if strict else out


def gap_report(detected: list[DataFrame], by: list[str], pad_ms: int = 5000) -> DataFrame:
    """The findings of all detectors (gap_start, gap_end, reason) put together and merged where they touch.

    A finding that ends before it starts, as a faulty cue gives one, is kept with
    its bounds as they are; repair the cues before (:func:`repair_ends`) to have
    none.  Merged findings reach to the furthest end.
    """
    names = [*by, "gap_start", "gap_end", "reason"]
    every = reduce(DataFrame.unionByName, [d.select(names) for d in detected])
    return merge_intervals(every, by, "gap_start", "gap_end", pad_ms, "reason")


def concat_batches(df: DataFrame, by: list[str], batch: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """All batches of a track in the order of their numbers, renumbered from 1 as ``pos``."""
    return numbered(df, by, [batch, *order], chunk, "pos")


def in_range(chapters: DataFrame, index: str, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> DataFrame:
    """Chapters from ``first`` to ``last``, or those listed in ``only``."""
    if only is not None:
        return chapters.where(F.col(index).isin(only))
    lower = chapters if first is None else chapters.where(F.col(index) >= first)
    return lower if last is None else lower.where(F.col(index) <= last)


def end_samples(df: DataFrame, by: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first and last ``n`` records of every track."""
    size = F.count("*").over(Window.partitionBy(*by))
    placed = df.withColumns({"_at": F.row_number().over(_window(by, order)), "_size": size})
    return placed.where((F.col("_at") <= n) | (F.col("_at") > F.col("_size") - n)).drop("_at", "_size")


def time_jumps(df: DataFrame, by: list[str], order: list[str], least_ms: int = 30_000) -> DataFrame:
    """Gaps of more than ``least_ms`` between a record's start and its predecessor's end."""
    w = _window(by, order)
    gaps = df.withColumn("gap_start", F.lag("end_ms").over(w))
    return gaps.where(F.col("start_ms") - F.col("gap_start") > least_ms).select(*by, "gap_start", F.col("start_ms").alias("gap_end"), F.lit("time jump").alias("reason"))


def repeated_characters(df: DataFrame, by: list[str], text: str, least: int = 5) -> DataFrame:
    """Records whose text holds a character ``least`` times in a row."""
    return df.where(F.col(text).rlike(rf"(.)\1{{{least - 1},}}")).select(*by, F.col("start_ms").alias("gap_start"), F.col("end_ms").alias("gap_end"), F.lit("repeated character").alias("reason"))


def blank_blocks(df: DataFrame, by: list[str], order: list[str], text: str, least: int = 2) -> DataFrame:
    """From the first start to the last end of runs of at least ``least`` blank records."""
    runs = _runs(df, by, order, F.trim(F.coalesce(text, F.lit(""))) == "")
    return runs.where("_value").groupBy(*by, "_run").agg(F.min_by("start_ms", F.struct(*order)).alias("gap_start"), F.max_by("end_ms", F.struct(*order)).alias("gap_end"), F.count("*").alias("_n")).where(F.col("_n") >= least).select(*by, "gap_start", "gap_end", F.lit("blank block").alias("reason"))


def timeline_windows(spec: DataFrame, by: list[str], text: str = "spec", total_ms: str = "total_ms", ordered: bool = False) -> DataFrame:
    """Adjacent windows between the points of a timeline such as ``0;1:30;01:00:00``; the last ends with the track."""
    tokens = F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    points = spec.select(*by, total_ms, F.posexplode(tokens).alias("pos", "token"))
    seconds = F.aggregate(F.split("token", ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    points = points.withColumn("win_start", (seconds * 1000).cast("long"))
    w = Window.partitionBy(*by).orderBy(*(["win_start"] if ordered else []), "pos")
    return points.withColumn("win_end", F.coalesce(F.lead("win_start").over(w), F.col(total_ms))).withColumn("win_no", F.row_number().over(w)).select(*by, "win_no", "win_start", "win_end")


def merge_intervals(df: DataFrame, by: list[str], start: str = "gap_start", end: str = "gap_end", pad_ms: int = 5000, label: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Intervals that overlap or come within ``pad_ms`` become one; labels are kept in order of start."""
    tie = [c for c in (start, end, label) if c]
    if chunk is not None:
        flagged = scanned(df, by, tie, chunk, maxima={"_reach": F.col(end)})
        apart = (F.col(start) > F.col("_reach") + pad_ms).cast("int")
        marked = scanned(flagged, by, tie, chunk, sums={"_merged": F.coalesce(apart, F.lit(0))})
    else:
        w = Window.partitionBy(*by).orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
        flagged = df.withColumn("_reach", F.max(end).over(w))
        marked = islands(flagged, by, tie, F.col(start) > F.col("_reach") + pad_ms, "_merged")
    out = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")]
    if label:
        out.append(F.transform(F.array_sort(F.collect_list(F.struct(*tie))), lambda x: x[label]).alias("reasons"))
    return marked.groupBy(*by, "_merged").agg(*out).drop("_merged")


def stamp_faults(df: DataFrame, by: list[str], order: list[str], tolerance_ms: int = 600_000) -> DataFrame:
    """``fault`` of each record: ``bad_end`` (ends before it starts), else ``backward`` (starts far before the furthest end so far)."""
    reach = F.max("end_ms").over(_window(by, order).rowsBetween(Window.unboundedPreceding, -1))
    backward = (F.col("_reach") > 0) & (F.col("start_ms") + tolerance_ms < F.col("_reach"))
    return df.withColumn("_reach", reach).withColumn("fault", F.when(F.col("end_ms") < F.col("start_ms"), "bad_end").when(backward, "backward")).drop("_reach")


def repair_ends(df: DataFrame, by: list[str], order: list[str], default_ms: int = 3000) -> DataFrame:
    """An end before its start becomes the next record's start, or the start plus ``default_ms`` for the last."""
    following = F.lead("start_ms").over(_window(by, order))
    return df.withColumn("_next", following).withColumn("end_ms", F.when(F.col("end_ms") < F.col("start_ms"), F.coalesce("_next", F.col("start_ms") + default_ms)).otherwise(F.col("end_ms"))).drop("_next")


def batch_by_entry(df: DataFrame, by: list[str], order: list[str], batches: int | Column) -> DataFrame:
    """``batch_num`` by equal numbers of records: the ceiling of their quotient to each batch."""
    total = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(_window(by, order))
    n = F.lit(batches) if isinstance(batches, int) else batches
    return df.withColumns({"_total": total, "_place": place}).withColumn("batch_num", (F.floor((F.col("_place") - 1) / F.ceil(F.col("_total") / n)) + 1).cast("int")).drop("_total", "_place")


def batch_by_time(df: DataFrame, by: list[str], order: list[str], batches: int) -> DataFrame:
    """``batch_num`` by equal spans of the time up to the last record's end; by entry where that is not positive."""
    every = _window(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    timed = batch_by_entry(df, by, order, batches).withColumn("_total", F.last("end_ms").over(every))
    by_time = F.least(F.floor(F.col("start_ms") * batches / F.col("_total")), F.lit(batches - 1)) + 1
    return timed.withColumn("batch_num", F.when(F.col("_total") > 0, by_time).otherwise(F.col("batch_num")).cast("int")).drop("_total")


def auto_batches(total: Column) -> Column:
    """How many batches a track of ``total`` records gets."""
    return F.when(total <= 450, F.greatest(F.lit(2), F.ceil(total / 150))).when(total <= 1200, F.ceil(total / 200)).otherwise(F.ceil(total / 250)).cast("int")


def mark_last_batch(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("is_last", F.col("batch_num") == F.max("batch_num").over(Window.partitionBy(*by)))


def segment_offsets(segments: DataFrame, by: list[str], order: list[str], duration: str = "duration_ms", chunk: Column | None = None) -> DataFrame:
    """``offset_ms``: the durations of all segments before each one."""
    if chunk is not None:
        summed = scanned(segments, by, order, chunk, sums={"offset_ms": F.col(duration)})
        return summed.withColumn("offset_ms", F.col("offset_ms") - F.coalesce(duration, F.lit(0)))
    before = _window(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset_ms", F.coalesce(F.sum(duration).over(before), F.lit(0)))


def merge_segments(cues: DataFrame, segments: DataFrame, by: list[str], segment: str = "seg_no", duration: str = "duration_ms") -> DataFrame:
    """Cues of segments on one clock; a segment without cues still counts with its duration."""
    placed = segment_offsets(segments, by, [segment], duration).select(*by, segment, "offset_ms")
    moved = cues.join(placed, [*by, segment])
    return moved.withColumns({"start_ms": F.col("start_ms") + F.col("offset_ms"), "end_ms": F.col("end_ms") + F.col("offset_ms")}).drop("offset_ms")


def shift_patch(df: DataFrame, offset_ms: Column | int, skip_ms: Column | int = 0) -> DataFrame:
    """Cues that end by ``skip_ms`` go, the others move by ``offset_ms``."""
    offset, skip = (F.lit(x) if isinstance(x, int) else x for x in (offset_ms, skip_ms))
    return df.where(F.col("end_ms") > skip).withColumns({"start_ms": F.col("start_ms") + offset, "end_ms": F.col("end_ms") + offset})


def sections(df: DataFrame, by: list[str], order: list[str], is_marker: Column, chunk: Column | None = None) -> DataFrame:
    """``section``: 0 before the first marker line, then a number for each marker."""
    if chunk is not None:
        return scanned(df, by, order, chunk, sums={"section": is_marker.cast("int")}).withColumn("section", F.col("section").cast("int"))
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.sum(is_marker.cast("int")).over(w).cast("int"))


def section_texts(df: DataFrame, by: list[str], order: list[str], line: str, marker: str) -> DataFrame:
    """One row for each section: its marker line, number of lines and characters, and its text."""
    cut = sections(df, by, order, F.coalesce(F.col(line).rlike(marker), F.lit(False)))
    lines = F.array_sort(F.collect_list(F.struct(*order, line)))
    out = cut.groupBy(*by, "section").agg(lines.alias("_lines"))
    texts = F.transform("_lines", lambda x: x[line])
    return out.select(*by, "section", F.when(F.col("section") > 0, texts[0]).alias("heading"), F.size("_lines").alias("n_lines"), F.array_join(texts, "\n").alias("text"))


def appendix_ends(markers: DataFrame, by: list[str], selected: list[str]) -> DataFrame:
    """Lines (pos, end) of the appendices with the selected letters.

    ``markers`` has pos, kind (``letter`` or ``number``) and label; an appendix
    ends where the next selected letter or the first number after it begins.
    """
    stops = (F.col("kind") == "number") | F.col("label").isin(selected)
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return markers.withColumn("end", F.min(F.when(stops, F.col("pos"))).over(w)).where((F.col("kind") == "letter") & F.col("label").isin(selected)).select(*by, "label", "pos", "end")


def group_chapters(chapters: DataFrame, by: list[str], order: str, is_head: Column) -> DataFrame:
    """Chapters below a heading: titles, places and total size; group 0 stands before the first heading."""
    cut = sections(chapters, by, [order], is_head).withColumnRenamed("section", "chapter_group")
    listed = F.array_sort(F.collect_list(F.struct(order, "file", "size")))
    out = cut.groupBy(*by, "chapter_group").agg(listed.alias("_all"), F.sum("size").alias("total_size"))
    return out.select(*by, "chapter_group", F.transform("_all", lambda x: x["file"]).alias("files"), F.transform("_all", lambda x: x[order]).alias("indices"), "total_size")


def drop_trailing_untitled(chapters: DataFrame, by: list[str], order: str, title: str = "title") -> DataFrame:
    """Chapters after the last one with a title of its own go."""
    titled = F.max(F.when(~F.coalesce(F.col(title).startswith("(untitled-"), F.lit(True)), F.col(order))).over(Window.partitionBy(*by))
    return chapters.withColumn("_last", titled).where(F.col(order) <= F.col("_last")).drop("_last")


def read_batches(df: DataFrame, lines: str = "n_lines", n_bytes: str = "n_bytes", most: Column | int = 150) -> DataFrame:
    """Stretches of lines (first, last) of at most ``most`` lines and about 6,000 bytes."""
    most = F.lit(most) if isinstance(most, int) else most
    average = F.col(n_bytes) / F.greatest(F.col(lines), F.lit(1))
    limit = F.least(most, F.greatest(F.lit(10), F.floor(F.lit(6000) / F.greatest(average, F.lit(1))))).cast("long")
    starts = F.sequence(F.lit(1).cast("long"), F.col(lines).cast("long"), F.col("_limit"))
    return df.where(F.col(lines) > 0).withColumn("_limit", limit).withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + F.col("_limit") - 1, F.col(lines))).drop("_limit")
