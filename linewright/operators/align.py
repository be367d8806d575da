"""Joins of tracks: by position, by greatest overlap, by range and by window.

Intervals are indexed by dyadic bins.  Time is cut into units; an interval of any
length is the union of at most two bins of each power of two of units, so one that
spans a whole track costs tens of rows, not one for each unit, while most cues take
one or two bins of a unit.  A point stands in one bin of each power: those powers
that some interval uses, found by a scalar subquery of the same plan.  Joins hash
on track, power and bin, and the exact bounds are checked afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def dyadic_cover(start: Column, end: Column, unit: int) -> Column:
    """The bins (level, node) whose union is the units that [start, end) touches; none if it is empty.

    Of each level at most the first and the last bin are needed: an odd one on the
    left, or one before an odd end on the right, has no partner to pair up with.
    """
    first, last = F.floor(start / unit).cast("long"), F.floor((end - 1) / unit).cast("long") + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2((last - first).cast("double"))).cast("int"))

    def bins(level: Column) -> Column:
        low, high = -_shift(-first, level), _shift(last, level)
        bin_ = lambda node: F.struct(level.alias("level"), node.alias("node"))
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        return F.array(F.when((low < high) & odd(low), bin_(low)), F.when((low < high) & odd(high), bin_(high - 1)))

    return F.when(end > start, F.array_compact(F.flatten(F.transform(levels, bins))))


def _spread(df: DataFrame, start: str, end: str, unit: int, outer: bool = False) -> DataFrame:
    """``df`` with a row for each bin of its intervals; ``outer`` keeps rows with empty ones."""
    each = (F.explode_outer if outer else F.explode)(dyadic_cover(F.col(start), F.col(end), unit))
    return df.withColumn("_bin", each).withColumns({"_level": F.col("_bin")["level"], "_node": F.col("_bin")["node"]}).drop("_bin")


def _levels(df: DataFrame, start: str, end: str, unit: int) -> Column:
    """The levels that the intervals of ``df`` use, as a scalar subquery."""
    used = F.transform(dyadic_cover(F.col(start), F.col(end), unit), lambda b: b["level"])
    return df.select(F.explode(used).alias("l")).agg(F.sort_array(F.collect_set("l")).alias("l")).scalar()


def _placed(df: DataFrame, at: str, unit: int, levels: Column) -> DataFrame:
    """``df`` with a row for each level: the bin that holds the point ``at``."""
    unit_no = F.floor(F.col(at) / unit).cast("long")
    return df.withColumn("_level", F.explode(levels)).withColumn("_node", _shift(unit_no, F.col("_level")))


def positional_join(master: DataFrame, other: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The i-th record of one with the i-th of the other, in tracks of equal numbers; the master gives the stamps."""
    numbered = lambda df: df.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(*order)), "_n": F.count("*").over(Window.partitionBy(*by))})
    right = numbered(other).select(*by, "_i", "_n", F.col(text).alias("other_text"))
    return numbered(master).join(right, [*by, "_i", "_n"]).drop("_i", "_n")


#: Units of time within which partners that can't be best are found.
_PRUNED = 16


def _eligible(df: DataFrame, by: list[str], width_ms: int) -> DataFrame:
    """``df`` (_os, _oe, _opos, _text) without records that lie within an earlier one (by ``_opos``): that overlaps whatever they do as long or longer.

    Equal intervals come first.  Then a record goes if of those before it, by start
    and in the same stretch of time, the one that ends last is an earlier record
    and ends no sooner; so of dense tracks some records for each stretch remain,
    however many there are.
    """
    equal = df.groupBy(*by, "_os", "_oe").agg(F.min("_opos").alias("_opos"), F.min_by("_text", "_opos").alias("_text"))
    before = Window.partitionBy(*by, F.floor(F.col("_os") / (_PRUNED * width_ms))).orderBy("_os", F.desc("_oe")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct(F.col("_oe").alias("end"), (-F.col("_opos")).alias("minus"))).over(before)
    within = (F.col("_last")["end"] >= F.col("_oe")) & (-F.col("_last")["minus"] < F.col("_opos"))
    return equal.withColumn("_last", last).where(~F.coalesce(within, F.lit(False))).drop("_last")


def overlap_join(master: DataFrame, other: DataFrame, by: list[str], pos: str = "pos", text: str = "text", width_ms: int = 60_000, placeholder: str | None = None, empty: bool = False) -> DataFrame:
    """Each master record with the text that overlaps it longest, the earliest of equals, or the placeholder.

    Two intervals overlap where one begins in the other, so each side comes as
    bins and as points, and bins of one meet points of the other: a pair is met
    once.  Equal intervals of the master are met once, the others' side keeps those
    that may be best (:func:`_eligible`), and only the best partner leaves the join.
    Records without length have no partner and are none; with ``empty`` they meet
    what they stand within, by an overlap of zero.
    """
    left = master.select(*by, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")).where(F.lit(empty) | F.expr("_s < _e")).distinct()
    right = other.select(*by, F.col(pos).alias("_opos"), F.col("start_ms").alias("_os"), F.col("end_ms").alias("_oe"), F.col(text).alias("_text")).where(F.lit(empty) | F.expr("_os < _oe"))
    right = _eligible(right, by, width_ms)
    both = lambda df, s, e, levels, role: _spread(df, s, e, width_ms).withColumn("_role", F.lit(role)).unionByName(_placed(df, s, width_ms, levels).withColumn("_role", F.lit(1 - role)))
    left_rows = both(left, "_s", "_e", _levels(right, "_os", "_oe", width_ms), 0)
    right_rows = both(right, "_os", "_oe", _levels(left, "_s", "_e", width_ms), 1)
    # role 0: the other begins within this one; role 1: this one begins within the other, or with it
    within = F.when(F.col("_role") == 0, (F.col("_s") < F.col("_os")) & (F.col("_os") < F.col("_e"))).otherwise((F.col("_os") <= F.col("_s")) & (F.col("_s") < F.col("_oe")))
    met = left_rows.join(right_rows, [*by, "_role", "_level", "_node"]).where(within & (F.col("_os") < F.col("_e")) & (F.col("_s") < F.col("_oe")))
    overlap = F.least("_e", "_oe") - F.greatest("_s", "_os")
    best = met.groupBy(*by, "_s", "_e").agg(F.max_by("_text", F.struct(overlap, -F.col("_opos"))).alias("other_text")).withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"})
    joined = master.join(best, [*by, "start_ms", "end_ms"], "left")
    return joined.select(*by, pos, *(c for c in master.columns if c not in (*by, pos)), F.coalesce("other_text", F.lit(placeholder)).alias("other_text"))


def align_tracks(master: DataFrame, other: DataFrame, by: list[str], order: list[str], pos: str = "pos", placeholder: str | None = None) -> DataFrame:
    """By position where both tracks have as many records, else by overlap."""
    sizes = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    equal = sizes(master, "_m").join(sizes(other, "_o"), by).where("_m = _o").select(*by)
    first = positional_join(master.join(equal, by, "left_semi"), other.join(equal, by, "left_semi"), by, order)
    second = overlap_join(master.join(equal, by, "left_anti"), other, by, pos, placeholder=placeholder)
    return first.unionByName(second)


def patch_ranges(base: DataFrame, patch: DataFrame, by: list[str], patch_id: str = "patch_id", width_ms: int = 600_000) -> DataFrame:
    """The base without records that start in a patch's range [first start, last end), and the patches' records.

    Whether a record goes depends on its track and start alone: the distinct starts
    meet the ranges' bins, and records whose start was met are left out.
    """
    ranges = patch.groupBy(*by, patch_id).agg(F.min("start_ms").alias("_lo"), F.max("end_ms").alias("_hi")).select(*by, "_lo", "_hi")
    starts = base.select(*by, "start_ms").distinct()
    met = _placed(starts, "start_ms", width_ms, _levels(ranges, "_lo", "_hi", width_ms)).join(_spread(ranges, "_lo", "_hi", width_ms), [*by, "_level", "_node"])
    gone = met.where("start_ms >= _lo and start_ms < _hi").select(*by, "start_ms").distinct()
    return base.join(gone, [*by, "start_ms"], "left_anti").select(base.columns).unionByName(patch.select(base.columns))


def window_counts(windows: DataFrame, cues: DataFrame, by: list[str], width_ms: int = 600_000) -> DataFrame:
    """``n`` of cues that start in each window [win_start, win_end); windows without cues stay with 0."""
    left = _spread(windows, "win_start", "win_end", width_ms, outer=True)
    # counts by start shrink the cues before the join
    starts = cues.groupBy(*by, "start_ms").agg(F.count("*").alias("_n"))
    right = _placed(starts, "start_ms", width_ms, _levels(windows, "win_start", "win_end", width_ms))
    met = left.join(right, [*by, "_level", "_node"], "left")
    inside = (F.col("start_ms") >= F.col("win_start")) & (F.col("start_ms") < F.col("win_end"))
    return met.groupBy(*windows.columns).agg(F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("n"))


def density_gaps(windows: DataFrame, cues: DataFrame, by: list[str], least_per_minute: float = 5.0) -> DataFrame:
    """Windows of positive length with fewer cues to the minute."""
    counted = window_counts(windows.where("win_end > win_start"), cues, by)
    return counted.where(F.col("n") * 60_000 / (F.col("win_end") - F.col("win_start")) < least_per_minute).select(*by, F.col("win_start").alias("gap_start"), F.col("win_end").alias("gap_end"), F.lit("low density").alias("reason"))


def coverage_labels(ranges: DataFrame, points: DataFrame, by: list[str], width: int = 600) -> DataFrame:
    """Points (at, label) that fall into each range [first, last], joined in order; a range without points goes."""
    closed = ranges.withColumn("_end", F.col("last") + 1)
    dealt = _spread(closed, "first", "_end", width)
    placed = _placed(points.select(*by, "at", "label"), "at", width, _levels(closed, "first", "_end", width))
    met = dealt.join(placed, [*by, "_level", "_node"]).where("at between first and last")
    return met.groupBy(*ranges.columns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), ", ").alias("labels"))
