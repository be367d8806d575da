"""Running values along a track that no single task has to hold: prefix scans in two passes.

A window over a track puts the whole track into one task.  Here a track is cut into
chunks along its order.  The first pass reduces every chunk to one row (sums,
maxima, its last values); a window over these few rows gives each chunk what stands
before it; the second pass runs windows inside the chunks and adds that.  One
shuffle by track and chunk serves the windows and the join, so one long track
spreads like many short ones.

``chunk`` is a column that never falls along ``order``, such as ``floor(start_ms /
600000)``: records of one chunk share a task, so choose it by what a task can take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(by: list[str], chunk: Column) -> Column:
    """Track and chunk as one value that is never null: null-safe keys would be shuffled once for windows and again for the join."""
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), chunk.alias("chunk"))


def _track(by: list[str]) -> list[Column]:
    return [F.col("_key")[f"k{i}"] for i in range(len(by))]


def _along(by: list[str]) -> Window:
    """A track's chunks in order."""
    return Window.partitionBy(*_track(by)).orderBy(F.col("_key")["chunk"])


def scanned(
    df: DataFrame,
    by: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """``df`` with running values: sums up to and with each record, maxima of the records before it, values of the one before it, and its number from 1.

    Null values don't count in sums and maxima; where nothing stands before, a
    maximum and a previous value are null and a sum counts from 0.
    """
    sums, maxima, previous = dict(sums or {}), maxima or {}, previous or {}
    if number:
        sums[number] = F.lit(1)
    names = {n: f"_v{i}" for i, n in enumerate([*sums, *maxima, *previous])}
    rows = df.withColumn("_key", _key(by, chunk)).withColumns({names[n]: c for part in (sums, maxima, previous) for n, c in part.items()})
    place = F.struct(*order)
    last = F.max_by(F.struct(*(F.col(names[n]).alias(n) for n in previous), F.lit(1).alias("_")), place)
    totals = rows.groupBy("_key").agg(*(F.sum(names[n]).alias(f"_s{i}") for i, n in enumerate(sums)), *(F.max(names[n]).alias(f"_m{i}") for i, n in enumerate(maxima)), last.alias("_last"))
    chunks = _along(by)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_key").alias("_carried"),
        *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_bs{i}") for i in range(len(sums))),
        *(F.max(f"_m{i}").over(before).alias(f"_bm{i}") for i in range(len(maxima))),
        F.lag("_last").over(chunks).alias("_blast"),
    )
    inside = Window.partitionBy("_key").orderBy(*order)
    up_to, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_first", F.row_number().over(inside) == 1)
    local = local.withColumns({f"_ls{i}": F.coalesce(F.sum(names[n]).over(up_to), F.lit(0)) for i, n in enumerate(sums)} | {f"_lm{i}": F.max(names[n]).over(earlier) for i, n in enumerate(maxima)} | {f"_lp{i}": F.lag(names[n]).over(inside) for i, n in enumerate(previous)})
    out = local.join(carried, F.col("_key") == F.col("_carried"))
    values = {n: (F.col(f"_ls{i}") + F.col(f"_bs{i}")) for i, n in enumerate(sums)}
    values |= {n: F.greatest(f"_lm{i}", f"_bm{i}") for i, n in enumerate(maxima)}
    values |= {n: F.when(F.col("_first"), F.col("_blast")[n]).otherwise(F.col(f"_lp{i}")) for i, n in enumerate(previous)}
    return out.select(*df.columns, *(c.alias(n) for n, c in values.items()))


def lagged(df: DataFrame, by: list[str], order: list[str], chunk: Column, value: Column, names: list[str]) -> DataFrame:
    """``df`` with the values of the records before each one, the nearest first, a column for each of ``names``; null where none stands.

    One shuffle, however many: a chunk's last values come from its last record's own
    lags, and as many chunks before it hold at least as many records.
    """
    n = len(names)
    inside = Window.partitionBy("_key").orderBy(*order)
    rows = df.withColumns({"_key": _key(by, chunk), "_value": value})
    local = rows.withColumns({"_at": F.row_number().over(inside)} | {f"_l{i}": F.lag("_value", i).over(inside) for i in range(1, n + 1)})
    ends = F.slice(F.array("_value", *(f"_l{i}" for i in range(1, n))), F.lit(1), F.least(F.col("_at"), F.lit(n)))
    tails = local.groupBy("_key").agg(F.max_by(ends, F.struct(*order)).alias("_tail"))
    chunks = _along(by)
    none = F.array().cast(tails.schema["_tail"].dataType)
    carried = tails.select(
        F.col("_key").alias("_carried"),
        F.concat(*(F.coalesce(F.lag("_tail", i).over(chunks), none) for i in range(1, n + 1))).alias("_before"),
    )
    out = local.join(carried, F.col("_key") == F.col("_carried"))
    return out.select(*df.columns, *(F.when(F.col("_at") > i, F.col(f"_l{i}")).otherwise(F.get("_before", F.lit(i) - F.col("_at"))).alias(c) for i, c in enumerate(names, 1)))


def run_edges(df: DataFrame, by: list[str], order: list[str], chunk: Column, value: Column) -> DataFrame:
    """``df`` with ``_begins``, whether a run of equal values begins with the record, and ``_size``, the run's number of records.

    Runs are found within the chunks; of a chunk only its first and its last run may
    go on beyond it, and these are added up over the chunks, a row or two for each.
    """
    inside = Window.partitionBy("_key").orderBy(*order)
    before = F.lag("_value").over(inside)
    rows = df.withColumns({"_key": _key(by, chunk), "_value": value}).withColumn("_own", (F.row_number().over(inside) == 1) | ~F.col("_value").eqNullSafe(before))
    rows = rows.withColumn("_run", F.sum(F.col("_own").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_key", "_run")))
    end = lambda pick: pick(F.struct(F.col("_value").alias("v"), F.col("_n").alias("n"), F.col("_run").alias("r")), F.struct(*order))
    ends = local.groupBy("_key").agg(end(F.min_by).alias("_f"), end(F.max_by).alias("_l"))
    chunks = _along(by)
    earlier = F.lag("_l").over(chunks)
    ends = ends.withColumn("_on", F.coalesce(earlier.isNotNull() & F.col("_f.v").eqNullSafe(earlier["v"]), F.lit(False))).withColumn("_many", (F.col("_l.r") > 1).cast("long"))
    first = F.sum((~F.col("_on")).cast("long") + F.col("_many")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_many")
    part = lambda run, end: F.struct(run.alias("run"), F.col(f"{end}.n").alias("n"), F.lit(end).alias("end"))
    parts = ends.withColumn("_first", first).select("_key", "_on", F.col("_l.r").alias("_runs"), F.explode(F.when(F.col("_many") == 0, F.array(part(F.col("_first"), "_f"))).otherwise(F.array(part(F.col("_first"), "_f"), part(F.col("_first") + 1, "_l")))).alias("_p"))
    summed = parts.withColumn("_total", F.sum("_p.n").over(Window.partitionBy(*_track(by), "_p.run")))
    total = lambda end: F.max(F.when(F.col("_p.end") == end, F.col("_total")))
    carried = summed.groupBy(F.col("_key").alias("_carried")).agg(F.first("_on").alias("_on"), F.first("_runs").alias("_runs"), total("_f").alias("_tf"), total("_l").alias("_tl"))
    size = F.when(F.col("_run") == 1, F.col("_tf")).when(F.col("_run") == F.col("_runs"), F.col("_tl")).otherwise(F.col("_n"))
    return local.join(carried, F.col("_key") == F.col("_carried")).select(*df.columns, (F.col("_own") & ~((F.col("_run") == 1) & F.col("_on"))).alias("_begins"), size.alias("_size"))


def numbered(df: DataFrame, by: list[str], order: list[str], chunk: Column | None, name: str) -> DataFrame:
    """``df`` with the number of each record in its track, by a window or, with ``chunk``, by a scan."""
    if chunk is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return scanned(df, by, order, chunk, number=name).withColumn(name, F.col(name).cast("int"))
