"""Which lines of a long track to read: plans by size and by timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For sizes below each number of entries the parts of a plan.
#: A part is (kind, place, lines); kinds are head, share (of all lines), step
#: (place of so many equal steps between head and tail) and tail, whose place
#: is the least offset.
PRESETS = {
    "podcast": [
        (400, [("head", 0, 500), ("tail", 500, 200)]),
        (800, [("head", 0, 400), ("share", 0.30, 400), ("share", 0.60, 400), ("tail", 0, 200)]),
        (1500, [("head", 0, 300), ("share", 0.20, 400), ("share", 0.42, 400), ("share", 0.65, 400), ("tail", 0, 236)]),
        (None, [("head", 0, 300), ("share", 0.15, 400), ("share", 0.29, 400), ("share", 0.43, 400), ("share", 0.57, 400), ("share", 0.71, 400), ("tail", 0, 236)]),
    ],
    "reading": [
        (400, [("head within", 0, 500), ("tail", 0, 200)]),
        (800, [("head", 0, 400), ("quarter", 1, 400), ("quarter", 2, 400), ("tail", 0, 200)]),
        (1500, [("head", 0, 300), ("step", (1, 4), 400), ("step", (2, 4), 400), ("step", (3, 4), 400), ("tail", 0, 236)]),
        (None, [("head", 0, 300), ("step", (1, 6), 400), ("step", (2, 6), 400), ("step", (3, 6), 400), ("step", (4, 6), 400), ("step", (5, 6), 400), ("tail", 0, 236)]),
    ],
    "translation": [
        (400, [("head", 0, 500), ("tail", 500, 200)]),
        (None, [("head", 0, 500), ("tail", 0, 200)]),
    ],
}
_STEP_HEAD, _STEP_TAIL = 300, 236


def _part(kind: str, place, size: int, lines: Column, within: bool) -> Column:
    if kind.startswith("head"):
        offset, length = F.lit(0), F.least(F.lit(size), lines) if kind == "head within" else F.lit(size)
    elif kind == "share":
        offset, length = F.bround(lines * place), F.lit(size)
    elif kind == "quarter":
        offset, length = F.floor(lines / 4) * place, F.lit(size)
    elif kind == "step":
        offset, length = _STEP_HEAD + F.floor((lines - _STEP_HEAD - _STEP_TAIL) / place[1]) * place[0], F.lit(size)
    else:
        offset, length = F.greatest(lines - size, F.lit(place)), F.least(F.lit(size), lines) if within else F.lit(size)
    return F.struct(offset.cast("long").alias("offset"), length.cast("long").alias("length"), F.lit(kind.split()[0] if kind != "quarter" else "share").alias("label"))


def sampling_plan(df: DataFrame, preset: str = "podcast", entries: str = "entries", lines: str = "n_lines") -> DataFrame:
    """(part, offset, length, label) of every part to read of each track."""
    plan = None
    for limit, parts in reversed(PRESETS[preset]):
        listed = F.array(*(_part(*p, F.col(lines), preset == "reading") for p in parts))
        plan = listed if plan is None else F.when(F.col(entries) < limit, listed).otherwise(plan)
    return df.select("*", F.posexplode(plan).alias("part", "_p")).select(*df.columns, "part", "_p.*")


def plan_of(entries: int, lines: int, preset: str = "podcast") -> list[tuple[int, int, str]]:
    """(offset, length, label) of the parts to read of one track: :func:`sampling_plan` for use inside a table function."""
    out = []
    for kind, place, size in next(parts for limit, parts in PRESETS[preset] if limit is None or entries < limit):
        length = min(size, lines) if kind == "head within" or kind == "tail" and preset == "reading" else size
        if kind.startswith("head"):
            offset = 0
        elif kind == "share":
            offset = round(lines * place)  # half to even
        elif kind == "quarter":
            offset = lines // 4 * place
        elif kind == "step":
            offset = _STEP_HEAD + (lines - _STEP_HEAD - _STEP_TAIL) // place[1] * place[0]
        else:
            offset = max(lines - size, place)
        out.append((offset, length, "share" if kind == "quarter" else kind.split()[0]))
    return out


def _clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def timeline_reads(df: DataFrame, reads: int = 5, lines: str = "n_lines", points: str = "points", total: str = "total_sec") -> DataFrame:
    """Reads spaced evenly by lines, labelled with their time and the timeline's points within it."""
    reads = max(2, reads)
    n = F.col(lines)
    size = F.when(n < 6000, 400).otherwise(350)
    step = F.greatest(F.lit(0), n - size) / (reads - 1)
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(reads - 1)))).withColumn("offset", F.bround(F.col("part") * step).cast("long"))
    rows = rows.withColumn("length", F.least(size, F.greatest(F.lit(50), n - F.col("offset"))).cast("long"))
    rows = rows.withColumns({"_from": F.col("offset") / n * F.col(total), "_to": (F.col("offset") + F.col("length")) / n * F.col(total)})
    covered = F.transform(F.filter(points, lambda x: (x >= F.col("_from")) & (x < F.col("_to"))), _clock)
    span = F.concat(_clock(F.col("_from")), F.lit("~"), _clock(F.col("_to")))
    label = F.when(F.size(covered) > 0, F.concat(span, F.lit(" (covers TL: "), F.array_join(covered, ", "), F.lit(")"))).otherwise(span)
    return rows.withColumn("label", label).drop("_from", "_to")
