"""Queries that are SQL text over table functions, and the reading plans of all presets and of timelines."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts, tables, unescape
from ..operators import reading_plans
from .catalogue import _query
from .rendered import _KEPT, _TRACKS, _tracks
from .tables import LINES, lines, read


def _sql(spark: SparkSession, df: DataFrame, text: str) -> DataFrame:
    """The rows of SQL text that reads ``df`` as ``{rows}``."""
    tables.register(spark)
    name = f"rows_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return spark.sql(text.format(rows=name))


@_query(f"WITH {_TRACKS} SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY no) AS INT) AS pos, CAST(idx AS INT) AS idx, s AS start_ms, e AS end_ms, {_KEPT['captions'][0]} AS text FROM r WHERE {_KEPT['captions'][1]}")
def lateral_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, _tracks(spark, sf_dir), "SELECT t.track_id, c.* FROM {rows} t, LATERAL subtitle_cues(t.text, 'captions') c")


@_query(f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines)
    SELECT doc_id, CAST(section AS INT) AS section, CASE WHEN section > 0 THEN arg_min(line, pos) END AS heading, CAST(count(*) AS INT) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, section""")
def lateral_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, read(spark, sf_dir, "documents"), "SELECT d.doc_id, s.* FROM {rows} d, LATERAL text_sections(d.text, '^The') s")


#: The fixed values of the presets as rows: preset, entries from and below, part, kind, two numbers of the place, lines.
_PARTS = ", ".join(
    f"('{preset}', {previous}, {limit or 10**9}, {i}, '{kind}', {place[0] if isinstance(place, tuple) else place}, {place[1] if isinstance(place, tuple) else 0}, {size})"
    for preset, groups in reading_plans.PRESETS.items()
    for previous, (limit, parts) in zip([0, *(g[0] for g in groups)], groups, strict=False)
    for i, (kind, place, size) in enumerate(parts)
)
_SIZES = f"WITH {LINES}, z AS (SELECT doc_id, count(*) * 37 AS n_lines FROM lines GROUP BY doc_id), e AS (SELECT *, n_lines * 3 // 4 AS entries FROM z)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lines(spark, sf_dir).groupBy("doc_id").agg((F.count("*") * 37).alias("n_lines"))
    return counted.withColumn("entries", F.floor(F.col("n_lines") * 3 / 4))


@_query(f"""{_SIZES}, p(preset, low, high, part, kind, a, b, size) AS (VALUES {_PARTS})
    SELECT doc_id, preset, CAST(part AS INT) AS part,
           CAST(CASE WHEN kind LIKE 'head%' THEN 0 WHEN kind = 'share' THEN round_even(n_lines * CAST(a AS DOUBLE), 0) WHEN kind = 'quarter' THEN n_lines // 4 * a
                     WHEN kind = 'step' THEN 300 + floor((n_lines - 536) / b) * a ELSE greatest(n_lines - size, a) END AS BIGINT) AS "offset",
           CAST(CASE WHEN kind = 'head within' OR kind = 'tail' AND preset = 'reading' THEN least(size, n_lines) ELSE size END AS BIGINT) AS length,
           CASE kind WHEN 'quarter' THEN 'share' WHEN 'head within' THEN 'head' ELSE kind END AS label
    FROM e JOIN p ON entries >= low AND entries < high""")
def sampling_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets on tracks of all sizes."""
    sizes = _sizes(spark, sf_dir)
    plans = [reading_plans.sampling_plan(sizes, p).select("doc_id", F.lit(p).alias("preset"), "part", "offset", "length", "label") for p in reading_plans.PRESETS]
    return reduce(DataFrame.unionByName, plans)


@_query(f"""{_SIZES}, p(preset, low, high, part, kind, a, b, size) AS (VALUES {_PARTS})
    SELECT doc_id, CAST(part AS INT) AS part, CAST(CASE WHEN kind = 'head' THEN 0 WHEN kind = 'share' THEN round_even(n_lines * CAST(a AS DOUBLE), 0) ELSE greatest(n_lines - size, a) END AS BIGINT) AS "offset", CAST(size AS BIGINT) AS length, kind AS label
    FROM e JOIN p ON preset = 'podcast' AND entries >= low AND entries < high""")
def lateral_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, _sizes(spark, sf_dir), "SELECT s.doc_id, p.* FROM {rows} s, LATERAL reading_plan(s.entries, s.n_lines, 'podcast') p")


_MINUTES = "CAST(CAST(floor({0}) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@_query(f"""{_SIZES}, r AS (SELECT doc_id, n_lines, k AS part, CASE WHEN n_lines < 6000 THEN 400 ELSE 350 END AS size FROM e, range(5) t(k)),
    o AS (SELECT *, CAST(round_even(k * (greatest(0, n_lines - size) / 4), 0) AS BIGINT) AS o FROM (SELECT *, part AS k FROM r)),
    l AS (SELECT *, least(size, greatest(50, n_lines - o)) AS len FROM o), f AS (SELECT *, o / n_lines * 3000.0 AS a, (o + len) / n_lines * 3000.0 AS b FROM l),
    c AS (SELECT *, list_filter([0.0, 450.5, 1300.0, 2999.0], lambda x: x >= a AND x < b) AS inside FROM f)
    SELECT doc_id, CAST(part AS INT) AS part, o AS "offset", CAST(len AS BIGINT) AS length,
           {_MINUTES.format('a')} || '~' || {_MINUTES.format('b')} || CASE WHEN len(inside) > 0 THEN ' (covers TL: ' || array_to_string(list_transform(inside, lambda x: {_MINUTES.format('x')}), ', ') || ')' ELSE '' END AS label FROM c""")
def timeline_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five evenly spaced reads of each track of fifty minutes, with the points of its timeline."""
    tracks = _sizes(spark, sf_dir).withColumns({"points": F.array(*(F.lit(x) for x in (0.0, 450.5, 1300.0, 2999.0))), "total_sec": F.lit(3000.0)})
    return reading_plans.timeline_reads(tracks).select("doc_id", "part", "offset", "length", "label")


#: Small tables for a chain of three steps: phrases over characters, then words of what came out, then variants.
_SCRIPT = {
    "phrases_st": [("ing", "i7"), ("th", "þ"), ("e", "no")],
    "characters_st": [("n", "η"), ("g", "γ"), ("t", "τ"), ("h", "θ")],
    "phrases_tw": [("no", "ν"), ("η", "nn"), ("τθ", "tt")],
    "variants_tw": [("þ", "th"), ("7", "ng")],
}


@_query("""WITH a AS (SELECT doc_id, text, replace(replace(replace(text, 'ing', chr(57344)), 'th', chr(57345)), 'e', chr(57346)) AS t FROM documents),
    b AS (SELECT doc_id, text, replace(replace(replace(translate(t, 'ngth', 'ηγτθ'), chr(57344), 'i7'), chr(57345), 'þ'), chr(57346), 'no') AS t FROM a),
    c AS (SELECT doc_id, text, replace(replace(replace(t, 'no', 'ν'), 'η', 'nn'), 'τθ', 'tt') AS t FROM b),
    d AS (SELECT doc_id, text, replace(replace(t, 'þ', 'th'), '7', 'ng') AS t FROM c)
    SELECT doc_id, t AS text, CAST(list_sum(list_transform(list_zip(string_split(text, ''), string_split(t, '')), lambda z: CASE WHEN z[1] IS NOT NULL AND z[2] IS NOT NULL AND z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS changed_chars FROM d""")
def converted_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through a chain of three steps of mapping tables, and how many characters it changed."""
    named = {n: spark.createDataFrame(rows, "source string, target string") for n, rows in _SCRIPT.items()}
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scripts.convert_script(docs, scripts.chain(named, "s2twp"), "s2twp")


@_query()
def inner_repeats_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats within whole documents; SQL that recurs over words is too slow on long texts, so tests hold it against brute force."""
    return read(spark, sf_dir, "documents").select("doc_id", unescape.drop_inner_repeats("text").alias("text"))
