"""Queries over one track that holds a whole table: scans and folds in pieces, and intervals of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, captions
from ..operators import sequences as S
from .catalogue import _query
from .tables import CUES, LINES, cues, lines, read

#: All lines of all documents in one order; documents are the chunks.
_ONE = "o AS (SELECT doc_id * 100000 + pos AS place, line FROM lines)"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("pos")).alias("place"), "line", F.floor(F.col("doc_id") / 20).alias("part"))


@_query(f"""WITH {LINES}, {_ONE}, c AS (SELECT *, CASE WHEN lag(place) OVER w IS NULL OR line IS DISTINCT FROM lag(line) OVER w THEN 1 ELSE 0 END AS c FROM o WINDOW w AS (ORDER BY place)),
    r AS (SELECT *, sum(c) OVER (ORDER BY place) AS run FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY run) AS size FROM r)
    SELECT place, line, c = 1 AS first FROM n WHERE c = 1 OR size < 3""")
def one_track_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over the ends of documents are collapsed, and of what is left each line is compared with the one before it."""
    kept = S.collapse_runs(_one(spark, sf_dir), [], ["place"], "line", chunk=F.col("part"))
    return S.mark_changes(kept, [], ["place"], "line", "first", F.col("part")).select("place", "line", "first")


@_query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(q) OVER w - q AS BIGINT) AS offset_ms, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS INT) AS section, CAST(row_number() OVER w AS INT) AS pos
    FROM l WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def one_track_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as the segments of one recording: offsets, sections and numbers."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("duration_ms"), "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    order, chunk = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.floor(F.col("l_orderkey") / 1000)
    placed = S.segment_offsets(rows, [], order, chunk=chunk)
    cut = S.sections(placed, [], order, F.col("l_returnflag") == "R", chunk)
    return S.concat_batches(cut, [], "l_orderkey", order[1:], chunk).select("l_orderkey", "l_linenumber", "l_partkey", "offset_ms", "section", "pos")


@_query(f"""WITH {CUES}, m AS (SELECT *, max(end_ms) OVER (ORDER BY start_ms, end_ms, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cues),
    i AS (SELECT *, sum(CASE WHEN start_ms > reach + 5000 THEN 1 ELSE 0 END) OVER (ORDER BY start_ms, end_ms, text ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged FROM i GROUP BY island""")
def one_track_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events on one clock, merged where they come within five seconds."""
    every = cues(spark, sf_dir).select("start_ms", "end_ms", "text")
    return S.merge_intervals(every, [], "start_ms", "end_ms", 5000, "text", F.floor(F.col("start_ms") / 3_600_000)).select("start_ms", "end_ms", "n_merged")


@_query(f"""WITH RECURSIVE {LINES}, {_ONE}, n AS (SELECT row_number() OVER (ORDER BY place) AS i, line AS text FROM o),
    b AS (SELECT i, text, lag(text, 1) OVER w AS a1, lag(text, 2) OVER w AS a2, lag(text, 3) OVER w AS a3, lag(text, 4) OVER w AS a4 FROM n WINDOW w AS (ORDER BY i)),
    p AS (SELECT i, text, sum(CASE WHEN i = 1 OR NOT (contains(text, a1) OR contains(a1, text) OR coalesce(contains(text, a2) OR contains(a2, text), false)
                 OR coalesce(contains(text, a3) OR contains(a3, text), false) OR coalesce(contains(text, a4) OR contains(a4, text), false)) THEN 1 ELSE 0 END) OVER (ORDER BY i) AS piece FROM b),
    t AS (SELECT piece, row_number() OVER (PARTITION BY piece ORDER BY i) AS k, i, text FROM p),
    f AS (
        SELECT piece, k, text AS held, i AS spot, CAST(0 AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS out, CAST(NULL AS VARCHAR) AS said FROM t WHERE k = 1
        UNION ALL
        SELECT f.piece, t.k, CASE WHEN f.seen < 3 AND contains(t.text, f.held) THEN t.text WHEN f.seen < 3 AND contains(f.held, t.text) THEN f.held ELSE t.text END,
               CASE WHEN f.seen < 3 AND contains(t.text, f.held) THEN t.i WHEN f.seen < 3 AND contains(f.held, t.text) THEN f.spot ELSE t.i END,
               CASE WHEN f.seen < 3 AND (contains(t.text, f.held) OR contains(f.held, t.text)) THEN f.seen + 1 ELSE 0 END,
               CASE WHEN NOT (f.seen < 3 AND (contains(t.text, f.held) OR contains(f.held, t.text))) THEN f.spot END,
               CASE WHEN NOT (f.seen < 3 AND (contains(t.text, f.held) OR contains(f.held, t.text))) THEN f.held END
        FROM f JOIN t ON t.piece = f.piece AND t.k = f.k + 1),
    r AS (SELECT out AS i, said AS text FROM f WHERE out IS NOT NULL UNION ALL SELECT arg_max(spot, k), arg_max(held, k) FROM f GROUP BY piece)
    SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS pos, text FROM r""")
def one_track_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progressive collapse over all lines as one track, folded in pieces."""
    rows = _one(spark, sf_dir).select("place", "part", F.col("place").alias("start_ms"), (F.col("place") + 1).alias("end_ms"), F.col("line").alias("text"))
    return captions.collapse_progressive(rows, [], ["place"], chunk=F.col("part")).select("pos", "text")


@_query(f"""WITH {CUES}, s AS (SELECT min(start_ms) AS lo, max(start_ms) AS hi FROM cues),
    w AS (SELECT n, lo + n * 7000000 AS win_start, greatest(lo + n * 7000000, hi - n * 11000000) AS win_end FROM s, range(60) t(n))
    SELECT w.n AS window_no, count(c.event_id) AS n FROM w LEFT JOIN cues c ON c.start_ms >= win_start AND c.start_ms < win_end GROUP BY w.n""")
def nested_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty nested windows, the longest over the whole table: each takes some dozens of dyadic bins."""
    every = cues(spark, sf_dir).select(F.lit(0).alias("clock"), "start_ms")
    span = every.groupBy("clock").agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    start = F.col("lo") + F.col("n") * 7_000_000
    windows = span.select("clock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("n"), "lo", "hi").select("clock", F.col("n").alias("window_no"), start.alias("win_start"), F.greatest(start, F.col("hi") - F.col("n") * 11_000_000).alias("win_end"))
    return align.window_counts(windows, every, ["clock"], 60_000).select("window_no", "n")
