"""Further named queries: chained clean-ups, rankings, samples, ranges, headings and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, captions, checks, replies
from ..operators import sequences as S
from .catalogue import _HOURS, _ORDER, _RUNS, _hours, _query
from .tables import CUES, LINES, cues, lines, read


@_query(f"""{_RUNS}, k AS (SELECT doc_id, pos, line FROM n WHERE size < 3 OR place = 1), l AS (SELECT * FROM k WHERE length(line) <= 400),
    s AS (SELECT *, length(trim(line)) <= 30 AS short FROM l),
    d AS (SELECT *, CASE WHEN short IS DISTINCT FROM lag(short) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS d FROM s),
    e AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY pos) AS streak FROM d),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, streak) AS z, row_number() OVER (PARTITION BY doc_id, streak ORDER BY pos) AS y FROM e)
    SELECT doc_id, pos, line FROM f WHERE NOT short OR z < 3 OR y = 1""")
def chained_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean_hallucinations(lines(spark, sf_dir), ["doc_id"], ["pos"], "line", drop_long=F.length("line") > 400, strict=True, most_chars=30, streak=3)


@_query(f"""WITH {CUES}, {_HOURS}, v AS (SELECT *, event_id % 9 < 2 AS blank, CASE WHEN event_id % 50 = 7 THEN start_ms - 1000 ELSE end_ms END AS e FROM cues),
    j AS (SELECT track_id, lag(e) OVER (PARTITION BY track_id ORDER BY start_ms, event_id) AS gap_start, start_ms AS gap_end FROM v),
    c AS (SELECT *, CASE WHEN blank IS DISTINCT FROM lag(blank) OVER (PARTITION BY track_id ORDER BY start_ms, event_id) THEN 1 ELSE 0 END AS c FROM v),
    b AS (SELECT *, sum(c) OVER (PARTITION BY track_id ORDER BY start_ms, event_id) AS run FROM c),
    g AS (SELECT track_id, gap_start, gap_end, 'time jump' AS reason FROM j WHERE gap_end - gap_start > 1800000
          UNION ALL SELECT track_id, start_ms, e, 'repeated character' FROM v WHERE NOT blank AND regexp_matches(text, 'rr|00|11|22|33|44|55|66|77|88|99')
          UNION ALL SELECT track_id, arg_min(start_ms, (start_ms, event_id)), arg_max(e, (start_ms, event_id)), 'blank block' FROM b WHERE blank GROUP BY track_id, run HAVING count(*) >= 2
          UNION ALL SELECT h.track_id, win_start, win_end, 'low density' FROM hours h LEFT JOIN cues c ON c.track_id = h.track_id AND c.start_ms >= win_start AND c.start_ms < win_end GROUP BY ALL HAVING count(c.event_id) < 3),
    m AS (SELECT *, max(gap_end) OVER (PARTITION BY track_id ORDER BY gap_start, gap_end, reason ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR gap_start > reach + 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY gap_start, gap_end, reason ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT track_id, min(gap_start) AS gap_start, max(gap_end) AS gap_end, count(*) AS n_merged, string_agg(reason, ';' ORDER BY gap_start, gap_end, reason) AS reasons FROM i GROUP BY track_id, island""")
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four detectors on cues of which some are blank and some end before they start."""
    event = F.col("event_id")
    every = cues(spark, sf_dir).withColumns({"text": F.when(event % 9 < 2, " ").otherwise(F.col("text")), "end_ms": F.when(event % 50 == 7, F.col("start_ms") - 1000).otherwise(F.col("end_ms"))})
    by = ["track_id"]
    # of the event types' letters only the r of "error" comes twice in a row, and any digit may
    detected = [S.time_jumps(every, by, _ORDER, 1_800_000), S.repeated_characters(every, by, "text", 2), S.blank_blocks(every, by, _ORDER, "text"), align.density_gaps(_hours(spark, sf_dir), every, by, 0.05)]
    return S.gap_report(detected, by).withColumn("reasons", F.array_join("reasons", ";"))


@_query("""SELECT l_suppkey % 7 AS track, l_linenumber AS batch_num, l_orderkey, CAST(row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_linenumber, l_orderkey) AS INTEGER) AS pos FROM lineitem""")
def batches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("track"), F.col("l_linenumber").alias("batch_num"), "l_orderkey")
    return S.concat_batches(rows, ["track"], "batch_num", ["l_orderkey"])


_LOSSES = f"""WITH {CUES}, b AS (SELECT track_id, start_ms // 3600000 % 24 AS batch_num, event_type, user_id FROM cues),
    n AS (SELECT track_id, batch_num, count(*) AS n_source, count(*) FILTER (user_id % 3 <> 0) AS n_target FROM b GROUP BY ALL)
    SELECT track_id, batch_num, n_source, n_target, n_source - n_target AS lost FROM n WHERE n_source > n_target"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the hours, those that lost everything among them, the greatest first."""
    rows = cues(spark, sf_dir).withColumn("batch_num", F.floor(F.col("start_ms") / 3_600_000) % 24)
    losses = checks.batch_losses(rows, rows.where("user_id % 3 <> 0"), ["track_id"])
    return checks.loss_ranking(losses, ["track_id"]).select("track_id", "batch_num", "n_source", "n_target", "lost")


@_query(_LOSSES)
def loss_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@_query(f"{_LOSSES} ORDER BY lost DESC, track_id, batch_num LIMIT 10")
def greatest_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of the ranking, a report."""
    return _ranked(spark, sf_dir).limit(10)


@_query(f"""WITH {CUES}, n AS (SELECT track_id, event_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, event_id) AS a, count(*) OVER (PARTITION BY track_id) AS z FROM cues)
    SELECT track_id, event_id FROM n WHERE a <= 3 OR a > z - 3""")
def end_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.end_samples(cues(spark, sf_dir), ["track_id"], _ORDER).select("track_id", "event_id")


@_query(f"WITH {LINES} SELECT doc_id, pos, line, pos IN (1, 4) AS listed FROM lines WHERE pos BETWEEN 1 AND 4")
def chapter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lines(spark, sf_dir)
    listed = S.in_range(every, "pos", only=[1, 4]).select("doc_id", "pos", F.lit(True).alias("l"))
    return S.in_range(every, "pos", 1, 4).join(listed, ["doc_id", "pos"], "left").select("doc_id", "pos", "line", F.coalesce("l", F.lit(False)).alias("listed"))


@_query(rf"""WITH {LINES}, t AS (SELECT doc_id, replace(string_agg(replace(line, chr(1), ' '), chr(1) ORDER BY pos), 'of the', 'OF THE') AS t FROM lines GROUP BY doc_id),
    r AS (SELECT doc_id, replace(regexp_replace(t, 'of([ \t\n\f\r\v\x01]+)the', 'OF\1THE', 'g'), 'ing', 'yng') AS t FROM t)
    SELECT doc_id, generate_subscripts(string_split(t, chr(1)), 1) - 1 AS pos, unnest(string_split(t, chr(1))) AS line FROM r""")
def replace_over_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("line", F.replace("line", F.lit("\x01"), F.lit(" ")))
    return captions.replace_over_ends(rows, ["doc_id"], ["pos"], [("of the", "OF THE"), ("ing", "yng")], "line")


@_query(f"""WITH {CUES}, h AS (SELECT DISTINCT track_id, start_ms // 3600000 * 3600000 AS first, start_ms // 3600000 * 3600000 + 3599999 AS last FROM cues)
    SELECT h.track_id, first, last, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY start_ms, CAST(event_id AS VARCHAR)) AS labels FROM h JOIN cues c ON c.track_id = h.track_id AND start_ms BETWEEN first AND last GROUP BY ALL""")
def coverage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cues(spark, sf_dir)
    hour = F.floor(F.col("start_ms") / 3_600_000) * 3_600_000
    ranges = every.select("track_id", hour.alias("first"), (hour + 3_599_999).alias("last")).distinct()
    points = every.select("track_id", F.col("start_ms").alias("at"), F.col("event_id").cast("string").alias("label"))
    return align.coverage_labels(ranges, points, ["track_id"], 600_000)


@_query("""SELECT doc_id, 'Ch' AS kind, CAST(doc_id AS INTEGER) AS number, lang AS title, '# Ch' || doc_id || '： ' || lang || chr(10) || source || ' body' || chr(10) || '---' AS body FROM documents""")
def reply_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies are rendered from documents; their fences, prefaces and ends go and their headings are read."""
    docs = read(spark, sf_dir, "documents")
    reply = F.concat(F.lit("```text\npreface "), "source", F.lit("\n# Ch"), F.col("doc_id").cast("string"), F.lit("： "), "lang", F.lit("\n"), "source", F.lit(" body\n---\n```\nend"))
    body = T.until_last(T.from_first_heading(T.without_fences(reply)), "---")
    key = T.heading_key(F.substring_index(body, "\n", 1))
    return docs.select("doc_id", key["kind"].alias("kind"), key["number"].alias("number"), key["title"].alias("title"), body.alias("body"))


@_query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'zh batch_' || turn || '.srt' WHEN turn % 3 = 1 THEN 'zh all' ELSE 'notes gap_' || turn || '.srt' END AS prompt, text FROM conversations)
    SELECT conv_id, turn, CASE WHEN NOT contains(prompt, 'zh') THEN 'other job' WHEN turn % 3 = 1 THEN 'no batch number' WHEN length(coalesce(text, '')) < 100 THEN 'too short' END AS skip_reason, CASE WHEN turn % 3 <> 1 THEN CAST(turn AS INTEGER) END AS batch_num FROM t""")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    prompt = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("zh batch_"), turn, F.lit(".srt"))).when(F.col("turn") % 3 == 1, "zh all").otherwise(F.concat(F.lit("notes gap_"), turn, F.lit(".srt")))
    return replies.task_filter(read(spark, sf_dir, "conversations").withColumn("prompt", prompt), "prompt", "zh", "text", 100).select("conv_id", "turn", "skip_reason", "batch_num")


@_query("SELECT doc_id - (SELECT min(doc_id) FROM documents) AS doc_id, source FROM documents")
def rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.rekey(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source")


@_query("""WITH s AS (SELECT conv_id, turn, role FROM conversations)
    SELECT conv_id, turn, turn + 10000 AS number, '# Seg' || turn || ': x' || chr(10) || role AS section FROM s UNION ALL SELECT conv_id, turn, turn, '# Ch' || turn || ': y' || chr(10) FROM s""")
def reply_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections for each turn, cut apart at their headings."""
    turn = F.col("turn").cast("string")
    reply = F.concat(F.lit("intro\n# Ch"), turn, F.lit(": y\n# Seg"), turn, F.lit(": x\n"), "role")
    return replies.split_sections(read(spark, sf_dir, "conversations").withColumn("reply", reply), "reply").select("conv_id", "turn", "number", "section")
