"""Checks between and within tracks: counts, verdicts, lost terms, quotations, drift."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, count_literal


def entry_counts(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """A subtitle text's entries by five definitions."""
    lines = F.split(F.col(text), "\n")
    count = lambda p: F.size(F.filter(lines, p))
    blocks = F.filter(F.split(F.col(text), r"\n\s*\n"), lambda b: F.contains(b, F.lit("-->")))
    following = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.coalesce(a.rlike(r"^\d+\s*$") & F.contains(b, F.lit("-->")), F.lit(False)))
    return df.select(*by, count_literal(F.col(text), "-->").alias("arrows"), F.size(blocks).alias("blocks"), F.size(F.filter(following, lambda x: x)).alias("numbered"), count(lambda x: F.trim(x).rlike(r"^\d+$") & (F.trim(x) != "0")).alias("numbers"), F.floor(F.size(lines) / 4).alias("by_lines"))


def batch_losses(source: DataFrame, target: DataFrame, by: list[str], batch: str = "batch_num") -> DataFrame:
    """Records of each batch that the target lacks; a batch without a source has -1."""
    count = lambda df, name: df.groupBy(*by, batch).agg(F.count("*").alias(name))
    both = count(target, "n_target").join(count(source, "n_source"), [*by, batch], "full")
    return both.withColumns({"n_source": F.coalesce("n_source", F.lit(-1)), "n_target": F.coalesce("n_target", F.lit(0))}).withColumn("lost", F.when(F.col("n_source") >= 0, F.col("n_source") - F.col("n_target")))


def loss_ranking(losses: DataFrame, by: list[str], batch: str = "batch_num") -> DataFrame:
    """The batches that lost records, the greatest loss first."""
    return losses.where("lost > 0").orderBy(F.col("lost").desc(), *by, batch)


def verdict(source: Column, target: Column, tolerance: int = 5) -> Column:
    """``equal``, ``tolerable`` or ``fail`` for two counts."""
    return F.when(source == target, "equal").when((source > 0) & (F.abs(source - target) <= tolerance), "tolerable").otherwise("fail")


def pattern_counts(df: DataFrame, pairs: DataFrame, text: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """How often each pattern (``wrong``) of a dictionary occurs in all texts, from left to right without overlaps.

    The patterns are dealt into chunks of some ``chunk_bytes``; the texts are
    read once for each chunk, against an automaton of its patterns, and a task
    adds up its counts.  An empty pattern counts 0.
    """
    import pyarrow as pa

    listed = pairs.select(F.col("ord").cast("long").alias("ord"), "wrong").where("wrong <> ''")
    number = max(1, -(-(listed.agg(F.sum(F.octet_length("wrong"))).first()[0] or 0) // chunk_bytes))
    counted = None
    for k in range(number):
        rows = [(x["ord"], x["wrong"]) for x in listed.where(F.pmod(F.xxhash64("wrong"), F.lit(number)) == k).collect()]
        if not rows:
            continue
        shared = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared, name=uuid4().hex):
            own, tally = _automaton(name, shared.value), {}
            size = {o: len(w) for o, w in shared.value}
            for batch in batches:
                for one in batch.column(0).to_pylist():
                    free: dict = {}  # where the next occurrence may begin
                    for end, found in own.iter(one or ""):
                        for o in found:
                            if end - size[o] + 1 >= free.get(o, 0):
                                free[o] = end + 1
                                tally[o] = tally.get(o, 0) + 1
            yield pa.record_batch([pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], names=["ord", "n"])

        part = df.select(F.col(text)).mapInArrow(run, "ord long, n long")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return pairs.select("ord", "wrong", F.lit(0).cast("long").alias("n"))
    counted = counted.groupBy("ord").agg(F.sum("n").alias("n"))
    return pairs.select("ord", "wrong").join(counted, "ord", "left").select("ord", "wrong", F.coalesce("n", F.lit(0)).alias("n"))


def scan_patterns(df: DataFrame, pairs: DataFrame, risky: DataFrame, text: str = "text") -> DataFrame:
    """(risky, ord, wrong, correct, n, note) of the patterns that occur, the risky ones (which have a note) apart: those are to be verified, never applied."""
    every = pairs.select("ord", "wrong", "correct", F.lit(None).cast("string").alias("note"), F.lit(False).alias("risky"))
    every = every.unionByName(risky.select("ord", "wrong", "correct", "note", F.lit(True).alias("risky")))
    keyed = every.withColumn("_key", F.col("ord") * 2 + F.col("risky").cast("int"))
    counts = pattern_counts(df, keyed.select(F.col("_key").alias("ord"), "wrong"), text).where("n > 0")
    return keyed.join(counts.select(F.col("ord").alias("_key"), "n"), "_key").select("risky", "ord", "wrong", "correct", "n", "note")


def pair_spec(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One ``spec`` of the patterns that may be applied, such as ``a=b,c=d``, in their order."""
    pair = F.concat("wrong", F.lit("="), "correct")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", pair.alias("p")))), lambda x: x["p"])
    return found.where("not risky").groupBy(*(by or [])).agg(F.array_join(ordered, ",").alias("spec"))


def unmatched_pairs(counts: DataFrame) -> DataFrame:
    """Patterns that no text holds."""
    return counts.where("n = 0").select("ord", "wrong")


def restoration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per pattern the share of occurrences that are gone, and whether some leaked."""
    both = before.withColumnRenamed("n", "n_before").join(after.select("ord", F.col("n").alias("n_after")), "ord", "left")
    left = F.coalesce("n_after", F.lit(0))
    return both.select("ord", "wrong", "n_before", left.alias("n_after"), F.when(F.col("n_before") > 0, 1 - left / F.col("n_before")).alias("restored"), (left > 0).alias("leaked"))


#: A capitalised word; letters, marks and digits of any script and underscores bound none, whatever an engine takes for a boundary.
TERM = r"(?<![\p{L}\p{M}\p{N}_])[A-Z][a-zA-Z]{3,}(?![\p{L}\p{M}\p{N}_])"


def term_candidates(df: DataFrame, title: str, description: str, stopwords: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Capitalised words: all of the title, those of the description that occur twice, and the user's."""
    found = lambda c: F.explode(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TERM), F.lit(0))).alias("term")
    titled = df.select(found(title))
    often = df.select(found(description)).groupBy("term").count().where("count >= 2").select("term")
    out = titled.union(often).join(stopwords.select("term"), "term", "left_anti")
    return (out.union(extra.select("term")) if extra is not None else out).distinct()


def lost_terms(terms: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """Terms (term, n_source, n_target, n_singular) that the target lost.

    A plural that the target lacks is counted by its singular, if that occurs.
    """
    plural = F.col("term").endswith("s") & (F.length("term") > 3) & (F.col("n_target") == 0) & (F.coalesce("n_singular", F.lit(0)) > 0)
    counted = F.when(plural, F.col("n_singular")).otherwise(F.col("n_target"))
    return terms.withColumn("n_counted", counted).where((F.col("n_source") >= least) & (F.col("n_counted") < share * F.col("n_source")))


#: The automaton that a worker used last, by the name of its chunk.
_AUTOMATON: dict = {}


def _automaton(name: str, rows: list):
    import ahocorasick

    if name not in _AUTOMATON:
        _AUTOMATON.clear()
        own = ahocorasick.Automaton()
        for quote, text in rows:
            own.add_word(text, (*own.get(text, ()), quote))
        own.make_automaton()
        _AUTOMATON[name] = own
    return _AUTOMATON[name]


def found_quotes(quotes: DataFrame, sources: DataFrame, text: str = "text", casefold: bool = False, chunk_bytes: int = 4 << 20) -> DataFrame:
    """quote_id and number of sources that hold the quote word for word, white space aside.

    The quotes are dealt into chunks of some ``chunk_bytes``, the texts of an id
    into one chunk.  The sources are read once for each chunk, against an
    automaton of its quotes; sources are never paired with quotes.
    """
    import pyarrow as pa

    named = quotes.select("quote_id", comparable(F.col(text), casefold).alias("q")).where("q <> ''")
    number = max(1, -(-(named.agg(F.sum(F.octet_length("q"))).first()[0] or 0) // chunk_bytes))
    normal = sources.select(comparable(F.col(text), casefold).alias("t"))
    out = None
    for k in range(number):
        rows = [(x["quote_id"], x["q"]) for x in named.where(F.pmod(F.xxhash64("quote_id"), F.lit(number)) == k).collect()]
        if not rows:
            continue
        shared = sources.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared, name=uuid4().hex):
            own, tally = _automaton(name, shared.value), {}
            for batch in batches:
                for source in batch.column(0).to_pylist():
                    for quote in {q for _, ids in own.iter(source or "") for q in ids}:
                        tally[quote] = tally.get(quote, 0) + 1
            yield pa.record_batch([pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], names=["quote_id", "n"])

        found = normal.mapInArrow(run, "quote_id long, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return quotes.select("quote_id", F.lit(0).cast("long").alias("n_sources")).limit(0)
    return out.groupBy("quote_id").agg(F.sum("n").alias("n_sources"))


def verify_quotes(quotes: DataFrame, sources: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Quotes that some source holds, and those that none holds."""
    found = found_quotes(quotes, sources, **options).select("quote_id")
    return quotes.join(found, "quote_id", "left_semi"), quotes.join(found, "quote_id", "left_anti")


def tail_drift(pairs: DataFrame, by: list[str], pos: str = "pos", tail: int = 5, most: int = 60, calm: int = 5) -> DataFrame:
    """Where the end of a translated track drifts from its source.

    ``pairs`` has source and target texts by position.  A record is abnormal if
    its target has over 1.2 or under 0.1 times the source's characters (an empty
    source is normal).  If one of the last ``tail`` records is abnormal, the
    records before them are walked back, ``most`` from the end at the farthest,
    until ``calm`` in a row are normal: the drift begins two places after the
    last of these, counted from zero.  Without such a stretch it begins at the
    first abnormal record on the way.
    """
    ratio = F.length(F.coalesce("target", F.lit(""))) / F.length("source")
    odd = F.coalesce((F.length("source") > 0) & ((ratio > 1.2) | (ratio < 0.1)), F.lit(False))
    every = Window.partitionBy(*by)
    back = Window.partitionBy(*by).orderBy(F.desc(pos))
    rows = pairs.withColumns({"_odd": odd, "_back": F.row_number().over(back), "_n": F.count("*").over(every)}).where(F.col("_back") <= most)
    stretch = F.sum(F.when(F.col("_odd"), 0).otherwise(1)).over(back.rowsBetween(-(calm - 1), 0))
    rows = rows.withColumn("_calm", (stretch == calm) & (F.col("_back") >= calm))
    found = rows.groupBy(*by).agg(
        F.max("_n").alias("total"),
        F.count_if(F.col("_odd") & (F.col("_back") <= tail)).alias("_flagged"),
        F.min(F.when(F.col("_calm") & (F.col("_back") >= tail + calm), F.col("_back"))).alias("_at"),
        F.max(F.when(F.col("_odd"), F.col("_back"))).alias("_odd_back"),
    )
    # a stretch ends (walking back) at its calm-th record, whose index from zero is total - _at
    begin = F.when(F.col("_at").isNotNull(), F.col("total") - F.col("_at") + 2).otherwise(F.col("total") - F.col("_odd_back") + 1)
    return found.withColumn("drift_start", F.when(F.col("_flagged") > 0, begin)).select(*by, "total", "drift_start", F.coalesce(F.col("total") - F.col("drift_start") + 1, F.lit(0)).alias("drift_range"))


def track_drift(source: DataFrame, target: DataFrame, by: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """``drift_range`` of two tracks: the difference of their numbers of records, or else that of :func:`tail_drift`."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    sizes = count(source, "n_source").join(count(target, "n_target"), by, "full").fillna(0, ["n_source", "n_target"])
    other = sizes.where("n_source <> n_target").select(*by, F.abs(F.col("n_source") - F.col("n_target")).alias("drift_range"))
    equal = sizes.where("n_source = n_target").select(*by)
    both = source.select(*by, pos, F.col(text).alias("source")).join(target.select(*by, pos, F.col(text).alias("target")), [*by, pos]).join(equal, by, "left_semi")
    return other.unionByName(tail_drift(both, by, pos).select(*by, "drift_range"))


def enough_items(df: DataFrame, by: list[str], qualifies: Column, least: int = 2) -> DataFrame:
    """Sections with at least ``least`` items that qualify; the others are left out."""
    return df.groupBy(*by).agg(F.count_if(qualifies).alias("n")).where(F.col("n") >= least)


def removed_alarm(lines_in: Column, lines_out: Column, share: float = 0.3) -> Column:
    """Whether at least ``share`` of the lines was removed."""
    return F.when(lines_in > 0, (lines_in - lines_out) / lines_in >= share).otherwise(F.lit(False))


def silent_share(df: DataFrame, by: list[str], samples: str = "samples", level: float = 500.0) -> DataFrame:
    """Share of seconds whose root mean square is below ``level``, and the threshold that follows from it."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rms = F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples))).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.avg((rms < level).cast("double")).alias("silent")).withColumn("threshold", F.when(F.col("silent") > 0.3, 2.0).otherwise(1.0))


def stuck_head(df: DataFrame, by: list[str], text: str = "text", most_chars: int = 3, share: float = 0.5) -> DataFrame:
    """Whether the most frequent length of a track's lines is short and held by over half of them."""
    sizes = df.groupBy(*by, F.length(text).alias("_size")).agg(F.count("*").alias("_n"))
    top = sizes.groupBy(*by).agg(F.max_by("_size", F.struct(F.col("_n"), -F.col("_size"))).alias("top_length"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return top.select(*by, "top_length", ((F.col("top_length") <= most_chars) & (F.col("_most") / F.col("_all") > share)).alias("stuck"))


def config_errors(chapters: DataFrame, by: list[str], required: list[str], number: str = "num") -> DataFrame:
    """Errors of each configuration row: missing fields and numbers that occur twice."""
    w = Window.partitionBy(*by, number)
    missing = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in required]
    twice = F.when(F.count("*").over(w) > 1, F.concat(F.lit("duplicate number "), F.col(number).cast("string")))
    return chapters.withColumn("_twice", twice).withColumn("errors", F.array_compact(F.array(*missing, "_twice"))).drop("_twice")
