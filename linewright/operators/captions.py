"""Cleaning of growing captions: collapse, repeats, overlaps and sentences.

The folds that depend on what was emitted before run over pieces of a track, cut at
safe breaks (:mod:`.folds`); with ``chunk``, which never falls along the order, the
pieces themselves are numbered without holding a track in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unescape import drop_inner_repeats, rest_after_overlap
from .folds import Cue, fold, pieces
from .scans import lagged, scanned
from .sequences import drop_adjacent_repeats


class _Growing:
    """The caption held, and how many were looked at since its anchor."""

    def __init__(self, look_ahead: int) -> None:
        self.look_ahead = look_ahead

    def begin(self, carry: int | None) -> None:
        self.held: Cue | None = None
        self.seen = 0

    def take(self, start: int | None, end: int | None, text: str | None) -> Iterable[Cue]:
        held = self.held
        if held is not None and self.seen < self.look_ahead and held[2] is not None and text is not None:
            if held[2] in text:
                self.held, self.seen = (start, end, text), self.seen + 1
                return ()
            if text in held[2]:
                self.seen += 1
                return ()
        self.held, self.seen = (start, end, text), 0
        return () if held is None else (held,)

    def finish(self) -> Iterable[Cue]:
        return () if self.held is None else (self.held,)


def _lags(df: DataFrame, by: list[str], order: list[str], n: int, chunk: Column | None) -> tuple[DataFrame, list[str]]:
    """``df`` with the texts of the ``n`` records before each one, the nearest first."""
    names = [f"_lag{i}" for i in range(1, n + 1)]
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({c: F.lag("text", i).over(w) for i, c in enumerate(names, 1)}), names
    return lagged(df, by, order, chunk, F.col("text"), names), names


def collapse_progressive(df: DataFrame, by: list[str], order: list[str], look_ahead: int = 3, chunk: Column | None = None) -> DataFrame:
    """A caption that the next one contains gives way to it, stamps included.

    From each anchor at most ``look_ahead`` captions are looked at; one that the
    current caption contains is skipped; any other ends the search.  A caption that
    neither contains nor is contained in any of the ``look_ahead + 1`` before it
    begins anew whatever was held, so the track is cut there.  Null texts contain
    nothing.
    """
    rows, names = _lags(df, by, order, look_ahead + 1, chunk)
    met = [F.coalesce(F.contains(F.col("text"), F.col(c)) | F.contains(F.col(c), F.col("text")), F.lit(False)) for c in names]
    free = ~met[0]
    for m in met[1:]:
        free = free & ~m
    cut = pieces(rows.withColumn("_free", free).drop(*names), by, order, F.col("_free"), chunk)
    return fold(cut, by, order, lambda: _Growing(look_ahead), chunk=chunk)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trim_overlaps(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The longest end of the previous full text that begins a text is cut from it; emptied records go.

    A track that this would empty stays as it is.
    """
    before = F.lag("text").over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("_before", before).withColumn("_rest", rest_after_overlap("_before", "text"))
    any_left = F.max(F.col("_rest") != "").over(Window.partitionBy(*by))
    rows = rows.withColumn("_any", any_left).where(~F.col("_any") | (F.col("_rest") != ""))
    return rows.withColumn("text", F.when(F.col("_any"), F.col("_rest")).otherwise(F.col("text"))).drop("_before", "_rest", "_any")


#: When a sentence segment ends (milliseconds and words).
SENTENCE_MS, CLAUSE_MS, LONG_MS, WORDY_MS, WORDY, MOST_WORDS = 2000, 3500, 6000, 4000, 12, 25
_ENDS, _CLAUSE = r"""[.!?]["'’”)\]]?$""", r"[,;:–—-]$"
#: The same for Python, whose ``$`` knows one kind of line end.
_LINE_END = "(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z"
_ENDS_RE, _CLAUSE_RE = re.compile(_ENDS[:-1] + _LINE_END), re.compile(_CLAUSE[:-1] + _LINE_END)
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


class _Sentence:
    """The segment that is open: where it starts, its last end, its text and number of words."""

    def begin(self, carry: int | None) -> None:
        self.start, self.end, self.text, self.n = carry, None, "", 0

    def take(self, start: int | None, end: int | None, text: str | None) -> Iterable[Cue]:
        if self.text == "":
            self.text, self.n = text, 0
        elif text is not None:
            self.text = text if self.text is None else f"{self.text} {text}"
        if text is not None:
            self.n += sum(w != "" for w in _BLANKS.split(text))
        self.start = start if self.start is None else self.start
        self.end = end
        length = end - self.start if end is not None and self.start is not None else -1
        said = self.text is not None
        full = length >= LONG_MS or said and (length >= SENTENCE_MS and _ENDS_RE.search(self.text) or length >= CLAUSE_MS and _CLAUSE_RE.search(self.text) or length >= WORDY_MS and self.n >= WORDY or self.n >= MOST_WORDS)
        if not full:
            return ()
        out = (self.start, end, self.text)
        self.begin(end)
        return (out,)

    def finish(self) -> Iterable[Cue]:
        return () if self.text == "" else ((self.start, self.end, self.text),)


def sentence_segments(df: DataFrame, by: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """Records joined until a sentence, clause, time or word limit; the next segment starts where the last ended.

    A segment starts no later than the furthest time before its last record, or
    that record's own start.  A record that is long enough beyond that to close any
    segment closes the one that is open, whatever it holds, so the track is cut
    after it.
    """
    far = F.greatest("start_ms", "end_ms")
    if chunk is not None:
        rows = scanned(df, by, order, chunk, maxima={"_reach": far})
    else:
        rows = df.withColumn("_reach", F.max(far).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    own, n = F.col("end_ms") - F.greatest("_reach", "start_ms"), F.size(words_of(F.col("text")))
    closes = (own >= LONG_MS) | ((own >= SENTENCE_MS) & F.col("text").rlike(_ENDS)) | ((own >= CLAUSE_MS) & F.col("text").rlike(_CLAUSE)) | ((own >= WORDY_MS) & (n >= WORDY)) | (n >= MOST_WORDS)
    rows = rows.withColumn("_closes", F.coalesce(closes & F.col("text").isNotNull() & F.col("start_ms").isNotNull(), F.lit(False)))
    if chunk is not None:
        rows = scanned(rows, by, order, chunk, previous={"_closed": F.col("_closes"), "_carry": F.col("end_ms")})
    else:
        w = Window.partitionBy(*by).orderBy(*order)
        rows = rows.withColumns({"_closed": F.lag("_closes").over(w), "_carry": F.lag("end_ms").over(w)})
    # what the record before carries counts where a piece begins after it, not at a track's start
    cut = pieces(rows.withColumn("_carry", F.when(F.col("_closed"), F.col("_carry"))), by, order, F.col("_closed"), chunk)
    return fold(cut, by, order, _Sentence, carry="_carry", chunk=chunk)


#: What joins the texts of a piece while pairs are replaced over their ends, and the signs that stand for it and for the sign itself in a text.
_END, _MARK = "\0", "\x01"


def _marked(text: Column) -> Column:
    """The text without the joining sign: it and the mark are written as the mark and a second sign."""
    return F.replace(F.replace(text, F.lit(_MARK), F.lit(_MARK + "\x02")), F.lit(_END), F.lit(_MARK + "\x03"))


def _unmarked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK + "\x03"), F.lit(_END)), F.lit(_MARK + "\x02"), F.lit(_MARK))


def _apart(pairs: list[tuple[str, str]], before: Column, text: Column) -> Column:
    """Whether no pair can match over the end between two texts, whatever earlier pairs wrote.

    Neither text holds the old or the new side's first words of a pair in full, so
    neither changes; both have words; and no pair of several words has one word at
    the end of the first text and the following one at the start of the second.
    """
    last, first = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(text, r"^\s*(\S+)", 1)
    meets = F.lit(False)
    for wrong, correct in pairs:
        meets = meets | F.contains(before, F.lit(wrong)) | F.contains(text, F.lit(wrong))
        old = wrong.split()
        if len(old) > 1 and len(old) == len(correct.split()):
            for one, two in zip(old, old[1:], strict=False):
                meets = meets | (last.endswith(one) & first.startswith(two))
            # a match within a text over blanks other than one space, or over a text of one word, changes it
            meets = meets | F.contains(before, F.lit(old[0])) & F.contains(before, F.lit(old[-1])) | F.contains(text, F.lit(old[0])) & F.contains(text, F.lit(old[-1]))
    return ~meets & (last != "") & (first != "")


def replace_over_ends(df: DataFrame, by: list[str], order: list[str], pairs: list[tuple[str, str]], text: str = "text", chunk: Column | None = None) -> DataFrame:
    """Ordered replacement in the texts of a track; a pair of as many words on either side also matches over a text's end.

    The words go to either side of the end as they stood, and the end stays.  Null
    texts stay null.  Texts are joined and rewritten in pieces, cut where no pair can
    match over the end, so a row holds a piece and not a track.  Pairs must not hold
    the characters 0 to 3.
    """
    if any(c in side for pair in pairs for side in pair for c in "\0\x01\x02\x03"):
        raise ValueError("pairs must not hold the characters 0 to 3")
    if any(not wrong for wrong, _ in pairs):
        raise ValueError("a pair needs a left side")
    if chunk is not None:
        rows = scanned(df, by, order, chunk, previous={"_before": F.col(text)})
    else:
        rows = df.withColumn("_before", F.lag(text).over(Window.partitionBy(*by).orderBy(*order)))
    cut = pieces(rows, by, order, _apart(pairs, F.col("_before"), F.col(text)), chunk)
    others = [c for c in df.columns if c not in by]
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*others).alias("_row"))))
    joined_rows = cut.groupBy(*by, "_piece").agg(listed.alias("_rows"))
    joined = F.array_join(F.transform("_rows", lambda x: _marked(F.coalesce(x["_row"][text], F.lit("")))), _END)
    for wrong, correct in pairs:
        joined = F.replace(joined, F.lit(wrong), F.lit(correct))
        old, new = wrong.split(), correct.split()
        if len(old) > 1 and len(old) == len(new):
            escaped = [re.sub(r"([^\w])", r"\\\1", w) for w in old]
            pattern = escaped[0] + "".join(rf"(?<g{i}>[\s\x00]+){w}" for i, w in enumerate(escaped[1:], 1))
            quoted = [re.sub(r"([\\$])", r"\\\1", w) for w in new]
            joined = F.regexp_replace(joined, pattern, quoted[0] + "".join(f"${{g{i}}}{w}" for i, w in enumerate(quoted[1:], 1)))
    pair = lambda x, t: F.struct(x["_row"].alias("r"), _unmarked(t).alias("t"))
    out = joined_rows.select(*by, F.explode(F.zip_with("_rows", F.split(joined, _END, -1), pair)).alias("_x"))
    new = F.when(F.col(f"_x.r.{text}").isNotNull(), F.col("_x.t"))
    return out.select(*(F.col(c) if c in by else new.alias(c) if c == text else F.col(f"_x.r.{c}").alias(c) for c in df.columns))


def clean_captions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """All phases in order: collapse, adjacent repeats, inner repeats, overlaps, sentences."""
    out = collapse_progressive(df, by, order)
    out = drop_adjacent_repeats(out, by, ["pos"], "text")
    out = out.withColumn("text", drop_inner_repeats("text"))
    return sentence_segments(trim_overlaps(out, by, ["pos"]), by, ["pos"])
