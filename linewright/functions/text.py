"""Column functions on text: stamps, entities, replacement, counting and hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unescape import character_counts

STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})"


def stamp_to_ms(stamp: Column) -> Column:
    """``[HH:]MM:SS,mmm`` (comma or point) as milliseconds; null if it doesn't parse."""
    # one match for all four numbers, bound as the element of an array of one; hours of more than seven digits count as none
    parts = F.split(F.regexp_replace(stamp, rf"(?s)\A.*?{STAMP}.*\z", "$1:$2:$3:$4"), ":")
    number = lambda p, i: F.when(F.length(p[i]).between(1, 7), p[i].cast("long")).otherwise(F.lit(0))
    sums = F.transform(F.array(parts), lambda p: ((number(p, 0) * 60 + number(p, 1)) * 60 + number(p, 2)) * 1000 + number(p, 3))
    return F.when(stamp.rlike(STAMP), F.get(sums, F.lit(0)))


def ms_to_stamp(ms: Column, sep: str = ",") -> Column:
    """Milliseconds as ``HH:MM:SS,mmm``; negative values count as zero."""
    ms = F.greatest(ms.cast("long"), F.lit(0))
    second = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60, ms % 1000)


def short_clock(ms: Column) -> Column:
    """Milliseconds as ``MM:SS``, or ``HH:MM:SS`` from an hour on."""
    second = F.floor(ms / 1000)
    hour, minute = F.floor(second / 3600), F.floor(second / 60) % 60
    return F.when(hour > 0, F.format_string("%02d:%02d:%02d", hour, minute, second % 60)).otherwise(F.format_string("%02d:%02d", minute, second % 60))


def collapse_space(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comparable(text: Column, casefold: bool = False) -> Column:
    """Text as quotations are compared: collapsed white space, optionally lower case."""
    out = collapse_space(text)
    return F.lower(out) if casefold else out


def without_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, "[​‌‍⁠﻿]", "")


#: Entities in the order in which each decoder replaces them (fixed values).
ENTITIES_AMP_LAST = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
ENTITIES_AMP_EARLY = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]


def replace_pairs(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacement; a later pair sees what an earlier one wrote."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def pairs_with_slugs(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs, those of several words followed by their hyphenated forms."""
    return [q for w, c in pairs for q in ([(w, c), (w.replace(" ", "-"), c.replace(" ", "-"))] if " " in w else [(w, c)])]


def decode_entities_once(text: Column) -> Column:
    """Six entities, the ampersand last, so that nothing is decoded twice."""
    return replace_pairs(text, ENTITIES_AMP_LAST)


def decode_entities_amp_early(text: Column) -> Column:
    """Five entities, the ampersand before the quotes, which are thus decoded twice."""
    return replace_pairs(text, ENTITIES_AMP_EARLY)


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def without_speaker_marks(text: Column) -> Column:
    """Speaker marks and spare space away."""
    return collapse_space(F.regexp_replace(text, r">>+|(?<=^|\s)>(?=\s|$)", " "))


def caption_text(text: Column) -> Column:
    """Caption markup away: tags, then six entities and hard spaces, then speaker marks and spare space."""
    return without_speaker_marks(F.replace(decode_entities_once(without_tags(text)), F.lit("&nbsp;"), F.lit(" ")))


def without_fences(text: Column) -> Column:
    """Lines that open or close a code fence go."""
    return F.regexp_replace(text, r"(?m)^\s*```[A-Za-z]*[ \t]*\n?", "")


def without_fence_marks(text: Column) -> Column:
    """Fence marks go wherever they stand, with the blanks around them and the word ``srt``."""
    return F.regexp_replace(text, " *```(?:srt)? *", "")


def without_wrapper(text: Column) -> Column:
    """The first opening fence (bare, ``markdown`` or ``md``) and the first closing one go, and white space at the ends."""
    opened = F.regexp_replace(text, r"(?s)\A(.*?)(?<![^\n])```(?:markdown|md)?\s*\n", "$1")
    closed = F.regexp_replace(opened, r"(?s)\A(.*?)\n```\s*(?=\n|\z)", "$1")
    return F.regexp_replace(closed, r"(?U)\A\s+|\s+\z", "")


#: Remarks that replies make about themselves, in the order in which they go (fixed values; letters of either case).
META_REMARKS = (
    r"I (?:realize|notice|see)[^\n]{0,250}?[Ll]et me (?:provide|give|re-?do|correct)[^\n]*\n",
    r"Looking at (?:the|my)[^\n]{0,100}?(?:again|error|mistake)[^\n]*\n",
    r"(?:Wait|Hmm|Actually)[,.][^\n]{0,200}?[\n]",
    r"整理好的完整\s*SRT[^\n]*\n",
    r"(?:以下是|以下為)[^\n]{0,50}(?:修正|正確|完整|重新)[^\n]*\n",
    r"我(?:發現|注意到)[^\n]{0,100}(?:錯誤|問題|偏移)[^\n]*\n",
    r"```(?:srt)?\s*\n",
    r"\n```\s*",
    r"(?:翻譯完成|完整的\s*SRT|corrected complete translation)[^\n]*\n",
)


def without_meta_remarks(text: Column) -> Column:
    """A reply's remarks about itself go, wherever they stand, one pattern after the other."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?iu){p}", ""), META_REMARKS, text)


def from_first_heading(text: Column) -> Column:
    """What stands before the first ``# `` line goes; a text without one stays."""
    start = F.regexp_instr(text, F.lit(r"(?m)^# "))
    return F.when(start > 0, F.substr(text, start)).otherwise(text)


def until_last(text: Column, marker: str) -> Column:
    """What stands after the last ``marker`` goes; a text without one stays."""
    at = F.length(text) - F.locate(marker[::-1], F.reverse(text)) + 1
    return F.when(text.contains(marker), F.substr(text, F.lit(1), at)).otherwise(text)


def strip_prefaces(text: Column, patterns: list[str]) -> Column:
    """Leading sentences that match one of the patterns go, one pattern after the other."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?i)^\s*(?:{p})\s*", ""), patterns, text)


def heading_key(line: Column, words: tuple[str, ...] = ("Ch", "Group")) -> Column:
    """Kind, number and title of a heading such as ``# Ch3: Title`` (half- or full-width colon)."""
    pattern = rf"^#\s+({'|'.join(words)})\s*(\d+)\s*[:：]\s*(.*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("kind"), part(2).cast("int").alias("number"), F.trim(part(3)).alias("title")))


def chapter_title(text: Column, name: Column) -> Column:
    """A note's title: what follows a dash in one of its first second-level headings, else its first heading's, else its file's name as words.

    Only the first 2,000 characters, and for the dash their first 25 lines, count.
    """
    head = F.left(text, F.lit(2000))
    lines = F.transform(F.slice(F.split(head, "\n"), 1, 25), lambda x: F.trim(x))
    dashed = F.filter(lines, lambda x: x.startswith("## ") & F.contains(x, F.lit("—")))
    titles = F.filter(F.transform(dashed, lambda x: F.trim(F.regexp_replace(x, "^## [^—]*—", ""))), lambda x: x != "")
    heading = F.nullif(F.trim(F.regexp_extract(head, r"(?m)^#[ \t]+Ch\d+:[ \t]*(\S.*)$", 1)), F.lit(""))
    return F.coalesce(F.get(titles, F.lit(0)), heading, F.replace(F.regexp_replace(name, "-+$", ""), F.lit("-"), F.lit(" ")))


def slug(text: Column, most: int = 40, sep: str = "-", keep_han: bool = False) -> Column:
    """Lower-case words joined by ``sep``, at most ``most`` characters."""
    kept = r"a-z0-9\p{IsHan}" if keep_han else "a-z0-9"
    joined = F.regexp_replace(F.lower(text), f"[^{kept}]+", sep)
    return F.regexp_replace(F.left(F.regexp_replace(joined, f"^{sep}+|{sep}+$", ""), F.lit(most)), f"{sep}+$", "")


def count_literal(text: Column, pattern: Column | str) -> Column:
    """How often a literal occurs, occurrences not overlapping; an empty one never does."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    n = F.length(pattern)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, pattern, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def replace_pairs_column(text: Column, pairs: Column, word_boundary: bool = False) -> Column:
    """Ordered replacement by a column of (wrong, correct) structs.

    Literally a short ``wrong`` also changes longer words; ``word_boundary``
    spares them.
    """
    if word_boundary:
        # the boundary is asked of letters and digits on either side
        step = lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), p["wrong"], F.lit(r"\E(?![\p{L}\p{N}])")), p["correct"])
    else:
        step = lambda t, p: F.replace(t, p["wrong"], p["correct"])
    return F.aggregate(pairs, text, step)


def dominant_share(text: Column) -> Column:
    """Share of the most frequent character among those that aren't white space."""
    counts = character_counts(text)
    return F.when(counts["n"] > 0, counts["most"] / counts["n"]).otherwise(F.lit(0.0))


def is_stuck_line(text: Column, least: int = 20, share: float = 0.8) -> Column:
    """A long line that one character dominates."""
    return (character_counts(text)["n"] >= least) & (dominant_share(text) >= share)


def han_share(text: Column) -> Column:
    """Share of Han characters among all."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^一-鿿]", "")) / F.length(text)).otherwise(F.lit(0.0))


def is_han(text: Column, share: float = 0.15, first_bytes: int = 4096) -> Column:
    """Whether more than ``share`` of the characters in the first bytes are Han; a character that the end cuts goes."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, first_bytes).cast("string"))
    return F.coalesce(han_share(F.regexp_replace(head, "\ufffd$", "")) > share, F.lit(False))


def language_hint(url: Column, language: Column, text: Column, domains: dict[str, str]) -> Column:
    """First that holds: the address's domain, the stated language, many Han characters, Latin letters alone."""
    by_domain = [F.when(url.contains(d), code) for d, code in domains.items()]
    stated = F.when(F.trim(language) != "", F.lower(F.substring_index(language, "-", 1)))
    return F.coalesce(*by_domain, stated, F.when(han_share(text) > 0.3, "zh"), F.when(text.rlike("[A-Za-z]") & (han_share(text) == 0), "en"), F.lit("unknown"))


def url_member(href: Column, folder: Column) -> Column:
    """An archive member that a link names: decoded, without fragment, below its folder."""
    bare = F.try_url_decode(F.replace(F.substring_index(href, "#", 1), F.lit("+"), F.lit("%2B")))
    return F.when(folder == "", bare).otherwise(F.concat_ws("/", folder, bare))


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def short_digest(data: Column, size: int = 8) -> Column:
    return F.left(F.md5(data), F.lit(size))


def size_route(n_bytes: Column, limit: int = 15 * 1024) -> Column:
    """Whether a text goes to the main reader or to one of its own."""
    return F.when(n_bytes < limit, "main").otherwise("sub")


def size_class(said: Column) -> Column:
    """The stated class, medium if it is none of the three."""
    return F.when(said.isin("small", "medium", "large"), said).otherwise("medium")


def large_content(pages: Column, parts: Column, lines: Column, chars: Column) -> Column:
    """Whether any of the four measures makes a content large."""
    return F.coalesce(pages > 50, F.lit(False)) | F.coalesce(parts > 3, F.lit(False)) | F.coalesce(lines > 2000, F.lit(False)) | F.coalesce(chars > 60_000, F.lit(False))
