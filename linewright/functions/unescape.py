"""Functions that need Python: the full entity table, repeats within a text, rewriting across cues, script conversion.

Functions over whole texts read a batch one text at a time and pack results in
slices, so that a worker holds a batch's texts once, and not also as objects.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


#: Characters of results that are packed at once.
_SLICE = 1 << 20


def mapped(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The changed texts of an Arrow array, null for null, packed in slices."""
    parts, own, size = [], [], 0
    for x in texts:
        y = x.as_py()
        own.append(None if y is None else change(y))
        size += len(own[-1] or "")
        if size >= _SLICE:
            parts.append(pa.array(own, pa.string()))
            own, size = [], 0
    return pa.concat_arrays([*parts, pa.array(own, pa.string())])


@F.arrow_udf(StringType())
def unescape_html(texts: pa.Array) -> pa.Array:
    """All named and numbered entities of HTML."""
    return mapped(texts, html.unescape)


_BASE, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Places of one start that are tried one by one, and words compared in vain for each word of a text, before scales are built.
_FEW, _VAIN = 64, 8


class _Scales:
    """For each scale of sizes (3 to 5 words, 6 to 11, and so on) the places where a run of the scale's least size was kept, by its rolling hash.

    An end of a scale that the next words repeat begins at such a place, less than
    two such sizes from the end; since repeats never stay, a run rarely has more
    than two places there, so a word costs a few lookups for each scale.
    """

    def __init__(self, words: list[str], kept: list[str], least_run: int) -> None:
        self.words, self.kept, self.least = words, [], least_run
        n = len(words)
        self.numbers = {w: hash((w, _BASE)) & _WORD for w in set(words)}
        self.power, self.ahead, self.sums = [1] * (n + 1), [0] * (n + 1), [0]
        for i, w in enumerate(words):
            self.power[i + 1] = self.power[i] * _BASE & _WORD
            self.ahead[i + 1] = (self.ahead[i] * _BASE + self.numbers[w]) & _WORD
        self.scales: list[tuple[int, dict[int, list[int]]]] = []
        for w in kept:
            self.keep(w)

    def keep(self, word: str) -> None:
        self.kept.append(word)
        m, sums, power = len(self.kept), self.sums, self.power
        sums.append((sums[-1] * _BASE + self.numbers[word]) & _WORD)
        if m >= self.least << len(self.scales):
            self.scales.append((self.least << len(self.scales), {}))
        for size, begun in self.scales:
            p = m - size
            begun.setdefault((sums[m] - sums[p] * power[size]) & _WORD, []).append(p)

    def repeated(self, at: int) -> int:
        """How many words from ``at`` on repeat the end of what was kept; 0 if none do."""
        words, kept, sums, power, ahead = self.words, self.kept, self.sums, self.power, self.ahead
        n, m = len(words), len(kept)
        for size, begun in reversed(self.scales):
            if at + size > n:
                continue
            places = begun.get((ahead[at + size] - ahead[at] * power[size]) & _WORD, ())
            for p in places[bisect_left(places, max(m - 2 * size + 1, m - (n - at))) :]:
                own = m - p
                if (sums[m] - sums[p] * power[own] - ahead[at + own] + ahead[at] * power[own]) & _WORD == 0 and kept[p:] == words[at : at + own]:
                    return own
        return 0


def without_inner_repeats(text: str, least_words: int = 6, least_run: int = 3) -> str:
    """From left to right, words go that repeat the end of what was kept: the longest such run of three or more.

    A repeat begins with three words (``least_run``) that were kept one after the
    other, so the places where such starts were kept are on record, and most words
    have none.  Where a start has many places, or many words were compared in vain,
    the rest of the text is read with :class:`_Scales`.
    """
    words = text.split()
    n = len(words)
    if n < least_words:
        return text
    kept: list[str] = []
    begun: dict[tuple[str, ...], list[int]] = {}
    scales, vain, at = None, _VAIN * n, 0
    for i, start in enumerate(zip(*(words[k:] for k in range(least_run)), strict=False)):
        if i < at:
            continue
        m, found = len(kept), 0
        if scales is None and (places := begun.get(start)):
            if len(places) > _FEW or vain < 0:
                scales = _Scales(words, kept, least_run)
            else:
                for p in places[bisect_left(places, m - (n - at)) :]:  # the longest first
                    own = m - p
                    if kept[-1] == words[at + own - 1]:
                        if kept[p:] == words[at : at + own]:
                            found = own
                            break
                        vain -= own
        if scales is not None:
            found = scales.repeated(at)
        if found:
            at += found
            continue
        kept.append(words[at])
        at += 1
        if scales is not None:
            scales.keep(kept[-1])
        elif m + 1 >= least_run:
            begun.setdefault(tuple(kept[-least_run:]), []).append(m + 1 - least_run)
    return " ".join([*kept, *words[at:]])  # fewer words than a run repeat nothing


@F.arrow_udf(StringType())
def drop_inner_repeats(texts: pa.Array) -> pa.Array:
    return mapped(texts, without_inner_repeats)


_WORD_RUN = re.compile("[^ \t\n\x0b\f\r]+")


def without_overlap(before: list[str], words: list[str]) -> list[str]:
    """The words without their longest beginning that ends ``before``.

    One reading of the last words of ``before`` against the table of the beginnings'
    own borders, so that no word is compared more than twice.
    """
    border, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = border[k - 1]
        k += words[i] == words[k]
        border[i] = k
    k = 0
    for word in before[-len(words) :] if words else ():
        while k and (k == len(words) or word != words[k]):
            k = border[k - 1]
        k += word == words[k]
    return words[k:]


@F.pandas_udf(StringType())
def rest_after_overlap(before: pd.Series, texts: pd.Series) -> pd.Series:
    """Each text's words, but for the longest beginning that ends the text before it; null for null."""
    find = _WORD_RUN.findall
    return pd.Series([None if t is None else " ".join(without_overlap(find(b) if b is not None else [], find(t))) for b, t in zip(before, texts, strict=True)], dtype=object)


#: White space by Unicode's property.
_SPACE = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def characters(text: str) -> tuple[int, int]:
    """How many characters aren't white space, and how often the most frequent of them stands there."""
    counts = Counter(text)
    for c in _SPACE & counts.keys():
        del counts[c]
    return counts.total(), max(counts.values(), default=0)


@F.pandas_udf(StructType([StructField("n", LongType()), StructField("most", LongType())]))
def character_counts(texts: pd.Series) -> pd.DataFrame:
    """:func:`characters` of each text by one reading; both null for null."""
    found = [(None, None) if t is None else characters(t) for t in texts]
    return pd.DataFrame(found, columns=["n", "most"], dtype="Int64")


def replace_across(lines: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Ordered replacement in a track; a pair of as many words on either side also matches over a line's end."""
    for wrong, correct in pairs:
        lines = [x.replace(wrong, correct) for x in lines]
        parts, new = wrong.split(), correct.split()
        if len(parts) > 1 and len(parts) == len(new):
            joined = "\0".join(lines)
            pattern = re.compile(r"([\s\0]+)".join(map(re.escape, parts)))
            lines = pattern.sub(lambda m, new=new: new[0] + "".join(m[i] + new[i] for i in range(1, len(new))), joined).split("\0")
    return lines


def _apart(table: dict[str, str]) -> bool:
    """Whether the entries may be replaced one after the other in any order: no two share a character, and no target has one of a source."""
    seen = "".join("".join(set(source)) for source in table)
    loops = any(len(set(source)) < len(source) for source in table)  # it might overlap itself or begin again
    return not loops and len(set(seen)) == len(seen) and not set(seen) & set("".join(table.values()))


def converter(table: dict[str, str]) -> Callable[[Column], Column]:
    """A column function that replaces the longest entries of a mapping table, from left to right.

    Entries that can't meet are replaced by Spark's own function, so no text goes
    to Python.
    """
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))) if table else None
    if "" not in table and _apart(table):
        return lambda text: reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), table.items(), text)

    @F.arrow_udf(StringType())
    def convert(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda x: pattern.sub(lambda m: table[m[0]], x))

    return convert
