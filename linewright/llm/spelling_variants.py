"""Spelling variants: words one edit apart, by forward and backward automata.

Words that differ by one inserted, deleted or replaced code point agree in a half:
cut a word ``x`` in the middle, and a near word either begins with its first half
or ends with its second.  So each word is listed under its beginnings of the
lengths that half a near word may have, and under such endings, and every word
asks under its own two halves.  The lists are dealt into shards of bounded size by
a hash of the half; a list beyond ``PART`` words is dealt into parts, and its
askers go to each of them, so no half is too frequent.

A shard builds minimal acyclic automata, one over its words and one over its words
read backwards, from sorted input in one pass.  Edges carry the number of words
that they skip, so that a path spells a word and gives its number, a perfect
hash: counts are arrays by that number and no word is stored beside the automaton.
An asker follows its half exactly, then completes with exactly one error.  Paths
that spell the same word are merged by its number, and what the backward automaton
finds is left out where the first half agrees as well, since the forward one has
it: every near pair is met once from either side, and no pair leaves its shard,
only each word's number of near words and its best one.

Null texts have no words, a null id counts as the empty string, repeated rows
count again, very long texts are read whole, columns besides ``doc_id`` and
``text`` are not read, and an empty table gives an empty result.  Ties among near
words go to the smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One in so many runs loses a code point.
SLIP = 97
#: Entries of a shard, about; words of one part of a half's list, about.
SHARD, PART = 30_000, 15_000
#: Distinct words that a counting task holds before it hands them on.
_HELD = 400_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def runs_of(doc_id: int | None, text: str, least: int = LEAST_LENGTH, slip: int = SLIP) -> Iterator[tuple[str, int]]:
    """The words of a text of at least ``least`` code points after slips, with their number, each run once."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().translate(_LOWER).decode())).items():
        size = len(run)
        if size >= least:
            h = zlib.crc32(run.encode(), start)
            if h % slip == 0:
                at = h % size
                run = run[:at] + run[at + 1 :]
                if size == least:
                    continue
            yield run, n


def count_words(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points that occur ``least_count`` times in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in runs_of(doc_id, text.as_py(), least_length, slip):
                    held[word] += n
                if len(held) > _HELD:
                    yield emit()
        if held:
            yield emit()

    texts = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a path's skipped words add up to a word's number."""

    def __init__(self, words: Iterable[str]) -> None:
        #: For each state: edges (label: (target, words skipped)), whether a word ends here.
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._below: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # states of the last word: [final, finished edges (label, state)]
        last = ""

        def close(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            state = known.get(signature)
            if state is None:
                state = known[signature] = len(self.edges)
                out, skipped = {}, int(node[0])
                for label, target in node[1]:
                    out[label] = (target, skipped)
                    skipped += self._below[target]
                self.edges.append(out)
                self.final.append(node[0])
                self._below.append(skipped)
            return state

        def shorten(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], close(node)))

        for word in words:
            common, most = 0, min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            shorten(common)
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
        shorten(0)
        self.start = close(path[0])

    def __len__(self) -> int:
        return self._below[self.start]

    def follow(self, state: int, text: str, skipped: int = 0) -> tuple[int, int] | None:
        """State and words skipped after ``text``, None where no word goes on so."""
        edges = self.edges
        for label in text:
            edge = edges[state].get(label)
            if edge is None:
                return None
            state, skipped = edge[0], skipped + edge[1]
        return state, skipped

    def number(self, word: str) -> int | None:
        """A word's place in the sorted list, None for other words."""
        found = self.follow(self.start, word)
        return found[1] if found and self.final[found[0]] else None

    def word(self, number: int) -> str:
        """The word of a number."""
        state, out = self.start, []
        while number or not self.final[state]:
            ends = list(self.edges[state].items())
            at = bisect_left(ends, number + 1, key=lambda e: e[1][1]) - 1
            label, (target, skipped) = ends[at]
            out.append(label)
            state, number = target, number - skipped
        return "".join(out)

    def near(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that begin with ``exact`` and go on like ``rest`` but for exactly one edit."""
        found = self.follow(self.start, exact)
        out: set[int] = set()
        if found is None:
            return out
        state, skipped = found
        edges, final, follow = self.edges, self.final, self.follow
        for i in range(len(rest) + 1):
            left, after = rest[i:], rest[i + 1 :]
            for label, (target, more) in edges[state].items():
                if i < len(rest):
                    if label == rest[i]:
                        pass
                    elif (end := follow(target, after, skipped + more)) and final[end[0]]:  # replaced
                        out.add(end[1])
                if (end := follow(target, left, skipped + more)) and final[end[0]]:  # inserted
                    out.add(end[1])
            if i < len(rest):
                if (end := follow(state, after, skipped)) and final[end[0]]:  # deleted
                    out.add(end[1])
                edge = edges[state].get(rest[i])
                if edge is None:
                    break
                state, skipped = edge[0], skipped + edge[1]
        return out


def ask(words: list[str], counts: list[int], askers: list[str], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """For every asker with near words among ``words``: itself, their number, the best one's count and the best one.

    ``words`` are distinct.  Backward, an asker's second half is exact, and words
    that also share the first half are left to the forward search.
    """
    key = (lambda w: w[::-1]) if backward else (lambda w: w)
    order = sorted(range(len(words)), key=lambda i: key(words[i]))
    n = [counts[i] for i in order]
    automaton = Automaton(key(words[i]) for i in order)
    spelt: dict[int, str] = {}
    for asker in askers:
        half = len(asker) // 2
        exact, rest = (asker[half:][::-1], asker[:half][::-1]) if backward else (asker[:half], asker[half:])
        found = automaton.near(exact, rest)
        times, best, best_word = 0, -1, ""
        for number in found:
            if backward or n[number] >= best:
                word = spelt.get(number)
                if word is None:
                    word = spelt[number] = key(automaton.word(number))
                if backward and word.startswith(asker[:half]):
                    continue
                if n[number] > best or n[number] == best and word < best_word:
                    best, best_word = n[number], word
            times += 1
        if times:
            yield asker, times, best, best_word


def listed(words: DataFrame, *, least_length: int = LEAST_LENGTH, part: int = PART) -> DataFrame:
    """(backward, half, part, word, n, asks, stands, alone): each word's entries, at most four, and a copy of an asker for each part.

    An entry that only asks does not stand in its part.  ``alone`` names the parts
    of a divided list, which must not share an automaton with others: a word of
    another part may stand there under another half.
    """
    size = F.char_length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda n: n >= least_length)
    front = F.transform(F.array_distinct(F.transform(lengths, lambda n: F.floor(n / 2).cast("int"))), lambda h: F.struct(F.lit(False).alias("backward"), F.substring(F.col("word"), F.lit(1), h).alias("half"), (h == F.floor(size / 2)).alias("asks")))
    back = F.transform(F.array_distinct(F.transform(lengths, lambda n: F.ceil(n / 2).cast("int"))), lambda h: F.struct(F.lit(True).alias("backward"), F.substring(F.col("word"), size - h + 1, h).alias("half"), (h == F.ceil(size / 2)).alias("asks")))
    entries = words.select("word", "n", F.explode(F.concat(front, back)).alias("e")).select("word", "n", "e.*")
    parts = entries.groupBy("backward", "half").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    entries = entries.join(parts, ["backward", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    places = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    alone = F.when(F.col("parts") > 1, F.concat_ws(" ", "part", "half")).otherwise("")
    return entries.withColumn("own", own).withColumn("part", F.explode(places)).select("backward", "half", "part", "word", "n", "asks", (F.col("own") == F.col("part")).alias("stands"), alone.alias("alone"))


def nearest(words: DataFrame, *, least_length: int = LEAST_LENGTH, shard: int = SHARD, part: int = PART) -> DataFrame:
    """(word, n_near, best) of the words of (word, n) that have near words; ``best`` is the near word of largest n, a struct (n, word)."""
    shards = max(1, -(-4 * words.count() // shard))
    entries = listed(words, least_length=least_length, part=part).withColumn("shard", F.pmod(F.xxhash64("backward", "half", "part"), F.lit(shards)))
    out = pa.schema([("word", pa.string()), ("times", pa.int64()), ("best_n", pa.int64()), ("best_word", pa.string())])

    def search(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        groups: dict[tuple[bool, str], tuple[dict[str, int], set[str]]] = {}
        for backward, alone, word, n, asks, stands in zip(*(table[c].to_pylist() for c in ("backward", "alone", "word", "n", "asks", "stands")), strict=True):
            kept, askers = groups.setdefault((backward, alone), ({}, set()))
            if stands:
                kept[word] = n
            if asks:
                askers.add(word)
        for (backward, _), (kept, askers) in groups.items():
            rows += ask(list(kept), list(kept.values()), sorted(askers), backward)
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, out, strict=True)], schema=out)

    found = entries.groupBy("shard").applyInArrow(search, "word string, times long, best_n long, best_word string")
    # the smallest of (-n, word) is the largest n, then the smallest word: strings compare by their UTF-8 bytes
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word")))
    return found.groupBy("word").agg(F.sum("times").alias("n_near"), best.alias("best")).withColumn("best", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form from each row of (word, form) on, by pointers that double their reach.

    A form has more occurrences than its word, so there are no circles and a chain
    is no longer than the logarithm of the largest count.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def spelling_variants(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP, shard: int = SHARD, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``.

    The form is the near word of largest n where that is at least ``ratio`` times
    the word's own n (``ratio`` above 1), else null; the root follows the forms.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = staged(count_words(docs, least_length=least_length, least_count=least_count, slip=slip), "words")
    near = words.join(nearest(words, least_length=least_length, shard=shard, part=part), "word", "left")
    has = F.col("best.n") >= ratio * F.col("n")
    rows = staged(near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.n")).alias("form_n")), "forms")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
