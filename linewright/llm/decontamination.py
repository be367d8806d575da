"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters and digits of the lower-cased text (every byte beyond
ASCII counts as a letter).  The seeds are the runs of three words of the test
items.  A seed in a text is paired if another seed of its item stands beside it
on nearly the same diagonal, and lone otherwise.  One pass counts in how many
texts each seed is lone; the rarer half of an item's seeds, and ``RARE_LEAST`` of
them at least, are its rare ones, whatever the number of texts.  Copies of an
item, whole or edited, hold its seeds in pairs, so they don't make its seeds
common, however often it leaked.  A second pass takes the rare seeds and all
paired ones in the texts, cuts the passage around them and aligns it with the
item, word by word.  An alignment's score is its share of the greatest possible
one; from ``LEAST_SCORE`` on it is a leak.

A leak is missed only if its seeds all stand alone and in the commoner half.
``tests/llm/test_recall.py`` holds the recall against exhaustive alignment.

Test items are collected in chunks of bounded size, each of which is broadcast
for two readings of the texts; nothing is shuffled but the counts of the seeds.
So the texts are read twice for each chunk: a benchmark is small beside them.

Null and empty texts and items match nothing, an empty table gives no leaks, and
a very long text is aligned in the passages around its seeds alone.  Items of fewer than three words
are one seed.  Rows that repeat give a row each; an item that occurs twice in a
text gives a row for each place.  Further columns don't matter.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, word_hashes

SEED_WORDS = 3
RARE_LEAST = 16
LEAST_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items that are broadcast at once.
CHUNK_BYTES = 16 << 20

_BLANK = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> np.ndarray:
    """Hashes of a text's words."""
    return word_hashes(text.lower().encode().translate(_BLANK))[0]


def seeds(own: np.ndarray) -> np.ndarray:
    """Hashes of the runs of three words, or of all words if they are fewer."""
    return gram_hashes(own, min(SEED_WORDS, len(own))) if len(own) else np.empty(0, np.uint64)


class Seeds:
    """Which seeds occur in a text: a bit table first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray, lengths: list[int]) -> None:
        self.hashes = np.unique(hashes)
        self.lengths = sorted(set(lengths) | {SEED_WORDS})
        self.bits = max(16, (16 * len(self.hashes)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the seeds in a text's words."""
        at, found = [], []
        for n in self.lengths:
            grams = gram_hashes(own, n)
            maybe = np.flatnonzero(self.table[(grams >> np.uint64(64 - self.bits)).astype(np.int64)])
            place = np.searchsorted(self.hashes, grams[maybe])
            place[place == len(self.hashes)] = 0
            hit = maybe[self.hashes[place] == grams[maybe]] if len(self.hashes) else maybe[:0]
            at.append(hit)
            found.append(grams[hit])
        return np.concatenate(at), np.concatenate(found)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best score, and the ends of the alignment in item and passage."""
    gap = -GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), 0)
        step = np.maximum(step, row + GAP)
        row = np.maximum.accumulate(step + gap) - gap  # gaps along the passage
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), i + 1, j
    return best


class Items:
    """A chunk of items, and where each of its seeds stands in them."""

    def __init__(self, chunk: list[tuple[int, np.ndarray]]) -> None:
        self.names = [i for i, _ in chunk]
        self.words = [own for _, own in chunk]
        parts = [seeds(own) for own in self.words]
        sizes = [len(x) for x in parts]
        hashes = np.concatenate([*parts, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.item = np.repeat(np.arange(len(parts)), sizes)[order]
        self.offset = np.concatenate([*map(np.arange, sizes), np.empty(0, np.int64)])[order]
        self.seeds = Seeds(hashes, [min(SEED_WORDS, len(own)) for own in self.words])
        self.first = np.append(np.searchsorted(hashes[order], self.seeds.hashes), len(hashes))
        #: By how many words the diagonals of a pair may differ.
        self.near = np.array([max(1, len(own) // 8) for own in self.words], np.int64)

    def hits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every seed in a text's words: its number, where its item would begin, and whether it is paired."""
        at, found = self.seeds.find(own)
        place = np.searchsorted(self.seeds.hashes, found)
        n = self.first[place + 1] - self.first[place] if len(at) else np.empty(0, np.int64)
        seed = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin = np.repeat(at, n) - self.offset[seed]
        if not len(seed):
            return seed, begin, np.empty(0, bool)
        order = np.lexsort((begin, self.item[seed]))
        seed, begin = seed[order], begin[order]
        item, offset = self.item[seed], self.offset[seed]
        new = np.append(True, (np.diff(item) != 0) | (np.diff(begin) != 0))
        # the least and the greatest offset on each diagonal, then on those near it
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        item, diagonal = item[head], begin[head]
        least, most = np.minimum.reduceat(offset, head), np.maximum.reduceat(offset, head)
        low, high = least.copy(), most.copy()
        for k in range(1, len(head)):
            near = np.flatnonzero((item[k:] == item[:-k]) & (diagonal[k:] - diagonal[:-k] <= self.near[item[k:]]))
            if not len(near):
                break
            low[near], high[near] = np.minimum(low[near], least[near + k]), np.maximum(high[near], most[near + k])
            low[near + k], high[near + k] = np.minimum(low[near + k], least[near]), np.maximum(high[near + k], most[near])
        return seed, begin, (low[group] != offset) | (high[group] != offset)


def _aligned_in(word: np.ndarray, passage: np.ndarray, least: float) -> Iterator[tuple[float, int, int]]:
    """Score, first and last word of every leak in a passage: the best one, then those on either side of it."""
    n, parts = len(word), [(0, len(passage))]
    while parts:
        low, high = parts.pop()
        if high - low < least * n:
            continue
        score, end_item, end = align(word, passage[low:high])
        if score < least * MATCH * n or not score:
            continue
        _, _, back = align(word[:end_item][::-1], passage[low : low + end][::-1])
        yield score / (MATCH * n), low + end - back, low + end - 1
        parts += [(low, low + end - back), (low + end, high)]


def leaks_in(own: np.ndarray, items: Items, rare: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """Item, score, first and last word of every leak in a text's words."""
    seed, begin, paired = items.hits(own)
    use = paired | rare[seed]
    begins: dict[int, list[int]] = defaultdict(list)
    for item, start in zip(items.item[seed[use]].tolist(), begin[use].tolist(), strict=True):
        begins[item].append(start)
    out = []
    for item, starts in begins.items():
        word, found = items.words[item], set()
        n = len(word)
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= n // 2 + 2:
                j += 1
            low, high = max(0, starts[i] - n // 2 - 2), min(len(own), starts[j] + n + n // 2 + 2)
            found |= {(-score, low + a, low + b) for score, a, b in _aligned_in(word, own[low:high], least)}
            i = j + 1
        # a passage may have cut a neighbour: of overlapping leaks the fullest, then the first, stays
        stay: list[tuple[int, int]] = []
        for score, a, b in sorted(found):
            k = bisect(stay, (a, b))
            if (not k or stay[k - 1][1] < a) and (k == len(stay) or b < stay[k][0]):
                stay.insert(k, (a, b))
                out.append((item, -score, a, b))
    return sorted(out)


def _chunks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in chunks of bounded size, one at a time on the driver."""
    sized = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // (CHUNK_BYTES // 2)))
    for k in range(number):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text").collect()
        yield [(x["item_id"], own) for x in part if len(own := words(x["text"]))]


def find_leaks(docs: DataFrame, items: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every leak."""
    texts = _texts(docs)
    out = None
    for shared in _prepared(texts, items):
        found = _aligned(texts, shared, least_score)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, *, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item leaked."""
    out, text = docs, docs.columns.index("text")
    for shared in _prepared(_texts(docs), items):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, rare = shared.value
            for batch in batches:
                clean = [x is None or not leaks_in(words(x), own, rare, least_score) for x in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text is not null")


def _prepared(texts: DataFrame, items: DataFrame) -> Iterator:
    """For each chunk of items a broadcast of it and of which of its seeds are rare."""
    spark = texts.sparkSession
    for chunk in _chunks(items):
        own = Items(chunk)
        counts = _counts(texts, spark.sparkContext.broadcast(own)) if chunk else np.empty(0, np.int64)
        order = np.lexsort((own.offset, counts, own.item))
        sizes = np.bincount(own.item, minlength=len(chunk))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rare = np.zeros(len(order), bool)
        rare[order[rank < np.repeat(np.maximum(-(-sizes // 2), RARE_LEAST), sizes)]] = True
        yield spark.sparkContext.broadcast((own, rare))


def _counts(texts: DataFrame, shared) -> np.ndarray:
    """In how many texts each seed of a chunk is lone; as many rows as the chunk has seeds at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tally = np.zeros(len(own.item), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seed, _, paired = own.hits(words(text))
                tally[np.unique(seed[~paired])] += 1
        some = np.flatnonzero(tally)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(tally[some], pa.int64())], names=["seed", "n"])

    out = np.zeros(len(shared.value.item), np.int64)
    found = texts.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out[found["seed"].to_numpy()] = found["n"].to_numpy()
    return out


def _aligned(texts: DataFrame, shared, least: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rare = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, items.names[i], score, a, b) for i, score, a, b in leaks_in(words(text), items, rare, least)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return texts.mapInArrow(run, "doc_id long, item_id long, score double, first_word int, last_word int")
