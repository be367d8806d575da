"""Substring deduplication by prefix-partitioned suffix trees.

A window of 35 words is repeated if its words also start anywhere else.  That
is a node of depth 35 or more with at least two leaves in the suffix tree of
the corpus.  The tree is never whole anywhere:

* Of all suffixes of a window's words, the one whose first eight words hash
  lowest is its anchor.  Equal windows have equal anchors at equal places, so a
  window whose anchor's prefix occurs once is not repeated, and about one word
  in fifteen is an anchor.
* The prefixes are counted (a task adds up its own first), those that occur
  once are dropped, and the others split the suffixes into groups.  An anchor
  comes with its context, the words of all windows that chose it; equal
  contexts are one leaf with a count.
* A prefix whose contexts are all equal is one path: all its windows repeat.
* A group of at most ``GROUP`` contexts is one subtree.
* In a larger group the suffixes are taken one by one and their prefixes grow,
  from eight to 16 and 24 words, until a group holds ``GROUP`` suffixes at most;
  then that group is one subtree.  Suffixes alone in their group end there.  A
  prefix that has grown to all 35 words is a node of that depth by itself.
* A subtree is the sorted suffixes with the words that neighbours have in
  common; its internal nodes of depth 35 or more are the repeats, those that
  differ to the left the maximal ones (within the contexts).

Texts travel compressed, once to cut contexts and once to drop the words.

Null and empty texts have no words; texts of fewer than 35 words have no
windows.  Rows that repeat are each other's copies.  Null ids are ids like any
other.  Further columns don't matter.  A very long text is one row, whose words
a task holds; its contexts are spread like those of many short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix, raw_text, spread_join, staged, word_hashes

WINDOW, PREFIX = 35, 8
#: Contexts or suffixes that a subtree holds in memory at once (some 2 MB).
GROUP = 4096
#: Lengths to which the prefixes of larger groups grow.
LONGER = (16, 24)


def anchors(words: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, prefix hash, first window start and number of window starts of every anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    grams = gram_hashes(words, prefix)
    span = window - prefix + 1
    place = np.empty(n, np.int64)
    for i in range(0, n, 1 << 16):  # the leftmost least prefix of each window
        part = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + span - 1], span)
        place[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    at = place[first]
    return at, grams[at], first, np.diff(np.append(first, n))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two keys that stand for the row."""
    doc, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(text, doc).alias("k1"), F.xxhash64(doc).alias("k2"))


def _compressed(rows: DataFrame) -> DataFrame:
    """The texts as Zstandard frames."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([pack.compress(x) for x in raw_text(batch.column(1))], pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "packed", "k1", "k2"])

    return rows.mapInArrow(run, "doc_id long, packed binary, k1 long, k2 long")


def _occurrences(rows: DataFrame, window: int) -> DataFrame:
    """prefix, k1, k2 and place of every anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, owner = [], [], []
            for i, raw in enumerate(raw_text(batch.column(0))):
                at, prefix, _, _ = anchors(word_hashes(raw)[0], window)
                hashes.append(prefix.view(np.int64))
                places.append(at)
                owner.append(np.full(len(at), i))
            if hashes:
                own = pa.array(np.concatenate(owner).astype(np.int64))
                yield pa.record_batch([pa.array(np.concatenate(hashes).astype(np.int64)), batch.column(1).take(own), batch.column(2).take(own), pa.array(np.concatenate(places).astype(np.int32))], names=["prefix", "k1", "k2", "place"])

    return rows.select("text", "k1", "k2").mapInArrow(run, "prefix long, k1 long, k2 long, place int")


def _contexts(packed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The context of every wanted anchor: prefix, leaf (its digest), k1, k2, first, starts and words."""
    schema = pa.schema([("prefix", pa.int64()), ("leaf", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("starts", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for data, k1, k2, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack.decompress(data)
                hashes, begin, end = word_hashes(raw)
                at, prefix, first, starts = anchors(hashes, window)
                for i in np.flatnonzero(np.isin(at, np.array(places))).tolist():
                    a, n = int(first[i]), int(starts[i])
                    words = b" ".join(raw[begin[a] : end[a + n + window - 2]].split())
                    leaf = hashlib.blake2b(words + b"\0%d" % (int(at[i]) - a), digest_size=16).digest()
                    rows.append((int(prefix[i].view(np.int64)), leaf, k1, k2, a, n, words))
                    if len(rows) >= 20_000:
                        yield _batch(rows, schema)
                        rows = []
            yield _batch(rows, schema)

    joined = packed.join(wanted, ["k1", "k2"]).select("packed", "k1", "k2", "places")
    return joined.mapInArrow(run, "prefix long, leaf binary, k1 long, k2 long, first int, starts int, words binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Node(NamedTuple):
    """An internal node: its depth in words, its first and last suffix in order, and whether it is left-maximal."""

    depth: int
    first: int
    last: int
    maximal: bool


def subtree(suffixes: list[tuple[list[bytes], bytes | None, int]], window: int = WINDOW) -> tuple[list[int], list[Node]]:
    """Order of the suffixes (words, word before, count) and the internal nodes of depth ``window`` or more.

    Neighbours in order share a path of as many words as their common prefix
    has; a stack of open paths gives the nodes.  A suffix with a count above
    one is a node by itself, as deep as it is long.
    """
    order = sorted(range(len(suffixes)), key=lambda k: suffixes[k][0])
    nodes: list[Node] = []
    open_paths: list[tuple[int, int]] = []  # depth and first suffix
    for at in range(len(order) + 1):
        depth = 0
        if 0 < at < len(order):
            one, two = suffixes[order[at - 1]][0], suffixes[order[at]][0]
            if one[:window] == two[:window]:
                depth = next((i for i, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), min(len(one), len(two)))
        first = at - 1
        while open_paths and open_paths[-1][0] > depth:
            deep, first = open_paths.pop()
            nodes.append(_node(deep, first, at - 1, order, suffixes))
        if depth >= window and (not open_paths or open_paths[-1][0] < depth):
            open_paths.append((depth, first))
        if at < len(order) and suffixes[order[at]][2] > 1 and len(suffixes[order[at]][0]) >= window:
            nodes.append(_node(len(suffixes[order[at]][0]), at, at, order, suffixes))
    return order, nodes


def _node(depth: int, first: int, last: int, order: list[int], suffixes: list) -> Node:
    before = {suffixes[k][1] for k in order[first : last + 1]}
    return Node(depth, first, last, len(before) > 1 or None in before)


def deep_nodes(leaves: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each leaf (words, count), which of its windows begin suffixes below a deep node."""
    suffixes, owner, out = [], [], []
    for k, (words, count) in enumerate(leaves):
        listed = words.split(b" ")
        n = len(listed) - window + 1
        out.append(np.zeros(n, bool))
        suffixes += [(listed[i:], listed[i - 1] if i else None, count) for i in range(n)]
        owner += [(k, i) for i in range(n)]
    order, nodes = subtree(suffixes, window)
    for node in nodes:
        for at in range(node.first, node.last + 1):
            k, i = owner[order[at]]
            out[k][i] = True
    return out


def _subtrees(leaves: DataFrame, window: int) -> DataFrame:
    """Flags of the windows of each leaf; a task holds one group at a time."""
    schema = pa.schema([("prefix", pa.int64()), ("leaf", pa.binary()), ("flags", pa.binary())])

    def close(group: list[tuple]) -> list[tuple]:
        nodes = deep_nodes([(words, n) for _, _, words, n in group], window)
        return [(prefix, leaf, np.packbits(x).tobytes()) for (prefix, leaf, _, _), x in zip(group, nodes, strict=True) if x.any()]

    dealt = leaves.select("prefix", "leaf", "words", "n").repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(_by_group(close, schema), "prefix long, leaf binary, flags binary")


def _by_group(close, schema: pa.Schema):
    """A task that gives each run of rows with the same first column to ``close``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    rows += close(group)
                    group = []
                group.append(row)
            yield _batch(rows, schema)
        if group:
            yield _batch(close(group), schema)

    return run


def _longer_prefixes(leaves: DataFrame, window: int, group: int) -> DataFrame:
    """The repeated windows of leaves in large groups: prefixes grow until their suffixes fit a subtree."""
    lengths = [n for n in LONGER if n < window]
    paths = [f"p{n}" for n in lengths]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(len(lengths) + 4)]
            for i, raw in enumerate(batch.column(2).to_pylist()):
                hashes, _, _ = word_hashes(raw)
                a, b = gram_hashes(hashes, window), gram_hashes(mix(hashes ^ np.uint64(0x5BD1E995)), window)
                parts = [gram_hashes(hashes, n)[: len(a)] for n in lengths] + [a, b]
                for column, x in zip(columns, [np.full(len(a), i, np.int64), np.arange(len(a), dtype=np.int32), *(p.view(np.int64) for p in parts)], strict=True):
                    column.append(x)
            if columns[0]:
                own, start, *hashed = (pa.array(np.concatenate(c)) for c in columns)
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), batch.column(3).take(own), start, *hashed], names=["prefix", "leaf", "n", "start", *paths, "h1", "h2"])

    longs = "".join(f", {p} long" for p in [*paths, "h1", "h2"])
    pending = staged(leaves.select("prefix", "leaf", "words", "n").mapInArrow(cut, f"prefix long, leaf binary, n long, start int{longs}"), "suffixes")
    place, fitting = ["prefix", "leaf", "start"], []
    for path in paths:
        sizes = staged(pending.groupBy(path).agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("total > 1"), "sizes")
        joined = staged(spread_join(pending, sizes.select(path, "size"), [path], counts=sizes.select(path, F.col("size").alias("n"))), "grown")
        fitting.append(joined.where(F.col("size") <= group).select(*place, "n", F.xxhash64(F.lit(path), path).alias("path")))
        pending = joined.where(F.col("size") > group).drop("size")
    # prefixes of full length: a node each
    nodes = pending.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.count("*").alias("n")).where("total > 1")
    whole = spread_join(pending, nodes.select("h1", "h2"), ["h1", "h2"], counts=nodes.select("h1", "h2", "n")).select(place)
    if not fitting:
        return whole.groupBy("prefix", "leaf").agg(F.collect_set("start").alias("repeated"))

    schema = pa.schema([("path", pa.int64()), ("prefix", pa.int64()), ("leaf", pa.binary()), ("start", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix, leaf, words, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = words.split(b" ")
                rows += [(x["path"], prefix, leaf, x["start"], x["n"], b" ".join(listed[x["start"] :])) for x in starts]
            yield _batch(rows, schema)

    def close(rows: list[tuple]) -> list[tuple]:
        order, nodes = subtree([(words.split(b" "), None, n) for _, _, _, _, n, words in rows], window)
        below = {order[at] for node in nodes for at in range(node.first, node.last + 1)}
        return [rows[k][1:4] for k in below]

    asked = reduce(DataFrame.unionByName, fitting).groupBy("prefix", "leaf").agg(F.collect_list(F.struct("path", "start", "n")).alias("starts"))
    cut_out = leaves.select("prefix", "leaf", "words").join(asked, ["prefix", "leaf"]).mapInArrow(suffixes, "path long, prefix long, leaf binary, start int, n long, words binary")
    found = cut_out.repartition("path").sortWithinPartitions("path").mapInArrow(_by_group(close, pa.schema([schema.field(i) for i in (1, 2, 3)])), "prefix long, leaf binary, start int")
    return found.unionByName(whole).groupBy("prefix", "leaf").agg(F.collect_set("start").alias("repeated"))


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """k1, k2 and the repeated windows of every row that has some: runs (first, starts, flags, repeated)."""
    rows = _keyed(docs)
    occurrences = staged(_occurrences(rows, window), "anchors")
    # frequent prefixes and contexts are hot keys of all these joins
    known = staged(occurrences.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    wanted = spread_join(occurrences, known.select("prefix"), ["prefix"], counts=known).groupBy("k1", "k2").agg(F.collect_set("place").alias("places"))
    contexts = staged(_contexts(_compressed(rows), wanted, window), "contexts")
    counted = staged(contexts.groupBy("prefix", "leaf").agg(F.count("*").alias("n")), "leaves")
    groups = staged(counted.groupBy("prefix").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("total > 1"), "groups")
    sized = staged(spread_join(counted, groups.select("prefix", "size"), ["prefix"], counts=groups.select("prefix", F.col("size").alias("n"))), "sized")
    # one path: every window of the only context repeats
    paths = sized.where("size = 1").select("prefix", "leaf", F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("array<int>").alias("repeated"))
    open_leaves = sized.where("size > 1").withColumnRenamed("n", "copies")
    branching = spread_join(contexts.select("prefix", "leaf", "words", "k1", "k2"), open_leaves, ["prefix", "leaf"], counts=counted)
    # copies of a context are equal: one of each goes on, and a task drops its own first
    branching = staged(branching.groupBy("prefix", "leaf").agg(F.first("copies").alias("n"), F.first("size").alias("size"), F.first("words").alias("words")), "branching")
    small = _subtrees(branching.where(F.col("size") <= group), window).withColumn("repeated", F.lit(None).cast("array<int>"))
    large = _longer_prefixes(branching.where(F.col("size") > group), window, group).select("prefix", "leaf", F.lit(None).cast("binary").alias("flags"), "repeated")
    nodes = paths.unionByName(small).unionByName(large)
    found = spread_join(contexts.select("prefix", "leaf", "k1", "k2", "first", "starts"), nodes, ["prefix", "leaf"], counts=counted)
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "starts", "flags", "repeated")).alias("runs"))


def covered(n_words: int, runs: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which words a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int32)
    for x in runs:
        if x["repeated"] is not None:
            starts = x["first"] + np.array(x["repeated"])
        elif x["flags"] is not None:
            starts = x["first"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: x["starts"]])
        else:
            starts = x["first"] + np.arange(x["starts"])
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; ``with_text`` adds the kept words."""
    rows = _keyed(docs)
    found = repeated_windows(docs, window=window, group=group)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, digests, texts = [], [], [], []
            for data, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = unpack.decompress(data).split()
                sizes.append(len(words))
                if runs:
                    drop = covered(len(words), runs, window)
                    words = [w for w, x in zip(words, drop.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                removed.append(sizes[-1] - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(columns + ([pa.array(texts, pa.string())] if with_text else []), names=names)

    joined = _compressed(rows).join(found, ["k1", "k2"], "left").select("doc_id", "packed", "runs")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
