"""MinHash near-duplicates with HyperMinHash registers.

Words are those of the lower-cased (A-Z) text between ASCII white space; a
text's set holds its distinct runs of five words (the whole sequence if it has
fewer).  Texts are linked if 100 * |A and B| >= 75 * |A or B|, and a text's
component is the smallest id reachable over links.

* Equal sets form one class; classes, not rows, take part in what follows, so a
  group of exact copies costs one class.
* Each of 128 buckets (one hash function each, as short texts would leave most
  buckets of a single function empty) keeps the least hash as a register of 16
  bits: the number of leading zeros and the next ten bits.
* Four registers make a band, 32 bands a signature: texts at a similarity of
  0.75 miss each other with a chance of 5e-6.
* In each band bucket every class is paired with one representative, which
  makes a star instead of all pairs.  Pairs are screened by the Jaccard
  estimate, corrected for the chance that registers agree by accident, and
  those that stay are confirmed on the full sets.
* Buckets whose classes are in different components after that are compared
  block by block, without emitting pairs that the estimate rules out, so that
  no link of a bucket is lost to the choice of its representative.
* Components are found by joins that contract the links round by round.

Null and empty texts and those without words have an empty set, no links and
their own id.  Rows that repeat an id give a row each.  A null id takes part in
links but is never a component's name; where a component has no id, its name is
null and ``kept`` false.  Further columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix, raw_text, spread_join, staged, word_hashes

WORDS = 5
BUCKETS, ROWS = 128, 4
MANTISSA = 10
#: Pairs whose estimate falls short of 0.75 by more than this are not verified (five standard errors, a chance of about 1e-6 for a link of exactly 0.75).
LEAST, SLACK = 0.75, 0.2
#: Shingles that a comparison of blocks holds in sets at once; of longer texts it holds two.
HELD = 200_000
#: Classes that one block comparison holds on either side.
BLOCK = 512

_BAND = (np.arange(BUCKETS // ROWS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_A = np.random.default_rng(7).integers(1, 1 << 32, BUCKETS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(11).integers(0, 1 << 32, BUCKETS, dtype=np.uint64).astype(np.uint32)


def shingles(raw: bytes, n: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words, _, _ = word_hashes(raw.lower())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def registers(grams: np.ndarray) -> np.ndarray:
    """A register for each bucket: leading zeros and mantissa of the least hash."""
    base = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(base), 2048):
        x = base[i : i + 2048, None] * _A + _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    zeros = (31 - np.floor(np.log2(np.maximum(least, 1).astype(np.float64)))).astype(np.uint32)
    shifted = np.left_shift(least.astype(np.uint64), (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return (zeros << np.uint32(MANTISSA) | (shifted >> np.uint64(32 - MANTISSA)).astype(np.uint32)).astype(np.uint16)


_AT = ((np.arange(4) + 0.5) / 4 + 1)[None, :] * 2.0 ** -(np.arange(32) + 1)[:, None]
_WIDTH = np.repeat(2.0 ** -(np.arange(32) + 1) / 4 * 2.0 ** -(np.arange(32) + 1 + MANTISSA), 4)


def _density(n: np.ndarray) -> np.ndarray:
    """Density of the least of ``n`` hashes at a grid of four points for each count of zeros."""
    n = n.astype(float)[:, None]
    return n * np.exp(-n * _AT.ravel())


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of disjoint sets of ``n`` and ``m`` elements agree.

    The least of n hashes is about exponential; with z leading zeros a register
    stands for 2**-(z + 1 + mantissa) of the range of hashes.
    """
    return (_density(n) * _density(m)) @ _WIDTH


def estimate(left: np.ndarray, right: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows, corrected for accidental agreement."""
    return ((left == right).mean(axis=-1) - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, cls (digest of the set) and its registers."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("regs", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, regs = [], [], []
            for raw in raw_text(batch.column(2)):
                grams = shingles(raw)
                sizes.append(len(grams))
                classes.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                regs.append(registers(grams).tobytes() if len(grams) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(regs, pa.binary())], schema=schema)

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, cls binary, regs binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def bands(classes: DataFrame) -> DataFrame:
    """The key of every band bucket of every class; ``short`` is a hash of the class."""
    n = BUCKETS // ROWS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, n)
                keys = mix(regs ^ _BAND).view(np.int64)
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(keys.ravel())], names=["short", "bucket"])

    return classes.select("short", "regs").mapInArrow(run, "short long, bucket long")


def _screened(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) behind staged pairs of short keys whose estimate comes near the threshold; a star's centre may be frequent."""
    side = lambda x: classes.select(F.col("short").alias(f"{x}_short"), F.col("cls").alias(x), F.col("regs").alias(f"{x}_regs"), F.col("n_shingles").alias(f"{x}_n"))
    # classes that share a short key only add candidates
    both = spread_join(pairs, side("a"), ["a_short"]).join(side("b"), "b_short").where("100 * least(a_n, b_n) >= 75 * greatest(a_n, b_n)")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
                n, m = (batch.column(i).to_numpy() for i in (4, 5))
                near = pa.array(estimate(left, right, accidental(n, m)) >= LEAST - SLACK)
                yield pa.record_batch([batch.column(i).filter(near) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "a_regs", "b_regs", "a_n", "b_n").mapInArrow(run, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The staged pairs (a, b) that are linked, by their full sets of shingles."""
    # each text of a pair is at most one row, and a frequent one is dealt with its pairs
    both = spread_join(pairs, texts.select(F.col("cls").alias("a"), F.col("text").alias("a_text")), ["a"]).join(texts.select(F.col("cls").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = word_shingles(left), word_shingles(right)
                common = len(x & y)
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a binary, b binary")


def word_shingles(text: str, n: int = WORDS) -> set[tuple[bytes, ...]]:
    """A text's set as tuples of words."""
    words = text.encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node in ``links`` (a, b).

    Each round a tree takes the lowest root that any of its nodes sees across a
    link, then every node takes its root's root, so long chains halve.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = staged(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("far")).select("node", F.least("node", "far").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("far")), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        lower = roots.join(near, "node").groupBy("root").agg(F.least("root", F.min("far")).alias("low"))
        # a large component is a hot key of these joins
        hooked = staged(spread_join(roots, lower, ["root"]).select("node", "root", "low"), "hooked")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = staged(spread_join(hooked, jump, ["low"], "left").select("node", "root", F.coalesce("next", "low").alias("low")), "roots")
        roots = after.select("node", F.col("low").alias("root"))
        if not after.where("low <> root").limit(1).count():
            return roots


def _rest(members: DataFrame, classes: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, one for each two components of a group.

    Of an open bucket, every class outside its largest component meets all
    others: blocks of the former by blocks of all, in groups of bounded size.
    Signatures come first; the texts of classes that have candidates follow,
    and no pair leaves a group unless it is a link.
    """
    named = members.join(classes.select("short", "cls"), "short").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
    by_root = named.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    # a bucket of two classes was one star: it is settled
    open_buckets = by_root.groupBy("bucket").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main")).where("most < n and n > 2")
    rows = named.join(open_buckets, "bucket").join(classes.select("cls", "regs", "n_shingles"), "cls")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    all_blocks, own_blocks = blocks(F.col("n")), blocks(F.col("n") - F.col("most"))
    columns = ["bucket", "i", "j", "cls", "root", "regs", "n_shingles", "queried"]
    hashed = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    every = rows.withColumn("j", hashed(all_blocks)).withColumn("i", F.explode(F.sequence(F.lit(0), own_blocks - 1))).withColumn("queried", F.lit(False))
    queried = rows.where("root <> main").withColumn("i", hashed(own_blocks)).withColumn("j", F.explode(F.sequence(F.lit(0), all_blocks - 1))).withColumn("queried", F.lit(True))

    carried = "bucket long, i int, j int, cls binary, root binary, regs binary, n_shingles long, queried boolean"

    def screen(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["queried"]], group[~group["queried"]]
        used, seen = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for k, near in _near(left, right):
            used[k] = True
            seen[near] = True
        return pd.concat([left[used], right[seen]])

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["queried"]], group[~group["queried"]]
        own, other = left["root"].tolist(), right["root"].tolist()
        a, b = left["cls"].tolist(), right["cls"].tolist()
        text = dict(zip(group["cls"], group["text"], strict=True))
        sets: dict[bytes, set] = {}
        held = 0

        def shingled(c: bytes) -> set:
            nonlocal held
            if c not in sets:
                made = word_shingles(text[c])
                while sets and held + len(made) > HELD:  # the oldest go
                    held -= len(sets.pop(next(iter(sets))))
                sets[c] = made
                held += len(made)
            return sets[c]

        joined: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while x in joined:
                x = joined[x]
            return x

        found = []
        for k, near in _near(left, right):
            for p in near.tolist():
                x, y = top(own[k]), top(other[p])
                if x != y:  # one link joins two components
                    one, two = shingled(a[k]), shingled(b[p])
                    common = len(one & two)
                    if 100 * common >= 75 * (len(one) + len(two) - common):
                        joined[x] = y
                        found.append((a[k], b[p]))
        return pd.DataFrame(found, columns=["a", "b"])

    keys = ("bucket", "i", "j")
    close = staged(every.select(columns).unionByName(queried.select(columns)).groupBy(*keys).applyInPandas(screen, carried), "close")
    return close.join(texts, "cls").groupBy(*keys).applyInPandas(confirm, "a binary, b binary").distinct()


def _near(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``left`` with its candidates in ``right``: other components, in the first bucket that both share."""
    if not len(left) or not len(right):
        return
    x, y = (np.frombuffer(b"".join(s["regs"]), np.uint16).reshape(-1, BUCKETS) for s in (left, right))
    p, q = x.view(np.uint64), y.view(np.uint64)
    band = int(np.flatnonzero(mix(p[0] ^ _BAND).view(np.int64) == left["bucket"].iloc[0])[0])
    n, m = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
    chance = (_density(n) * _WIDTH) @ _density(m).T
    own, other = left["root"].to_numpy(), right["root"].to_numpy()
    for k in range(len(left)):
        near = np.flatnonzero((own[k] != other) & (100 * np.minimum(n[k], m) >= 75 * np.maximum(n[k], m)))
        if band:
            near = near[~(p[k, :band] == q[near, :band]).any(axis=1)]
        near = near[estimate(x[k], y[near], chance[k, near]) >= LEAST - SLACK]
        if len(near):
            yield k, near


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and cls, doc_id (the least), text_id and key (of one text, with an id if any has) and root of every class."""
    rows = staged(signatures(docs), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "regs")).alias("one")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), one)
    classes = staged(classes.select("cls", F.xxhash64("cls").alias("short"), "doc_id", "n_shingles", F.col("one.doc_id").alias("text_id"), F.col("one.key").alias("key"), F.col("one.regs").alias("regs")), "classes")
    members = bands(classes)
    stars = members.groupBy("bucket").agg(F.min("short").alias("a_short"), F.count("*").alias("n")).where("n > 1").select("bucket", "a_short")
    members = staged(members.join(stars, "bucket"), "members")
    stars = members.where("short <> a_short").select("a_short", F.col("short").alias("b_short")).distinct()
    pairs = staged(_screened(staged(stars, "stars"), classes), "pairs")
    texts = staged(_texts(docs, classes, members), "texts")
    first = staged(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = staged(_verified(first, texts), "links")
    roots = components(links)
    for step in ("others", "rest"):
        if step == "others":
            name = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))  # noqa: B023, E731
            more = pairs.join(first, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
            more = more.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
        else:
            more = _rest(members.select("bucket", "short"), classes, texts, roots)
        more = staged(_verified(staged(more, "more"), texts) if step == "others" else more, f"links_{step}")
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = components(links)
    named = classes.select("cls", "doc_id", "text_id", "key").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return rows, staged(named, "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for every row of ``docs``."""
    rows, named = _grouped(docs)
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(named, ids, ["root"]).select("cls", "component_id")
    rows = rows.select("doc_id", "n_shingles", "cls")
    # copies of one text are a hot key; texts without words have none
    out = spread_join(rows.where("cls is not null"), named, ["cls"]).unionByName(rows.where("cls is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: one row of each component stays.

    That's the row with the component's smallest id (a row without id only if
    none has one); of rows that repeat id and text one stays, that of the least
    hash over all columns but maps.  Rows are told apart by id and text, so one
    that only shares the id of a duplicate stays.  Texts without words are linked
    with nothing and all stay.
    """
    _, named = _grouped(docs)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_id", "key")).alias("one"))
    chosen = first.select(*_identity(F.col("one.text_id"), F.col("one.key")))
    text = docs["text"].cast("string")
    plain = [docs[f.name] for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]  # maps and variants can't be hashed
    rows = docs.select(*_identity(docs["doc_id"].cast("long"), F.xxhash64(text)), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("lw_words"), F.struct(*(docs[c] for c in docs.columns)).alias("lw_row"), F.xxhash64(*plain).alias("lw_pick"))
    # repeated rows are a hot key: each task keeps one before the shuffle, which the join shares
    once = rows.where("lw_words").groupBy("lw_one", "lw_two").agg(F.min_by("lw_row", "lw_pick").alias("lw_row")).join(chosen, ["lw_one", "lw_two"], "left_semi")
    return once.select("lw_row").unionByName(rows.where("not lw_words").select("lw_row")).select(*(F.col("lw_row")[c].alias(c) for c in docs.columns))


def _identity(doc_id, key) -> list:
    """Two hashes that stand for a row's id (or its lack) and text."""
    return [F.xxhash64(doc_id, key).alias("lw_one"), F.xxhash64(key, doc_id, doc_id.isNull()).alias("lw_two")]


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """One text of each class that shares a bucket with another, however often its row is repeated."""
    chosen = classes.join(members.select("short").distinct(), "short", "left_semi").select("cls", *_identity(F.col("text_id"), F.col("key")))
    keyed = _keyed(docs).select(*_identity(F.col("doc_id"), F.col("key")), "text")
    # rows that repeat id and text meet in the join, whose order the removal of all but one shares
    return keyed.join(chosen, ["lw_one", "lw_two"]).dropDuplicates(["lw_one", "lw_two"]).select("cls", "text")
