"""Quality by an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted text (rows labelled with good quality) over all
runs of five characters, four begin marks before each text.  Counts, context
totals, discounts and interpolated probabilities are Spark tables, joined on
their keys; a task adds up its own runs before the shuffle, so frequent runs
arrive as one row for each task.

Scoring looks up every character of every text.  The model is dealt into shards
of a bounded number of rows by the last two characters of the context, the part
that a run and all its shorter suffixes share; the texts are read once for each
shard, with that shard alone broadcast, and the partial sums are added up.

A text's perplexity is that of a character.  A quarter of the trusted texts is
kept out of the training; texts above a quantile of that quarter in their
language, times a slack, are rejected.  A language without such texts takes the
quantile of all.

Null and empty texts have no perplexity and are rejected; a null language is a
language of its own; repeated rows give equal rows; without trusted text every
perplexity is null and nothing is kept.  Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged

ORDER = 5
BITS = 21
BEGIN = (1 << BITS) - 1
_MASK = (1 << BITS) - 1
#: Rows of the model that are broadcast at once (some 25 bytes each).
SHARD_ROWS = 800_000
QUANTILE, SLACK = 0.995, 1.02
#: Characters that are counted, and scored, at a time.
_COUNTED, _SCORED = 1 << 20, 1 << 18
_PRIME = 1_000_003


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, begin marks before each, and where each text begins."""
    mark = np.full(ORDER - 1, BEGIN, np.int64)
    parts, starts, at = [], [], 0
    for text in texts:
        own = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        parts += [mark, own]
        starts.append(at + ORDER - 1)
        at += ORDER - 1 + len(own)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(starts, np.int64)


def runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of five characters that ends at each position from the fifth on, packed: two and three of them."""
    return c[:-4] << BITS | c[1:-3], c[2:-2] << 2 * BITS | c[3:-1] << BITS | c[4:]


def key(level: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hash of a run; that of a context has a negative level."""
    with np.errstate(over="ignore"):
        out = mix(high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level & 0xFF))
        return mix(out + low.astype(np.uint64)) | np.uint64(1)


@dataclass
class Table:
    """Open-addressing table of hashed runs and contexts."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        out = cls(np.zeros(size, np.uint64), np.zeros(size, np.float32))
        at, left = (keys >> np.uint64(8)).astype(np.int64) & (size - 1), np.arange(len(keys))
        while len(left):
            free = left[out.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            out.keys[at[put]], out.values[at[put]] = keys[put], values[put]
            left = left[out.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)
        return out

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        size = len(self.keys)
        at = (keys >> np.uint64(8)).astype(np.int64) & (size - 1)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.float32(np.nan))
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            at[left] = (at[left] + 1) & (size - 1)
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out


def _suffix(level: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ``level`` characters of packed runs of five."""
    if level == 5:
        return high, low
    if level == 4:
        return high & _MASK, low
    return np.zeros_like(high), low & ((1 << BITS * level) - 1)


def log_probabilities(model: Table, unknown: float, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Log probability of the last character of each run after the four before it."""
    out = np.zeros(len(high), np.float64)
    left = np.arange(len(high))
    for level in range(ORDER, 0, -1):
        if not len(left):
            return out
        h, w = _suffix(level, high[left], low[left])
        found = model.get(key(level, h, w))
        hit = ~np.isnan(found)
        out[left[hit]] += found[hit]
        left, h, w = left[~hit], h[~hit], w[~hit]
        if level > 1:
            out[left] += np.nan_to_num(model.get(key(-level, h, w >> BITS)), nan=0.0)
    out[left] += unknown
    return out


def count_runs(texts: DataFrame) -> DataFrame:
    """(high, low, a) of every run of five characters in the Zstandard frames of the column ``packed``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merge() -> None:
            high, low, n = (np.concatenate(x) for x in zip(*held, strict=True))
            _, first, place = np.unique(key(0, high, low), return_index=True, return_inverse=True)
            held[:] = [(high[first], low[first], np.bincount(place, n, len(first)).astype(np.int64))]

        def emit() -> pa.RecordBatch:
            merge()
            return pa.record_batch([pa.array(x, pa.int64()) for x in held.pop()], names=["high", "low", "n"])

        waiting, unpack = 0, zstandard.ZstdDecompressor()
        for batch in batches:
            some: list[str] = []
            size = 0
            for data in [*batch.column(0), None]:
                if data is not None:
                    some.append(unpack.decompress(data.as_buffer()).decode())
                    size += len(some[-1])
                if some and (data is None or size >= _COUNTED):
                    high, low = runs(codes(some)[0])
                    real = low & _MASK != BEGIN  # a run ends in a character
                    high, low = high[real], low[real]
                    held.append((high, low, np.ones(len(high), np.int64)))
                    waiting += len(high)
                    some, size = [], 0
                    if waiting >= 2 * _COUNTED:
                        merge()
                        waiting = 0
                        if len(held[0][0]) > 2_000_000:
                            yield emit()
        if held:
            yield emit()

    return texts.select("packed").mapInArrow(run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("a"))


def packed(texts: DataFrame) -> DataFrame:
    """doc_id and text as a Zstandard frame, which a shuffle carries at less than half its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([pack.compress(x.encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "packed"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def train(texts: DataFrame) -> tuple[DataFrame, float] | None:
    """The model as rows (level, high, low, value), contexts at negative levels, and an unknown character's log probability.

    ``texts`` are those of :func:`packed`.
    """
    top = staged(count_runs(texts), "runs")
    tables = {5: top.select("high", "low", "a")}
    tables[4] = tables[5].groupBy(F.col("high").bitwiseAND(_MASK).alias("high"), "low").agg(F.count("*").alias("a"))
    for k in (3, 2, 1):
        tables[k] = tables[k + 1].groupBy(F.col("low").bitwiseAND((1 << BITS * k) - 1).alias("low")).agg(F.count("*").alias("a")).select(F.lit(0).cast("long").alias("high"), "low", "a")
    levels = tables[5].withColumn("level", F.lit(5))
    for k in (4, 3, 2, 1):
        levels = levels.unionByName(tables[k].withColumn("level", F.lit(k)))
    levels = staged(levels, "levels")
    tally = {r["level"]: r for r in levels.groupBy("level").agg(*(F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)), F.sum("a").alias("total"), F.count("*").alias("size"), F.count_if(F.col("a") >= 3).alias("more")).collect()}
    if 1 not in tally:
        return None
    below = None
    parts = []
    for k in range(1, ORDER + 1):
        d = discounts(*(tally[k][f"n{i}"] for i in range(1, 5)))
        own = levels.where(F.col("level") == k).select("high", "low", "a").withColumn("cut", F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2]))
        if k == 1:
            row = tally[1]
            rest = (d[0] * row["n1"] + d[1] * row["n2"] + d[2] * row["more"]) / row["total"]
            unseen = rest / (row["size"] + 1)
            below = own.select("high", "low", ((F.col("a") - F.col("cut")) / row["total"] + unseen).alias("p"))
        else:
            own = own.withColumn("c_high", F.col("high") if k > 3 else F.lit(0).cast("long")).withColumn("c_low", F.shiftright("low", BITS))
            contexts = own.groupBy("c_high", "c_low").agg((F.sum("cut") / F.sum("a")).alias("gamma"), F.sum("a").alias("total"))
            s_high = F.col("high").bitwiseAND(_MASK) if k == 5 else F.lit(0).cast("long")
            s_low = F.col("low") if k > 3 else F.col("low").bitwiseAND((1 << BITS * (k - 1)) - 1)
            shorter = below.select(F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("q"))
            below = own.withColumns({"s_high": s_high, "s_low": s_low}).join(contexts, ["c_high", "c_low"]).join(shorter, ["s_high", "s_low"]).select("high", "low", ((F.col("a") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p"))
            parts.append(contexts.select(F.lit(-k).alias("level"), F.col("c_high").alias("high"), F.col("c_low").alias("low"), F.log("gamma").alias("value")))
        below = staged(below, f"level_{k}")
        parts.append(below.select(F.lit(k).alias("level"), "high", "low", F.log("p").alias("value")))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    return staged(model, "model"), float(np.log(unseen))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two and more."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw))


def _shard(model: DataFrame, number: int, of: int) -> Table:
    """The rows that one reading of the texts needs: at most about ``SHARD_ROWS``."""
    middle = F.when(F.col("level") > 0, F.shiftright("low", BITS)).otherwise(F.col("low")).bitwiseAND((1 << 2 * BITS) - 1)
    mine = (F.col("level").between(-2, 2)) | (F.pmod(middle % _PRIME, F.lit(of)) == number)
    rows = model.where(mine).toArrow()
    level, high, low, value = (rows[c].to_numpy() for c in ("level", "high", "low", "value"))
    keys = np.empty(len(level), np.uint64)
    for k in np.unique(level):
        at = level == k
        keys[at] = key(int(k), high[at], low[at])
    return Table.of(keys, value.astype(np.float32))


def perplexities(docs: DataFrame, model: DataFrame, unknown: float, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, n_tokens (characters), log_probability and perplexity of every row."""
    of = max(1, -(-model.count() // shard_rows))
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.xxhash64(text).alias("key"), text.alias("text"))
    context = rows.sparkSession.sparkContext

    def scored(number: int) -> DataFrame:
        shared = context.broadcast(_shard(model, number, of))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                texts = [x or "" for x in batch.column(3).to_pylist()]
                sums = np.zeros(len(texts))
                i = 0
                while i < len(texts):
                    j, size = i, 0
                    while j < len(texts) and size < _SCORED:
                        size += len(texts[j])
                        j += 1
                    c, starts = codes(texts[i:j])
                    high, low = runs(c)
                    real = low & _MASK != BEGIN
                    if of > 1:
                        real &= (low >> BITS & ((1 << 2 * BITS) - 1)) % _PRIME % of == number
                    value = np.zeros(len(low) + 1)
                    at = np.flatnonzero(real)
                    value[at] = log_probabilities(own, unknown, high[at], low[at])
                    total = np.concatenate([[0.0], np.cumsum(value)])
                    ends = np.append(starts[1:], len(c) + ORDER - 1) - (ORDER - 1)
                    sums[i:j] = total[ends - (ORDER - 1)] - total[starts - (ORDER - 1)]
                    i = j
                yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in texts], pa.int64()), pa.array(sums)], names=["doc_id", "lang", "key", "n_tokens", "log_probability"])

        return rows.mapInArrow(run, "doc_id long, lang string, key long, n_tokens long, log_probability double")

    out = scored(0)
    if of > 1:
        for number in range(1, of):
            out = out.unionByName(scored(number))
        names = ["doc_id", "lang", "key", "n_tokens"]
        # rows that repeat have equal sums: they are added up together and dealt out again
        added = out.groupBy(*names).agg(F.sum("log_probability").alias("log_probability"), (F.count("*") / of).cast("int").alias("times"))
        out = added.withColumn("log_probability", F.col("log_probability") / F.col("times")).withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_probability") / F.col("n_tokens")))
    return out.select("doc_id", "lang", "n_tokens", "log_probability", perplexity.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, slack: float = SLACK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold and kept, for every row of ``docs``."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # trusted ids grow with the corpus, so a broadcast of them has no bound; the shuffle carries packed texts
    trained = train(packed(texts).join(trusted.where(~apart).hint("shuffle_hash"), "doc_id", "left_semi"))
    names = ["doc_id", "lang", "n_tokens", "perplexity"]
    if trained is None:
        empty = F.lit(None).cast("double")
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.coalesce(F.char_length(docs["text"].cast("string")), F.lit(0)).cast("long").alias("n_tokens"), empty.alias("perplexity"), empty.alias("threshold"), F.lit(False).alias("kept"))
    scores = staged(perplexities(docs, *trained, shard_rows=shard_rows).select(names), "perplexities")
    known = scores.join(trusted.where(apart), "doc_id", "left_semi").where("perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    by_language = known.groupBy("lang").agg(limit.alias("own"))
    overall = known.agg(limit.alias("overall")).first()["overall"]
    out = scores.join(by_language.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall)) * slack)
    return out.select(*names, "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
