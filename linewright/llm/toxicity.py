"""Toxicity by maximum-scoring segments.

Training counts, in a bounded sample of labelled texts, in how many toxic and
clean texts each token feature occurs (the word and its first four to eight
letters, so that inflected forms share evidence).  The log-odds of a feature
have a Dirichlet prior in proportion to its frequency in both classes.  A
feature whose log-odds stay large after taking off their standard error scores
that lower value; every other token costs a fixed drift.

A text's scores are scanned once (Ruzzo and Tompa's algorithm) for all maximal
scoring segments.  Under the clean token distribution such scores follow an
extreme-value law: lambda solves sum p(s) exp(lambda s) = 1 and K is fitted to
the clean texts.  A segment of score S in n tokens has the expectation
E = K n exp(-lambda S); a text's evidence is log(1 + sum of 1/E), and a logistic
curve over the training texts turns it into a score from 0 to 1.

Null and empty texts have no evidence and the score of such texts; a null id is
never held out; repeated rows score alike; without labelled rows every score
is 0.  Labels, language, source and id are not inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, staged, word_hashes

#: Labelled rows that training takes, those with the smallest hash of their id.
SAMPLE_ROWS = 24_000
#: Weight of the Dirichlet prior, in texts.
PRIOR = 20.0
#: Least log-odds in standard errors, and least weight, of a feature that scores.
LEAST_Z = 3.0
LEAST_WEIGHT = 1.5
DRIFT = -1.0
THRESHOLD = 0.3
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_«»¿¡"
_CACHE = 200_000


def token_features(token: str) -> tuple[str, ...]:
    word = token.lower().strip(_STRIP)
    if not word:
        return ()
    return (word, *(f"{n}{word[:n]}" for n in (4, 5, 6, 7, 8) if len(word) > n))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = -50.0
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def token(self, token: str) -> float:
        """The largest weight of a token's features, or the drift."""
        weights = self.weights
        found = max((weights[f] for f in token_features(token) if f in weights), default=DRIFT)
        if len(self._cache) < _CACHE and len(token) < 40:
            self._cache[token] = found
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and first, last and score of every maximal scoring segment."""
        tokens = text.split()
        get, slow = self._cache.get, self.token
        scores = [s if (s := get(t)) is not None else slow(t) for t in tokens]
        return len(tokens), maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], DRIFT)

    def evidence(self, text: str) -> float:
        n, found = self.segments(text)
        return math.log1p(sum(math.exp(min(60.0, self.decay * s - math.log(self.k * n))) for _, _, s in found))

    def score(self, text: str) -> float:
        x = self.slope * self.evidence(text) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments; ``hits`` are the positive tokens, ``drift`` the score of the rest."""
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, at = 0.0, 0
    for i, score in hits:
        total += drift * (i - at)
        first, last, low, high = i, i, total, total + score
        total, at = high, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append((first, last, low, high))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts outside the held-out part, one of each near-copy key (key, text, toxic)."""
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most some hundred kB
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(0).to_pylist():
                words, _, _ = word_hashes(text.encode())
                grams = gram_hashes(words, min(5, len(words))) if len(words) else np.zeros(1, np.uint64)
                keys.append(int(grams.min().view(np.int64)))
            yield pa.record_batch([pa.array(keys, pa.int64()), batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32())], names=["key", "text", "toxic"])

    # copies would count their own words again and again: one text of each key and label
    return texts.select("text", "toxic").mapInArrow(run, "key long, text string, toxic int").groupBy("key", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> Model:
    """Fit the weights, the extreme-value law and the logistic curve; every feature that is significant enough is kept, so the sample bounds their number."""
    sample = staged(labelled_sample(docs, labels, rows), "toxic_sample")
    size = {x["toxic"]: x["count"] for x in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(own[0].keys() | own[1].keys())
            out = pa.record_batch([pa.array(names, pa.string()), pa.array([own[1][x] for x in names], pa.int64()), pa.array([own[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])
            own[0].clear()
            own[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[1 if label == 1 else 0].update({f for t in set(text.split()) for f in token_features(t)})
                if len(own[0]) + len(own[1]) > 400_000:
                    yield flush()
        yield flush()

    counts = sample.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = F.lit(PRIOR) * (F.col("t") + F.col("c")) / F.lit(float(toxic + clean))
    odds = lambda n, total: F.log((n + share) / (F.lit(total + PRIOR) - n - share))
    weighed = counts.withColumn("w", odds(F.col("t"), toxic) - odds(F.col("c"), clean)).withColumn("e", F.sqrt(1 / (F.col("t") + share) + 1 / (F.col("c") + share)))
    weighed = weighed.withColumn("z", F.col("w") / F.col("e")).withColumn("w", F.col("w") - F.col("e"))
    kept = weighed.where((F.col("z") >= LEAST_Z) & (F.col("w") >= LEAST_WEIGHT)).orderBy(F.desc("z"), "feature").select("feature", "w", "c").collect()
    model = Model({x["feature"]: x["w"] for x in kept})
    if not kept:
        return model

    level = float(np.median([x["w"] for x in kept]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.segments(x) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([n for n, _ in rows], pa.int64()), pa.array([sum(s >= level for _, _, s in found) for _, found in rows], pa.int64())], names=["toxic", "n", "high"])

    clean_rows = sample.where("toxic is null or toxic <> 1").select("text", "toxic").mapInArrow(scan, "toxic int, n long, high long")
    seen = clean_rows.agg(F.sum("n").alias("n"), F.sum("high").alias("high")).first()
    clean_tokens = max(1, seen["n"] or 0)
    # clean token distribution: the share of each positive weight, smoothed; the rest is drift
    chance = [(x["w"], (x["c"] + 0.5 / len(kept)) / clean_tokens) for x in kept]
    model.decay = _decay(chance)
    model.k = ((seen["high"] or 0) + 0.5) / clean_tokens * math.exp(model.decay * level)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array([model.evidence(x) for x in batch.column(0).to_pylist()], pa.float64())], names=["toxic", "x"])

    # a number for each of at most `rows` texts, from all their segments
    weighed = sample.select("text", "toxic").mapInArrow(weigh, "toxic int, x double").toArrow()
    model.slope, model.offset = _logistic(weighed["x"].to_numpy(), (weighed["toxic"].to_numpy() == 1).astype(float))
    return model


def _decay(chance: list[tuple[float, float]]) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1."""
    rest = max(0.0, 1 - sum(p for _, p in chance))
    value = lambda x: sum(p * math.exp(min(x * s, 700.0)) for s, p in chance) + rest * math.exp(x * DRIFT) - 1
    low, high = 1e-4, 8.0
    if value(low) >= 0:
        return low
    if value(high) <= 0:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for slope and offset, with Platt's soft targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, np.abs(x).max())
    z, w = x / scale, np.array([0.0, math.log((n1 + 1) / (n0 + 1))])
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score_documents(docs: DataFrame, model: Model, *, passages: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; ``passages`` adds each segment's first and last token and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double" + (", passages array<struct<first:int,last:int,score:double>>" if passages else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), pa.array([own.score(x) for x in texts], pa.float64())]
            names = ["doc_id", "score"]
            if passages:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
                columns.append(pa.array([[{"first": a, "last": b, "score": s} for a, b, s in own.segments(x)[1]] for x in texts], kind))
                names.append("passages")
            yield pa.record_batch(columns, names=names)

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ddl)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["passages"] if passages else []))


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(x or "") < threshold for x in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labelled rows outside the held-out part and score every row."""
    return score_documents(docs, train(docs, labels), **options)
