"""The whole toxicity query against its definition: weights, law, segments, curve and decisions."""

from __future__ import annotations

import math
import random
import zlib
from statistics import median

import numpy as np

from linewright.llm import registry


def features(token):
    word = token.lower().strip(".,;:!?\"'()[]{}<>|*#$%&-_«»¿¡")
    return {word} | {f"{n}{word[:n]}" for n in range(4, 9) if len(word) > n} if word else set()


def maximal(scores):
    """The best segment (the first and shortest of equals) and those of what lies on either side."""
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[2]
    return maximal(scores[:i]) + [best[0]] + maximal(scores[j:])


def root(f, low, high):
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return low


def definition(sample):
    n = [sum(y == k for _, y in sample) for k in (0, 1)]
    count = {}
    for text, y in sample:
        for f in set().union(*map(features, text.split()), set()):
            count.setdefault(f, [0, 0])[y] += 1
    weight = {}
    for f, (c, t) in count.items():
        a = 20 * (t + c) / sum(n)
        odds = lambda k, total, a=a: math.log((k + a) / (total + 20 - k - a))
        w, e = odds(t, n[1]) - odds(c, n[0]), math.sqrt(1 / (t + a) + 1 / (c + a))
        if w / e >= 3 and w - e >= 1.5 and t >= 3:
            weight[f] = w - e, c
    segments = lambda text: maximal([max((weight[f][0] for f in features(x) if f in weight), default=-1.0) for x in text.split()])
    clean = [text for text, y in sample if y == 0]
    tokens = sum(len(x.split()) for x in clean)
    chance = [(w, (c + 0.5 / len(weight)) / tokens) for w, c in weight.values()]
    rest = 1 - sum(p for _, p in chance)
    decay = root(lambda x: sum(p * math.exp(x * w) for w, p in chance) + rest * math.exp(-x) - 1, 1e-4, 8.0)
    level = median(w for w, _ in weight.values())
    k = (sum(s >= level for x in clean for s in segments(x)) + 0.5) / tokens * math.exp(decay * level)
    evidence = lambda text: math.log1p(sum(math.exp(min(60, decay * s - math.log(k * len(text.split())))) for s in segments(text)))
    x = np.array([[evidence(t), 1.0] for t, _ in sample])
    target = np.array([(n[1] + 1) / (n[1] + 2) if y else 1 / (n[0] + 2) for _, y in sample])
    w = np.zeros(2)
    for _ in range(200):  # small steps of Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - target))
    return weight, lambda text: 1 / (1 + math.exp(-(w[0] * evidence(text) + w[1])))


def test_whole_query(spark, tmp_path):
    random.seed(12)
    words = ["".join(random.choice("abdeiklmnorstu") for _ in range(random.randint(2, 9))) for _ in range(3000)]
    bad = ["grumble", "grumbled", "Grumbling!", "zounds", "vexes", "vexed.", "fie"]
    text = lambda toxic: " ".join(random.choice(bad) if toxic and random.random() < 0.25 or random.random() < 0.004 else random.choice(words) for _ in range(random.randint(8, 40)))
    toxic = {i for i in range(200) if random.random() < 0.35}
    rows = [(i, text(i in toxic and random.random() < 0.9), "x") for i in range(230)]
    rows += [rows[3], rows[3], (300, rows[4][1], "x"), (301, "", "x"), (302, None, "x"), (303, "  \n ", "x"), (None, rows[5][1], "x"), (304, " ".join(words) + " grumble vexed zounds fie", "x")]
    labels = [(i, int(i in toxic)) for i in range(200)] + [(None, 1), (7, int(7 in toxic)), (302, 1), (999, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    apart = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    label = {i: y for i, y in labels if i is not None and not apart(i)}
    weight, score = definition(sorted({(t, label[i]) for i, t, _ in rows if i in label and t is not None}))
    assert {"grumble", "4grum", "vexed"} <= weight.keys()
    found = registry.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    # ids repeat only with equal texts
    texts = {i: t for i, t, _ in rows}
    for r in found:
        want = score(texts[r.doc_id] or "") if r.doc_id != 304 else None
        assert want is None or abs(r.score - want) < 2e-3
        assert r.predicted == int(r.score >= 0.3) and r.held_out == apart(r.doc_id)
    known = [r for r in found if r.held_out and r.doc_id < 200]
    assert sum(r.predicted == (r.doc_id in toxic) for r in known) > 0.8 * len(known)
    spark.createDataFrame([], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {r.predicted for r in registry.op7_toxicity(spark, str(tmp_path)).collect()} == {0}
