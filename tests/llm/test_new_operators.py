"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import fill_in_middle as M
from linewright.llm import interpolation as I
from linewright.llm import spelling_variants as V

DATA = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, n long, form string, word string"


def made(spark, rows):
    """Documents with further columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "\0é\U0001f600 é\r\n"), (6, "has <P> in it"), (7, "ends <M>"), (8, "<p> < P> <S"), (None, "no id at all, none"), (9, "same"), (9, "same"), (10, ">" * 7 + "<" * 7), (11, "lang é " * 60_000)]


def cut(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return (doc_id, n, form, a, b - a, output, text)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_fill_in_middle(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DATA).collect()] + EDGES
    docs = made(spark, rows).repartition(3)
    wanted = [cut(*r) for r in rows]
    for size in (1, 10_000, M.SLICE_BYTES):
        assert ordered(M.fill_in_middle(docs, slice_bytes=size).collect()) == ordered(wanted)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert ordered(M.fill_in_middle(docs, columns=M.DIGESTS).collect()) == ordered((*w[:5], digest(w[5]), digest(w[6])) for w in wanted)
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(made(spark, [])).count() == 0
    assert {r["form"] for r in M.fill_in_middle(made(spark, [(i, "some text") for i in range(50)]), plain=0, spm=100).collect()} == {"spm"}
    with pytest.raises(ValueError, match="seed"):
        M.fill_in_middle(docs, seed="x'")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def scored(rows, weights):
    """The definition: counts of training documents and the mixture with given weights."""
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    docs = [(i, [w for w in re.split("[\x20\x09-\x0d]+", lower(t or "")) if w] + [None]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in docs:
        if crc(i) % 7 != 2:
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for i, w in docs:
        score = 0.0
        for before, x in zip([None, *w], w, strict=False):
            a = weights[one[before].bit_length()]
            score += math.log10(a[0] * (two[before, x] / one[before] if one[before] else 0) + a[1] * one[x] / max(n, 1) + a[2] / (v + 1))
        out.append((i, crc(i) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def same_scores(found, wanted):
    found, wanted = (sorted((tuple(r) for r in x), key=lambda r: str(r[:5]) + f"{r[5]:.6f}") for x in (found, wanted))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9)


@pytest.mark.parametrize("sizes", [{"block_bytes": 20_000, "shard_keys": 500}, {}])
def test_interpolated_scores(spark, sizes, monkeypatch):
    monkeypatch.setattr(I, "PIECE_BYTES", 10_000)
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DATA).collect()] + EDGES[:-1] + [(500, long), (501, "x" * 50_000), (502, "\x0bÉ\x0c\x85\xa0A B")]
    model = I.train(made(spark, rows).repartition(3), **sizes)
    found = I.score(model).collect()
    same_scores(found, scored(rows, model.weights))
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # the pair, token and uniform estimates add up to one over all tokens and an unknown one
    assert np.allclose(model.weights.sum(1), 1) and (model.weights[:, 2] > 0).all() and model.weights[0, 0] == 0


def test_interpolation_without_training(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = I.interpolated_scores(made(spark, [(i, "a b") for i in held])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found] == [(3, 0, 0, 0.0, 0.0)] * len(held)
    assert I.interpolated_scores(made(spark, [])).count() == 0
    one = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(I.interpolated_scores(made(spark, [(one, "a b"), (one, "a b")])).collect()) == 2


def test_weights_by_expectation_maximisation():
    """The weights' likelihood is that of a fine search, and the cells' rounding costs little."""
    rng = np.random.default_rng(5)
    context = np.repeat([3, 9], 500)
    pair, single, times = rng.choice([0.0, 1.0, 50.0, 4000.0], 1000), rng.choice([0.0, 1.0, 8.0, 300.0], 1000), rng.integers(1, 50, 1000).astype(float)
    weights = I.learn(context, pair, single, times, 400)
    for c in (3, 9):
        own = context == c
        likely = lambda w: float((times[own] * np.log(w[0] * pair[own] + w[1] * single[own] + w[2])).sum())  # noqa: B023, E731
        best = max(likely((a / 100, b / 100, (100 - a - b) / 100)) for a in range(100) for b in range(100 - a))
        assert likely(weights[c]) > best - 0.5


def test_deleted_cells(spark):
    """The cells count every token of the deleted documents once."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DATA).collect()]
    model = I.train(made(spark, rows))
    deleted = sum(len(re.findall("[^\x20\x09-\x0d]+", t)) + 1 for i, t in rows if I.part_of(i) == I.DELETED_PART)
    total = model.replies.count()
    assert total and I.cells(model.held, model.replies, model.n, model.v).agg(F.sum("times")).first()[0] == deleted > 0


def near_words(word, others):
    letters = sorted({c for w in others for c in w})
    edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
    edits |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for k in (0, 1) if i + k <= len(word) for c in letters}
    return [w for w in edits - {word} if w in others]


def variants(rows, least=3):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    near = {w: near_words(w, n) for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


@pytest.mark.parametrize("sizes", [{}, {"shard": 500, "part": 40}, {"shard": 50, "part": 7}])
def test_spelling_variants(spark, sizes):
    rng = random.Random(2)
    small = " ".join("".join(rng.choices("abÀé", k=rng.randrange(3, 9))) for _ in range(6000))
    chain = "abcdef " * 40 + "abcdeg " * 20 + "abcdhg " * 10 + "abckhg " * 5
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DATA).collect()] + EDGES + [(400, small), (401, small.upper()), (402, chain), (402, chain), (403, "×÷×÷× " * 5)]
    found = V.spelling_variants(made(spark, rows).repartition(3), **sizes)
    assert ordered(found.select("word", "form", "root", "n", "n_near", "form_n").collect()) == ordered(variants(rows))


def test_spelling_without_words(spark):
    assert V.spelling_variants(made(spark, [])).count() == 0
    assert V.spelling_variants(made(spark, EDGES[:4])).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        V.spelling_variants(made(spark, []), ratio=1)


def test_automaton():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(400)})
    automaton = V.Automaton(words)
    assert len(automaton) == len(words) and len(automaton.edges) < sum(map(len, words)) / 3
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert [automaton.word(i) for i in range(len(words))] == words
    assert automaton.number("abcabcabc") is None and automaton.number("") is None
    for word in words:
        half = len(word) // 2
        wanted = {w for w in near_words(word, set(words)) if w.startswith(word[:half])}
        assert {automaton.word(i) for i in automaton.near(word[:half], word[half:])} == wanted
    assert len(V.Automaton([])) == 0 and V.Automaton([]).near("", "a") == set()
