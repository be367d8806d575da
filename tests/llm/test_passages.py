"""Repeated passages, leaks, licences and toxic segments against plain models."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from linewright.llm import decontamination as D
from linewright.llm import license_scan as L
from linewright.llm import repeated_passages as R
from linewright.llm import toxicity as X

SCHEMA = "doc_id long, text string, n_words string"


def kept(texts, window):
    listed = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in listed for i in range(len(w) - window + 1))
    out = []
    for w in listed:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        stay = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(stay).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    random.seed(1)
    word = lambda: random.choice(["a", "b", "the", "É", "x,"]) + str(random.randint(0, 60))
    shared = [word() for _ in range(80)]
    texts = [None, "", "short text", "x " * 100, " ".join(shared[:35]), " ".join(shared[:34])]
    texts += [" ".join([word() for _ in range(20)] + shared[i : i + 40 + i] + [word() for _ in range(20)]) for i in range(0, 40, 3)]
    texts += [" ".join(word() for _ in range(60))] * 2 + [" ".join(shared) + "\n\n" + " ".join(shared)]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "c") for i, t in enumerate(texts)], SCHEMA)
    for group in (4096, 2):
        found = R.remove_repeats(docs, group=group).collect()
        assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in found) == kept(texts, 35)
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_deep_nodes():
    flags = R.deep_nodes([(b"a b c d", 1), (b"b c d e", 1), (b"x y z", 2)], 3)
    assert [x.tolist() for x in flags] == [[False, True], [True, False], [True]]


def test_leaks(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(500)] + ["the"] * 200
    item = [random.choice(words) for _ in range(40)]
    edited = [x if i % 8 else "new" for i, x in enumerate(item)]
    filler = lambda n: [random.choice(words) for _ in range(n)]
    texts = [(1, filler(50) + item + filler(50)), (2, filler(30) + edited + filler(30)), (3, filler(300)), (4, item[:12] + filler(40)), (5, item + filler(9) + item), (6, ["the"] * 400)]
    docs = spark.createDataFrame([(d, " ".join(w), "c") for d, w in texts] + [(7, None, ""), (8, "", ""), (None, " ".join(item), "")], SCHEMA)
    items = spark.createDataFrame([(10, " ".join(item)), (11, "Only two"), (12, None), (13, ""), (14, "the the the the")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()]
    assert {x for x in found if x[1] == 10} == {(1, 10), (2, 10), (5, 10), (None, 10)} and found.count((5, 10)) == 2
    assert (6, 14) in found and not any(i == 11 for _, i in found)
    clean = {r.doc_id for r in D.drop_leaks(docs, items.where("item_id = 10")).collect()}
    assert clean == {3, 4, 6, 7, 8}
    assert D.find_leaks(docs, items.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), items).count() == 0


def test_edited_copies_of_frequent_leaks(spark):
    """However often an item leaked, copies that lost or changed a part of it are found, wherever the part is."""
    random.seed(3)
    item = lambda k: [f"w{k}x{i}" for i in range(45)]
    filler = lambda n: [f"f{random.randint(0, 10**6)}" for _ in range(n)]
    edits = [lambda x: x[15:], lambda x: x[:30], lambda x: filler(15) + x[15:], lambda x: x[:30] + filler(15), lambda x: x[:15] + filler(12) + x[27:], lambda x: [w if i % 4 else "z" for i, w in enumerate(x)]]
    texts = [[w for k in range(len(edits)) for w in filler(30) + item(k)] for _ in range(1000)]
    texts += [filler(40) + edit(item(k)) + filler(40) for k, edit in enumerate(edits) for _ in range(2)]
    texts += [filler(40) + item(0)[:12] + filler(60), item(1) + filler(30) + item(1)[3:6] + filler(28) + item(1)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(item(k))) for k in range(len(edits))] + [(99, " ".join(filler(20)))], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()]
    want = [(d, k) for d in range(1000) for k in range(len(edits))] + [(1000 + d, d // 2) for d in range(2 * len(edits))]
    assert sorted(found) == want + [(1013, 1), (1013, 1)]
    assert [r.doc_id for r in D.drop_leaks(docs, items).collect()] == [1012]


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    random.seed(4)
    for _ in range(200):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randint(1, 30))) for _ in range(2))
        x, y = D.words(a), D.words(b)
        if len(x) and len(y):
            assert D.align(x, y)[0] == smith_waterman(x.tolist(), y.tolist())


def test_licenses(spark):
    notice = dict(L.TEMPLATES)
    mit = notice["mit"].split()
    mit[20] = "changed"
    texts = [(1, "x " * 77 + notice["mit-notice"] + " y" * 9), (2, "a b " * 40 + " ".join(mit) + " c" * 300), (3, "nothing here at all"), (4, "ALL RIGHTS\nreserved!"), (5, None), (6, "")]
    found = L.scan_licenses(spark.createDataFrame([(d, t, "c") for d, t in texts], SCHEMA)).collect()
    assert {(r.doc_id, r.license_id) for r in found} == {(1, "mit-notice"), (2, "mit"), (4, "all-rights-reserved")}
    assert all(r.containment >= 0.75 for r in found) and [(r.first_word, r.last_word) for r in found if r.doc_id == 1] == [(77, 81)]
    # every place of a passage lies whole in some window
    own = L.Templates([("isc", notice["isc"])])
    assert all(own.matches("z " * n + notice["isc"] + " z" * 50, 1.0) for n in range(70))


def test_licenses_at_every_offset():
    """Every template amid words that occur once; the shortest, which few shingles show, many times."""
    own = L.Templates(L.TEMPLATES)
    number = iter(range(10**9))
    filler = lambda n: " ".join(f"f{next(number)}" for _ in range(n))
    for name, text in L.TEMPLATES:
        size = 1 << (len(L.words(text)) - 1).bit_length()
        for offset in range(size):
            assert name in {x[0] for x in own.matches(f"{filler(offset)} {text} {filler(2 * size)}", 0.75)}
    notice = dict(L.TEMPLATES)["mit-notice"]
    assert not [i for i in range(4000) if not own.matches(f"{filler(16 + i % 8)} {notice} {filler(24)}", 0.75)]


def test_all_windows_of_all_templates(spark):
    """The whole query against every window of every template, without bands and seeds."""
    random.seed(31)
    filler = lambda n: [f"w{random.randint(0, 40)}" for _ in range(n)]
    texts = []
    for _ in range(120):
        own = filler(random.randint(0, 60))
        for _, text in random.sample(L.TEMPLATES, random.randint(0, 3)):
            held = text.split()
            for i in range(random.choice([0, 0, 1, 2, len(held) // 3])):
                held[random.randrange(len(held))] = f"e{i}"
            own += held + filler(random.randint(0, 90))
        texts.append(" ".join(own))
    texts += [None, "", "!!", texts[3], "All rights reserved. " * 50]
    want = set()
    for doc, text in enumerate(texts):
        own = re.findall(r"[^\W_]+", (text or "").lower())
        for name, template in L.TEMPLATES:
            listed = re.findall(r"[^\W_]+", template.lower())
            n, size = min(L.SHINGLE, len(listed)), 1 << (len(listed) - 1).bit_length()
            held = {tuple(listed[i : i + n]) for i in range(len(listed) - n + 1)}
            for start in range(0, max(1, len(own)), size):
                part = own[start : start + 2 * size]
                inside = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
                if len(held & inside) >= 0.75 * len(held):
                    want.add((doc, name))
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert {(r.doc_id, r.license_id) for r in L.scan_licenses(rows).collect()} == want and len({n for _, n in want}) == len(L.TEMPLATES)


def segments(scores):
    """All maximal scoring segments by their recursive definition."""
    def inside(a, b):
        best, at = 0, None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-9:
                    best, at = total, (i, j)
        return [] if at is None else inside(a, at[0]) + [(*at, round(best, 6))] + inside(at[1] + 1, b)
    return inside(0, len(scores))


def test_segments():
    random.seed(5)
    for _ in range(300):
        scores = [random.choice([-1.0, -1.0, -1.0, 1.375, 2.7, 0.61]) for _ in range(random.randint(0, 25))]
        found = X.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.0)
        assert [(a, b, round(s, 6)) for a, b, s in found] == segments(scores)


def test_toxicity(spark):
    random.seed(6)
    plain = ["the", "of", "word", "text", "line", "page", "book", "sun"]
    rows = []
    for i in range(600):
        words = [random.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[random.randrange(30)] = random.choice(["nasty!", "nastily", "vile"])
        rows.append((i, " ".join(words), "c"))
    rows += [(1001, None, ""), (1002, "", ""), (None, "vile vile", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in X.toxicity(docs, labels, passages=True).collect()}
    held = [r for r in found.values() if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id < 1000)
    assert found[1001].predicted == 0 and found[1002].score == found[1001].score and found[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in found.values()) and found[4].passages
    model = X.train(docs, labels)
    assert X.keep_clean(docs, model).count() == sum(1 - r.predicted for r in found.values())
    assert {r.score for r in X.toxicity(docs, labels.limit(0)).collect()} == {X.Model().score("")}


def test_subtree():
    """The nodes are the runs of words that occur twice or more and can't be longer on the right; maximal ones differ on the left."""
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        suffixes = [(t[i:], t[i - 1] if i else None, 1) for t in texts for i in range(len(t))]
        order, nodes = R.subtree(suffixes, 2)
        found = {tuple(suffixes[order[n.first]][0][: n.depth]): (n.last - n.first + 1, n.maximal) for n in nodes}
        want = {}
        for run in {tuple(s[:k]) for s, _, _ in suffixes for k in range(2, len(s) + 1)}:
            held = [(s, left) for s, left, _ in suffixes if tuple(s[: len(run)]) == run]
            if len(held) > 1 and (len({s[len(run)] if len(s) > len(run) else None for s, _ in held}) > 1 or any(len(s) == len(run) for s, _ in held)):
                want[run] = (len(held), len({left for _, left in held}) > 1 or None in {left for _, left in held})
        assert found == want
