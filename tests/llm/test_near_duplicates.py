"""Near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np

from linewright.llm import near_duplicates as N

SCHEMA = "doc_id long, text string, component_id string, kept int"


def brute(rows):
    sets = [N.word_shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(sets[i]), least.get(top(i))) for i, (doc, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    found = N.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    check(spark, [(5, None), (4, ""), (3, " \n\t"), (9, "one two"), (2, "One  TWO"), (7, "one two three four five"), (8, "é É"), (1, "É é"), (6, long), (6, long), (None, long), (10, long + " w40"), (11, "a " * 3000)])


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_and_strays(spark):
    """Copies that drift apart: links that no bucket's representative has, and near misses."""
    random.seed(3)
    rows, doc = [], 100
    for _ in range(4):
        words = [random.choice("abcdefghij") + str(random.randint(0, 999)) for _ in range(120)]
        for _ in range(25):
            rows.append((doc, " ".join(words)))
            doc = doc + 1 if doc % 3 else doc + 7
            for _ in range(random.choice([1, 1, 2, 4])):
                words[random.randrange(len(words))] = str(random.random())
    random.shuffle(rows)
    check(spark, rows)


def test_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        n = 600
        common = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        x, y = pool[:n], pool[n - common :]
        errors = []
        left, right = N.registers(x), N.registers(y)
        errors.append(N.estimate(left, right, N.accidental(np.array([n]), np.array([n]))[0]) - share)
        assert abs(errors[0]) < 0.14
    small = N.accidental(np.array([10, 1000]), np.array([10, 1000]))
    assert (small > 0).all() and (small < 0.01).all()


def test_rows_repeated_many_times(spark):
    """Two near classes of ten thousand rows each, without ids and with one: work follows the rows, not their product."""
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(None, one), (7, one + " end"), (7, one + " end"), (9, "some other text of its own")] + [(None, one), (5, one + " end")] * 10_000
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4)
    found = N.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(((r.doc_id, r.component_id, r.kept, r["count"]) for r in found), key=key) == [(5, 5, True, 10_000), (7, 5, False, 2), (9, 9, True, 1), (None, 5, False, 10_001)]
    left = N.one_of_each(docs).select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in left) == [(5, one + " end"), (9, "some other text of its own")]


def test_which_of_equal_rows_stays(spark):
    """Rows that repeat id and text but differ elsewhere: the same one stays in any order of the input."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, str(i), i) for i in range(20)], SCHEMA)
    once = [tuple(N.one_of_each(d).select("doc_id", "kept").first()) for d in (docs, docs.orderBy(docs["kept"].desc()), docs.repartition(7))]
    assert len(set(once)) == 1
