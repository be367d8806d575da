"""Recall of the searches against exhaustive ones, and the pipeline's edge cases."""

from __future__ import annotations

import random

from linewright.llm import decontamination as D
from linewright.llm import near_duplicates as N


def test_leaks_found(spark):
    """Of the edited copies that exhaustive alignment finds, nine in ten at least are found at every edit rate, and no other."""
    rng = random.Random(3)
    common = ["of", "the", "in", "and", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.choice([8, 15, 40]))] for _ in range(12)]
    docs, rates = [], {}
    for k in range(480):
        rate, item = (0, 0.1, 0.2, 0.3, 0.4)[k % 5], rng.randrange(len(items))
        copy = []
        for w in items[item]:
            x = rng.random()
            copy += [] if x < rate / 3 else [word()] if x < 2 * rate / 3 else [w, word()] if x < rate else [w]
        docs.append((k, " ".join([word() for _ in range(30)] + copy + [word() for _ in range(30)])))
        rates[k] = rate
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(texts, table).collect()}
    own = [D.words(" ".join(x)) for x in items]
    want = {(k, i) for k, text in docs for i, w in enumerate(own) if D.align(w, D.words(text))[0] >= D.LEAST_SCORE * D.MATCH * len(w)}
    assert found <= want
    for rate in set(rates.values()):
        part = {x for x in want if rates[x[0]] == rate}
        assert len(part) > 10 and len(found & part) >= 0.9 * len(part)


def brute_rows(rows):
    """One row of each component of near-duplicates, by all pairs."""
    sets = [N.word_shingles("".join(c.lower() if c.isascii() else c for c in t or "")) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    names = {}
    for (doc, _), g, s in zip(rows, group, sets, strict=True):
        if s:
            names.setdefault(g, []).append((doc is None, doc))
    return sorted([min(x)[1] for x in names.values() if not min(x)[0]]), sum(min(x)[0] for x in names.values()), sum(not s for s in sets)


def test_rows_that_share_an_id(spark):
    """Duplicates go by row: one that only shares an id stays, repeated rows leave one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (7, None), (7, None), (8, ""), (9, a + " more")]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, lw_row string, cls int")
    out = N.one_of_each(docs)
    kept = out.collect()
    ids, nameless, empty = brute_rows(rows)
    assert out.columns == docs.columns and {r.lw_row for r in kept} == {"x"}
    with_words = [r for r in kept if r.text]
    assert sorted(r.doc_id for r in with_words if r.doc_id is not None) == ids == [3, 5]
    assert sum(r.doc_id is None for r in with_words) == nameless == 1 and len(kept) - len(with_words) == empty == 3
    assert {r.text for r in with_words} == {a, b, c}
    assert N.one_of_each(docs.limit(0)).count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Repeated ids, nulls, further columns and empty tables pass through every stage."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (None, None), (6, ""), (7, "mail x.y@example.org")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, lw_id string")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    for part, want in ((docs, [(3, a), (5, b), (6, ""), (7, None), (None, None)]), (docs.limit(0), [])):
        out = part
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{len(want)}")
            out = spark.read.parquet(f"{tmp_path}/{name}{len(want)}")
            assert out.columns == docs.columns
        key = lambda x: (x[0] is None, x[0] or 0)
        found = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
        assert [x[0] for x in found] == [x[0] for x in want] and [x[1] for x in found if x[0] != 7] == [x[1] for x in want if x[0] != 7]
        assert all("x.y@" not in (t or "") for _, t in found)
        assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == len(want)
