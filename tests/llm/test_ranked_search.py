"""Ranking against plain scores of all pairs, and bounds against scores."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from cases import ROWS, collected, documents, random_texts

from buildscope.llm import ranked_search as s


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-/:-@\\[-`{-\x7f]+", lowered)


def plain(docs, items, k=10):
    counted = [(key, Counter(words(t))) for key, t in docs]
    counted = [(key, c) for key, c in counted if c]
    number, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(words(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for key, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * number) // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    index = s.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    return collected(s.search(index, spark.createDataFrame(items, "item_id long, text string"), k))


def test_against_all_pairs(spark):
    docs = list(enumerate(random_texts(400, words=30), 1))
    items = list(enumerate(random_texts(25, seed=8, words=9)))
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, 3) == plain(docs, items, 3)


def test_ties_copies_and_letters(spark):
    docs = [(i, "Same Words HERE über") for i in range(60, 0, -1)] + [(None, "same words here über"), (100, "ÜBER same"), (101, "words words words")]
    items = [(1, "same here"), (2, "über"), (3, "nothing known"), (4, None), (5, ""), (None, "words"), (1, "WORDS"), (1, "same here")]
    expected = plain(docs, items)
    assert found(spark, docs, items) == expected
    assert [r for r in expected if r[0] == 1][0][2] == 1


def test_odd_rows(spark):
    items = [(1, "quick lazy dog word3 alpha7"), (2, "日本語"), (3, "12 34 text id")]
    index = s.build_index(documents(spark))
    assert collected(s.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain([r[:2] for r in ROWS], items)
    assert s.search(index, spark.createDataFrame([], "item_id long, text string")).count() == 0
    empty = s.build_index(documents(spark, []))
    assert s.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_slices_give_the_same(spark, monkeypatch):
    docs = list(enumerate(random_texts(100, words=20), 1))
    items = list(enumerate(random_texts(12, seed=4, words=9)))
    monkeypatch.setattr(s, "SLICE_CHARS", 60)
    monkeypatch.setattr(s, "BLOCK", 16)
    assert found(spark, docs, items) == plain(docs, items)


def test_text_ids(spark):
    docs = [(f"doc-{i % 7}", "alpha beta") for i in range(20)]
    index = s.build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    got = s.search(index, spark.createDataFrame([("a", "alpha")], "item_id string, text string"), 4).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [("a", i, "doc-0") for i in (1, 2, 3)] + [("a", 4, "doc-1")]


def test_bounds_are_never_below_scores():
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    terms = np.unique(s.hashes(vocabulary))
    weights = np.array([draw.randint(0, 20_000) for _ in terms], np.int64)
    matrix = weights[:, None] * float(s.STEP)
    for size in (1, 5, 80, 1500):
        counted = Counter(draw.choices(vocabulary, k=size))
        hashed = s.hashes(list(counted))
        counts = np.fromiter(counted.values(), np.int64)
        order = np.argsort(hashed)
        hashed, counts = hashed[order], counts[order]
        m = 10 + size
        held = np.isin(terms, hashed)
        score = int((weights[held] * s.impacts(counts, m)).sum())
        bound = s.bounds_of([s.sketch(hashed, s.impacts(counts, m)).tobytes()], np.array([m]), s.Queries(terms, weights, []), matrix)
        assert score <= bound[0, 0] < 3 * score + weights.sum() * 1e5
