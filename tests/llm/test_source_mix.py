"""Targets, words taken and positions against a plain mix of sorted lists and integrals by small steps."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from cases import ROWS, collected, documents, random_texts
from pyspark.sql import functions as F

from buildscope.llm import source_mix as s
from buildscope.llm.workload import words_taken


def plain_targets(sizes, weights, share, most):
    """Deals again until no source is above its limit."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    limit = {x: most * sizes[x] for x in order}
    stopped: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(limit[x] for x in stopped)
        open_ = [x for x in order if x not in stopped]
        dealt = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        above = {x for x in open_ if dealt[x] > limit[x] * (1 + 1e-12)}
        if not above:
            return {**{x: limit[x] for x in stopped}, **dealt}
        stopped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_taken(rows, share=1.5, most=2.0):
    """(id, size, source_size, target, taken) of rows (id, text, source)."""
    by_source = defaultdict(list)
    copies = Counter()
    for key, text, source in rows:
        th = hashlib.md5((text or "").encode()).hexdigest()
        j = copies[(key, th, source)]
        copies[(key, th, source)] += 1
        digest = hashlib.md5(f"13:{'' if key is None else key}:{th}:{j // s.BLOCK}".encode()).hexdigest()
        by_source[source].append((digest, words(text), th, j, key))
    sizes = {x: sum(r[1] for r in found) for x, found in by_source.items()}
    target = plain_targets(sizes, (3, 1, 2), share, most)
    out = []
    for source, found in by_source.items():
        found.sort(key=lambda r: r[:4])
        taken, left = [0] * len(found), math.floor(target[source] + 1e-9)
        for _ in range(math.ceil(most)):
            for i, row in enumerate(found):
                taken[i] += min(row[1], left)
                left -= min(row[1], left)
        out += [(row[4], row[1], sizes[source], target[source], t) for row, t in zip(found, taken)]
    return out


def rows_of(number, seed, sources):
    return [(i, t, sources[(i * i + i // 3) % len(sources)]) for i, t in enumerate(random_texts(number, seed=seed, words=25))]


def compare(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string") if docs is None else docs
    found = words_taken(docs).collect()
    key = lambda r: (repr(r[0]), r[1], r[2], r[4])
    got, expected = sorted(map(tuple, found), key=key), sorted(plain_taken(rows), key=key)
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    return found


@pytest.mark.parametrize("sources", [["a"], ["a", "b", "c"], ["x", None, "y", "z", "Ä", "b", "", "c"]])
def test_taken(spark, sources, monkeypatch):
    monkeypatch.setattr(s, "RANGE_ROWS", 20)  # several ranges for each source
    found = compare(spark, rows_of(500, 3, sources))
    for source_size, target in {(r.source_size, r.target) for r in found}:
        own = [r for r in found if r.target == target and r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - target) < 1 + 1e-6
        assert all(r.taken <= 2 * r.size for r in own)


def test_hot_source_and_copies(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 16)
    monkeypatch.setattr(s, "RANGE_ROWS", 30)
    rows = [(None, "same text again", "hot")] * 300 + [(7, "seven", "hot")] * 50 + rows_of(200, 5, ["hot", "b", "c"]) + [(i, "", "none") for i in range(5)]
    compare(spark, rows)


def test_odd_rows(spark):
    docs = documents(spark).withColumn("source", F.col("lang"))
    compare(spark, [(k, t, x) for k, t, x in ROWS], docs)
    assert words_taken(documents(spark, []).withColumn("source", F.col("lang"))).count() == 0
    nothing = words_taken(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string"))
    assert [tuple(r)[1:] for r in nothing.collect()] == [(0, 0, 0.0, 0, None)] * 2


@pytest.mark.parametrize("schedule", [*s.SCHEDULES, ((0.0, 0.0), (0.2, 3.0), (0.9, 0.0), (1.0, 1.0))])
def test_positions_invert_the_integral(spark, schedule):
    def weight(t):
        (t0, w0), (t1, w1) = next(p for p in zip(schedule, schedule[1:]) if t <= p[1][0])
        return w0 + (w1 - w0) * (t - t0) / (t1 - t0)

    steps = 20_000
    sums = [0.0]
    for i in range(steps):
        sums.append(sums[-1] + weight((i + 0.5) / steps) / steps)
    parts = [i / 50 for i in range(51)]
    found = [r.t for r in spark.createDataFrame([(p,) for p in parts], "p double").select(s.position(F.col("p"), schedule).alias("t")).collect()]
    assert found == sorted(found) and found[0] == 0
    for part, t in zip(parts, found):
        assert sums[round(t * steps)] == pytest.approx(part * sums[-1], abs=2e-4)


def test_order_follows_the_schedules(spark):
    docs = spark.createDataFrame([(i, "one two three four", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    order = s.training_order(s.mix(docs))
    rows = order.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    half = [r for r in rows if r.position < 0.5]
    share = {x: sum(r.words for r in half if r.source == x) / sum(r.words for r in rows if r.source == x) for x in "abc"}
    # Integrals up to the half: even 1/2; rising 0.4167 of 1.125; falling 0.75 of 1.0625.
    assert share["a"] == pytest.approx(0.5, abs=0.01)
    assert share["b"] == pytest.approx((0.25 + 0.25 / 1.5 / 2 * 2) / 1.125, abs=0.02)
    assert share["c"] == pytest.approx(0.75 / 1.0625, abs=0.01)
    assert {r["pass"] for r in rows} == {0, 1}


def test_reruns_and_partitions_agree(spark):
    rows = rows_of(300, 8, ["a", "b", None])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert collected(words_taken(docs)) == collected(words_taken(docs.repartition(7, "text")))


def test_no_python_and_refusals(spark):
    docs = spark.createDataFrame(rows_of(20, 1, ["a"]), "doc_id long, text string, source string")
    assert "Python" not in words_taken(docs)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        s.mix(docs, most=1.0)
    with pytest.raises(ValueError):
        s.mix(docs, schedules=[((0.0, 1.0), (0.5, 0.0), (0.7, 0.0), (1.0, 1.0))])
