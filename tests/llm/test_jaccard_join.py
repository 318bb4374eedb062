"""Links and components against all pairs."""

import ctypes
import random
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from cases import ROWS, collected, documents, random_texts

from pyspark.sql import functions as F

from buildscope.llm import jaccard_join
from buildscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def plain(rows, size, least):
    """Rows with their component's least id; rows are told apart by position."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(key, ids.get(find(i), key))
    return sorted(((key, len(s), ids.get(find(i))) for i, (key, s) in enumerate(zip([k for k, _ in rows], sets))), key=repr)


def family(number, seed):
    """Groups of near copies: each copy of a base with some words changed."""
    draw = random.Random(seed)
    texts = []
    for base in random_texts(6, seed, words=60):
        words = base.split() or ["w"]
        for _ in range(number):
            copy = list(words)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(["Zz", "QQ", "a\tb"])
            texts.append((" " if draw.random() < 0.5 else "\n").join(copy))
    return texts


def answer(spark, rows, size, least):
    return collected(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), size=size, least=least).drop("h1", "label"))


@pytest.mark.parametrize(("size", "least"), [(4, 85), (5, 80), (2, 60)])
def test_against_all_pairs(spark, size, least):
    rows = [(1000 - i, t) for i, t in enumerate(family(14, size) + random_texts(80, words=9))]
    assert answer(spark, rows, size, least) == plain(rows, size, least)


@pytest.mark.parametrize("rounds", [0, 1])
def test_pairs_between_components_in_blocks(spark, monkeypatch, rounds):
    """With fewer leaders and blocks of three members the rest of the pairs is still complete."""
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = list(enumerate(family(10, 21)))
    assert answer(spark, rows, 3, 80) == plain(rows, 3, 80)


def test_links_at_the_threshold(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:103])), (2, " ".join(words[:88])), (3, " ".join(words[:87]))]  # 100, 85 and 84 shingles
    assert answer(spark, rows, 4, 85) == [(1, 100, 1), (2, 85, 1), (3, 84, 1)]
    assert answer(spark, [rows[0], rows[2]], 4, 85) == [(1, 100, 1), (3, 84, 3)]


def test_odd_rows(spark):
    rows = [(k, t) for k, t, _ in ROWS]
    assert collected(jaccard_join.join(documents(spark), size=4, least=85).drop("h1", "label")) == plain(rows, 4, 85)
    assert jaccard_join.join(documents(spark, []), size=4, least=85).count() == 0


def test_components_of_long_paths_and_stars(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    draw.shuffle(links)
    labels = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_near_copies_give_few_pairs(spark):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(2):
            words[draw.randrange(len(words))] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "id long, text string")
    described = jaccard_join.describe(docs, 5, 80).cache()
    members = jaccard_join.prefix_groups(described).withColumn("label", F.col("class"))
    assert jaccard_join.star_pairs(members, 80, 0).count() <= 4 * len(rows)


def test_pairs_just_below_the_similarity_grow_with_the_members(spark, monkeypatch):
    """Near copies about the threshold: few pairs for each member in all rounds, and the same components as by all pairs."""
    draw = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(draw.choice([1, 2, 2, 2, 2])):
            words[draw.randrange(len(words))] = f"x{i} {draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    counts, real = [], jaccard_join.verified

    def counted(pairs, sets, least):
        counts.append(pairs.count())
        return real(pairs, sets, least)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    assert answer(spark, rows, 4, 85) == plain(rows, 4, 85)
    assert sum(counts) <= 20 * len(rows), counts


def test_drawn_pairs_are_those_of_least_draw_in_both_directions():
    ends = [(0, 0, 0, c, c, 100, 0) for c in range(40)]
    numbers, parts = jaccard_join.np.array(ends).T, jaccard_join.np.zeros((40, jaccard_join.PARTS), "int16")
    every = {tuple(p) for p in jaccard_join._cross(numbers, parts, 85, None, 1).T.tolist()}
    assert every == {(a, b) for b in range(40) for a in range(b)}
    for cells in (1, 1 << 14):
        jaccard_join.CELLS, before = cells, jaccard_join.CELLS
        few = {tuple(p) for p in jaccard_join._cross(numbers, parts, 85, 3, 1).T.tolist()}
        jaccard_join.CELLS = before
        assert few < every and len(few) <= 2 * 3 * 40
        assert all(sum(c in p for p in few) >= 3 for c in range(40))


def worker_memory(spark):
    """MB of memory of its own in the largest worker."""

    def run(batches):
        for batch in batches:
            own = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
            time.sleep(0.05)  # so that all workers take part
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, own)) / 1024] * batch.num_rows)], ["mb"])

    return spark.range(0, 16, 1, 16).mapInArrow(run, "mb double").agg(F.max("mb")).first()[0]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="memory goes back by the GNU library")
def test_workers_keep_no_memory(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(1_400)), lambda i: F.xxhash64("id", i).cast("string"))
    texts = spark.range(0, 8_000, 1, 8).select("id", F.concat_ws(" ", words).alias("text"))
    before = worker_memory(spark)
    jaccard_join.describe(texts, 5, 80).write.format("noop").mode("overwrite").save()
    assert worker_memory(spark) < max(before, 135)
