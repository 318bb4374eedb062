"""Fingerprints against the same sampling in plain Python, and against the similarity they estimate."""

import hashlib
import math
import re
import struct
from collections import Counter

import xxhash
from cases import ROWS, collected, documents, random_texts

from buildscope.llm import fingerprints as f


def _hash(kind, value, seed):
    return xxhash.xxh64_intdigest(struct.pack(kind, value), seed)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    words = Counter(w for w in re.split("[ \t\n\x0b\f\r]+", text) if w)
    if not words:
        return f.EMPTY
    uniform = lambda x: ((x & 0xFFFFFFFF) + 0.5) / 4294967296.0
    least = [None] * f.SAMPLES
    for word, weight in words.items():
        term = _signed(xxhash.xxh64_intdigest(word.encode(), 42))
        for k in range(f.SAMPLES):
            bits = [_hash("<i", f.SEED + 3 * k + i, _hash("<q", term, 42)) for i in range(3)]
            r = -math.log(uniform(bits[0]) * uniform(bits[0] >> 32))
            ln_c = math.log(-math.log(uniform(bits[1]) * uniform(bits[1] >> 32)))
            b = uniform(bits[2])
            t = math.floor(math.log(weight) / r + b)
            sample = (math.floor((ln_c - r * (t - b) - r) * f.STEPS) << 32) + (_hash("<q", t, _hash("<q", term, 42)) & 0xFFFFFFFF)
            least[k] = sample if least[k] is None else min(least[k], sample)
    return "".join("%04x" % (s & 0xFFFF) for s in least)


def alike(a, b):
    if f.EMPTY in (a, b):
        return float(a == b)
    return sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(f.SAMPLES)) / f.SAMPLES


def plain(rows):
    """For rows with distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, edited, nexts = map(plain_fingerprint, (text, changed, following))
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, edited, alike(own, edited), alike(own, nexts)))
    return sorted(out, key=repr)


def test_against_plain(spark):
    rows = [(7 * i - 100, t) for i, t in enumerate([*random_texts(60), "", None, "  \n", "🙂é " * 9, "one " * 40])]
    found = f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(found) == plain(rows)


def test_one_row_and_none(spark):
    assert collected(f.fingerprints(documents(spark, [(1, "alone here", "en")]))) == plain([(1, "alone here")])
    assert f.fingerprints(documents(spark, [])).count() == 0


def test_odd_rows(spark):
    found = f.fingerprints(documents(spark)).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in found if r.doc_id is not None) == sorted((k, plain_fingerprint(t or "")) for k, t, _ in ROWS if k is not None)
    assert len(found) == len(ROWS)


def test_collisions_follow_generalised_jaccard(spark):
    rows = []
    for i in range(40):
        shared = [f"s{i}_{j}" for j in range(60)]
        rows += [(2 * i + 1, " ".join(shared + [f"a{i}_{j}" for j in range(20)])), (2 * i, " ".join(shared * 2 + [f"b{i}_{j}" for j in range(20)]))]
    found = {r.doc_id: r.near_next for r in f.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mean = sum(found[2 * i + 1] for i in range(40)) / 40
    # sum(min) = 60, sum(max) = 120 + 20 + 20
    assert abs(mean - 60 / 160) < 0.05


def test_no_python_and_no_shuffle_of_words(spark):
    rows = f.ordered(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), "doc_id")
    plan = f.samples_of(rows, ["range", "place"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


def test_text_ids_and_a_hot_id(spark):
    texts = random_texts(90, seed=11, words=20)
    rows = [(f"doc-{i:03d}", t) for i, t in enumerate(texts)]
    assert collected(f.fingerprints(spark.createDataFrame(rows, "doc_id string, text string"))) == [r for r in plain_by_text(rows)]
    hot = spark.createDataFrame([(5, f"text {i} of the hot id") for i in range(300)] + [(i, "other") for i in range(20)], "doc_id long, text string")
    placed = f.ordered(hot.select("doc_id", "text"), "doc_id")
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert sum(sizes) == 320 and max(sizes) < 60
    assert sorted(r.place for r in placed.collect()) == list(range(320))


def plain_by_text(rows):
    number = {key: i for i, key in enumerate(sorted(k for k, _ in rows))}
    names = {i: key for key, i in number.items()}
    return sorted(((names[r[0]], *r[1:]) for r in plain([(number[k], t) for k, t in rows])), key=repr)
