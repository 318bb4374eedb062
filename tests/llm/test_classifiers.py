"""Language and quality classifiers: held-out accuracy, folds, odd rows."""

import os
import zlib

import numpy as np
import pytest
from cases import ROWS, documents

from buildscope.llm import language_id, quality
from buildscope.llm.samples import labelled_sample
from buildscope.llm.workload import QUERIES

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    return {r.doc_id: r for r in docs.join(labels, "doc_id", "left").collect()}


def fold(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def test_language_of_held_out_documents(spark, truth):
    found = QUERIES["op4_language_id"](spark, SF).collect()
    assert len(found) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) <= 0.005 * len(found)


def test_quality_of_held_out_documents(spark, truth):
    found = QUERIES["op6_quality"](spark, SF).collect()
    assert len(found) == len(truth) and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in found)
    held = [r for r in found if r.held_out and truth[r.doc_id].quality is not None]
    assert sum(r.predicted == truth[r.doc_id].quality for r in held) >= 0.95 * len(held)
    good = [r.score for r in held if truth[r.doc_id].quality == 1]
    bad = [r.score for r in held if truth[r.doc_id].quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    model = language_id.train(docs)
    assert model.labels == ["de", "en", "fr"]
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(ROWS)
    lettered = {k for k, t, _ in ROWS if t and any(c.isalpha() for c in t)}
    for row in found:
        if row.doc_id is not None and row.doc_id not in lettered:
            assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
        elif row.doc_id is not None:
            assert row.lang_pred in model.labels and 0 < row.score <= 1
    kept = language_id.keep_known(docs, model)
    assert kept.schema == docs.schema
    known = sorted((r.doc_id for r in found if not r.rejected), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == known
    assert language_id.predict(documents(spark, []), model).count() == 0


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "words here", None)])
    found = language_id.predict(docs, language_id.train(docs)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in found] == [("und", 0.0, True)]


def test_language_scores_do_not_depend_on_neighbours():
    model = language_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)
    texts = [b"the dog", b"", b"ab", b"die katze " * 500, b"x"]
    alone = np.concatenate([language_id.logits_of([t], model) for t in texts])
    assert np.allclose(language_id.logits_of(texts, model), alone)


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (9, 1), (None, 1), (77, 0), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    found = quality.predict(docs, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_text = {}
    for row, (_, text, _) in zip(sorted(found, key=lambda r: repr(r.doc_id)), sorted(ROWS, key=lambda r: repr(r[0]))):
        if row.doc_id in (1, 2):
            by_text.setdefault(text, set()).add(row.score)
    assert all(len(scores) == 1 for scores in by_text.values())
    assert quality.predict(documents(spark, []), model).count() == 0


def test_quality_without_both_labels(spark):
    docs = documents(spark)
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.predict(docs, none).collect()} == {0.5}
    ones = quality.train(docs, spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int"))
    assert min(r.score for r in quality.predict(docs, ones).collect()) > 0.99


def test_chunks_cover_every_window():
    draw = np.random.default_rng(0)
    for size in (0, 1, 511, 512, 513, 1012, 1013, 5_000):
        text = draw.integers(1, 255, size, np.uint8).tobytes()
        pieces, firsts = quality.cut([b"other", text, b""])
        own = pieces[firsts[1] : firsts[2]]
        seen = {p[i : i + quality.TAPS].tobytes() for p in own for i in range(0, quality.CHUNK - quality.TAPS + 1, quality.STRIDE)}
        for i in range(0, max(0, size - quality.TAPS + 1), quality.STRIDE):
            assert text[i : i + quality.TAPS] in seen


def test_filters_learn_a_pattern():
    draw = np.random.default_rng(1)
    noise = lambda: "".join(draw.choice(list("abcdefgh "), 700))
    texts = [(noise(), 1) if i % 2 else (noise()[:650] + "$$$ %%%" + noise()[:30], 0) for i in range(240)]
    model = quality.fit(texts[:160])
    score = quality.scores([t.encode() for t, _ in texts[160:]], model)
    assert np.mean((score >= 0.5) == [bool(label) for _, label in texts[160:]]) >= 0.95


def test_sample_is_bounded_and_even(spark):
    rows = spark.createDataFrame([(f"text {i}", "a" if i % 10 else "b") for i in range(2_000)] + [("same", "a")] * 500, "text string, lang string")
    sample = labelled_sample(rows, "lang", "text", 200, 100)
    counts = {label: sum(x == label for _, x in sample) for label in "ab"}
    assert len(sample) <= 200 and counts["a"] >= 70 and counts["b"] >= 70
    assert labelled_sample(rows.limit(0), "lang", "text", 10, 10) == []


def test_held_out_labels_change_no_score(spark, tmp_path):
    docs = [(i, f"words of text {i} " + ("good prose here " if i % 2 else "$$ %% junk ") * 5) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = []
    for held_out in (0, 1):
        labels = [(i, held_out if fold(i, 3) == 1 else i % 2) for i, _ in docs]
        spark.createDataFrame(labels, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        found.append({r.doc_id: r.score for r in QUERIES["op6_quality"](spark, str(tmp_path)).collect()})
    assert found[0] == found[1]
