"""Segmentations against all paths of the lattice; round trips."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
from cases import ROWS, documents

from buildscope.llm import piece_lattice
from buildscope.llm.workload import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "th", "e", "r", "in", " ", "  ", ".", "é", "日", "🙂", "\n", "ing", "=="]


def all_paths(lattice, text):
    ending = lattice.arcs(text)[1]
    out = []

    def back(place, ids, score):
        if place == 0:
            out.append((score, ids))
        for length, own, value in ending[place] if place else ():
            back(place - length, own + ids, score + value)

    back(len(text), (), 0.0)
    return sorted(out, key=lambda p: -p[0])


@pytest.mark.parametrize("nbest", [1, 2, 5])
def test_n_best_are_the_best_of_all_paths(nbest):
    lattice = piece_lattice.lattice(MODEL, nbest)
    assert lattice.by_word and lattice.apart
    draw = random.Random(nbest)
    for _ in range(120):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 6)))
        normal = lattice.normalize(text)
        paths = all_paths(lattice, normal) if normal else [(0.0, ())]
        found = lattice.encode(text)
        assert [s.score for s in found] == [score for score, _ in paths[:nbest]]
        assert len({s.ids for s in found}) == len(found) and {(s.score, s.ids) for s in found} <= set(paths)
        assert all(lattice.decode(s.ids) == text for s in found)
        score, ids, second = lattice.best(text)
        assert (score, second) == (paths[0][0], paths[1][0] if len(paths) > 1 else None)
        assert lattice.decode(ids) == text and (score, tuple(ids)) in paths


def test_parts_do_not_change_the_result():
    whole = piece_lattice.Lattice(MODEL, 3)
    cut = piece_lattice.Lattice(MODEL, 3)
    whole.by_word = whole.apart = False
    for text in ["the cat, sat.", "a b", "Über 日本!", "in in in"]:
        assert [s.score for s in whole.encode(text)] == [s.score for s in cut.encode(text)]


def test_tables(spark):
    docs = documents(spark)
    rows = piece_lattice.summarize(docs, MODEL).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id == 4][0]
    assert (empty.n_pieces, empty.score, empty.second_score) == (0, 0.0, None)
    encoded = piece_lattice.encode(docs, MODEL)
    back = piece_lattice.decode(encoded, MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((k, t or "") for k, t, _ in ROWS), key=repr)
    best = {r.doc_id: r.segmentations for r in piece_lattice.encode_nbest(docs.filter("doc_id IN (4, 10)"), MODEL, 3).collect()}
    assert [len(best[k]) for k in (4, 10)] == [1, 3]
    assert piece_lattice.summarize(documents(spark, []), MODEL).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_lattice.decode(nulls, MODEL).first().text == ""


def test_a_literal_space_mark_becomes_a_space(spark):
    row = piece_lattice.summarize(documents(spark, [(1, "a▁b", "en")]), MODEL).first()
    assert not row.round_trip and piece_lattice.lattice(MODEL, 2).decode(piece_lattice.lattice(MODEL, 2).best("a▁b")[1]) == "a b"


def test_rows_hold_every_segmentation(spark):
    texts = ["", "the cat, sat.", "thing in  there==", "日 é\n🙂 ering", "word1 alpha1 word2, alpha2 word3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for nbest in (None, 1, 7):
        rows = piece_lattice.summarize(docs, MODEL, *[nbest] * (nbest is not None)).collect()
        lattice = piece_lattice.Lattice(MODEL, nbest or piece_lattice.NBEST)
        for row in rows:
            normal = lattice.normalize(texts[row.doc_id])
            words = piece_lattice.WORDS.findall(normal)
            # Paths of the words before, times those of a word: only the best of them can be in the best of the whole.
            paths = [(0.0, ())]
            for word in words:
                paths = sorted(((a + b, c + d) for a, c in paths for b, d in all_paths(lattice, word)), key=lambda p: -p[0])[:3_000]
            assert row.nbest_scores == [score for score, _ in paths[: lattice.nbest]]
            assert len(row.nbest_sha256) == len(set(row.nbest_sha256)) == len(row.nbest_scores)
            named = {(score, hashlib.sha256(array("i", ids).tobytes()).hexdigest()) for score, ids in paths}
            assert set(zip(row.nbest_scores, row.nbest_sha256)) <= named
            assert (row.score, row.ids_sha256) == (row.nbest_scores[0], row.nbest_sha256[0])
            assert row.second_score == (row.nbest_scores + [None, None])[1]
            assert lattice.best(texts[row.doc_id])[1].tobytes() == array("i", lattice.encode(texts[row.doc_id])[0].ids).tobytes()
    assert piece_lattice.NBEST > 2


def test_the_query_searches_every_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat, thinking"), (2, None), (3, "in")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, str(tmp_path)).collect()}
    assert [len(found[k].nbest_sha256) for k in (1, 2)] == [piece_lattice.NBEST, 1]


def test_the_best_of_a_part_and_the_cost_of_the_second():
    """In one pass as by all paths, where many segmentations compete or have equal scores."""
    lattice = piece_lattice.lattice(MODEL, 2)
    draw = random.Random(9)
    for size in [1, 1, 2, 3, 5, 8, 11] * 12:
        part = "".join(draw.choice("aeinrst▁") for _ in range(size))
        paths = all_paths(lattice, part)
        score, ids, gap = lattice.part_best(part)
        assert (score, ids) in paths and score == paths[0][0]
        assert gap == (paths[0][0] - paths[1][0] if len(paths) > 1 else piece_lattice.ALONE)
    assert lattice.part_best("") == (0.0, (), piece_lattice.ALONE)
