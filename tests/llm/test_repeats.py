"""Repeated passages against a table of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from cases import LONG, ROWS, collected, documents

from buildscope.llm import repeats

W = repeats.WINDOW


def brute(rows):
    windows = Counter(b[i : i + W] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - W + 1))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - W + 1):
            if windows[data[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and not gone[i - 1] if i else g for i, g in enumerate(gone))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def planted():
    """Passages of many lengths at the starts, ends and middles of texts, with copies that differ by a byte."""
    draw = random.Random(8)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    passages = [letters(n) for n in (120, 199, 200, 201, 230, 320, 500)]
    rows = []
    for i in range(60):
        p = draw.choice(passages)
        if i % 4 == 3:
            at = draw.randrange(len(p))
            p = p[:at] + "#" + p[at + 1 :]
        rows.append((i, letters(draw.randint(0, 80)) * (i % 3 > 0) + p + letters(draw.randint(0, 150)) * (i % 5 > 0)))
    rows += [(100, "ab" * 400), (101, "x" * 200), (102, "x" * 199), (103, letters(90) * 5)]
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_planted_passages(spark, monkeypatch, group):
    """Also when every shared digit counts as a large group and is split."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = planted()
    found = repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans")
    assert collected(found) == brute(rows)


def test_odd_rows(spark):
    found = repeats.dedup(documents(spark)).drop("spans")
    assert collected(found) == brute([(k, t) for k, t, _ in ROWS])
    assert repeats.dedup(documents(spark, [])).count() == 0


def test_spans_are_of_the_text(spark):
    rows = repeats.dedup(spark.createDataFrame([(1, "q" + "y" * 90 + "z" * 120 + "!"), (2, "y" * 90 + "z" * 120)], "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in rows} == {1: [(1, 211)], 2: [(0, 210)]}


def test_chunks_do_not_change_anchors():
    texts = [LONG.encode()[:5_000], b"short", LONG.encode()[1_000:4_000]]
    number, place, digit, around = repeats.anchors(texts)
    for i, text in enumerate(texts):
        _, alone, own, reach = repeats.anchors([text])
        assert [list(x[number == i]) for x in (place, digit, around)] == [list(alone), list(own), list(reach)]
