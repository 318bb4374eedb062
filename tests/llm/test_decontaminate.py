"""Leaks against the full table of edit distances."""

import random
from decimal import Decimal

import pytest
from cases import ROWS, documents, random_texts

from buildscope.llm import decontaminate as d


def plain_text(text):
    return "".join(chr(c) for c in d.characters(text))


def least_distance(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        new = [0]
        for i, own in enumerate(item, 1):
            new.append(min(row[i - 1] + (own != char), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(text, edits, draw):
    chars = list(text)
    for _ in range(edits):
        at = draw.randrange(len(chars)) if chars else 0
        chars[at : at + draw.randint(0, 1)] = draw.choice([[], ["q"], ["Z"], [" "]])
    return "".join(chars)


def test_every_leak_and_no_other():
    draw = random.Random(5)
    items = [t for t in random_texts(30, 9, words=40) if len(t) >= d.Q]
    index = d.build_index(list(enumerate(items)))
    texts = ["", "short"]
    for _ in range(60):
        item = draw.choice(items)
        body = edited(item, draw.randint(0, d.edit_budget(len(item)) + 2), draw)
        texts.append(draw.choice(["", "lead in words "]) + (body.upper() if draw.random() < 0.3 else body.replace(" ", "\n")) + draw.choice(["", " and more"]))
    found = {(t, i): (start, end, distance) for t, i, start, end, distance in d.leaks_in(texts, index)}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            item = plain_text(item)
            best = least_distance(item, plain_text(text))
            assert ((t, i) in found) == (best <= d.edit_budget(len(item)))
            if (t, i) in found:
                start, end, distance = found[t, i]
                assert distance == best == least_distance(item, plain_text(text[start:end]))


def test_exact_positions(spark):
    item = "A passage, of the benchmark: with 40+ characters in it"
    docs = spark.createDataFrame([(1, "🙂é " + item + "!"), (2, item), (3, item[:30])], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "tiny")], "item_id long, text string")
    found = sorted(tuple(r) for r in d.find_leaks(docs, bench).collect())
    assert found == [(1, 7, 3, 3 + len(item), 0), (2, 7, 0, len(item), 0)]


def test_odd_rows_slices_and_filter(spark, monkeypatch):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, ROWS[0][1]), (None, "word1 alpha1 word2 alpha2 word3"), (1, "a" * 30)], "item_id long, text string")
    whole = sorted(map(repr, d.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "SLICE_CHARS", 100)
    assert sorted(map(repr, d.find_leaks(docs, bench).collect())) == whole
    leaking = {r.doc_id for r in d.find_leaks(docs, bench).collect()}
    assert leaking == {1, 2, 6, 7, 9}
    kept = d.drop_leaking(docs, bench)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((k for k, _, _ in ROWS if k not in leaking), key=repr)
    assert d.find_leaks(documents(spark, []), bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0 and d.drop_leaking(docs, bench.limit(0)).count() == len(ROWS)


def one_for_one(text):
    """Lower case by letter, where that is one letter."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def test_accented_capitals_are_no_edits(spark):
    items = [
        "la niñez soñó mañanas añejas, según él: ¿cuánto más pedirá José?",
        "où sont passés les élèves zélés dès l'été, à l'école où règne Noël",
        "größere Bäume blühen später über grünen Hügeln, schöner als früher",
        "съешь ещё этих мягких французских булок, да выпей чаю; λόγος και μύθος",
    ]
    texts = [lead + "".join(c.upper() if len(c.upper()) == 1 else c for c in item) + " FIN" for item in items for lead in ("", "É ", "İİ ")]
    found = {(t, i): (start, end, distance) for t, i, start, end, distance in d.leaks_in(texts, d.build_index(list(enumerate(items))))}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            assert ((t, i) in found) == (i == t // 3)
        start, end, distance = found[t, t // 3]
        assert distance == 0 and text[start:end].lower().replace("ς", "σ") == items[t // 3].lower().replace("ς", "σ")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert d.drop_leaking(docs, bench).count() == 0


def test_fold_joins_all_that_lower_joins():
    every = [chr(i) for i in range(0x110000)]
    folded = "".join(map(chr, d.characters("".join(every))))
    joined = {}
    for char, own in zip(every, folded):
        if char not in "\t\n\v\f\r":
            assert joined.setdefault(one_for_one(char), own) == own


@pytest.mark.parametrize("kind, ids", [("int", [1, 2]), ("string", ["x", "y"]), ("decimal(12,2)", [Decimal("1.50"), Decimal("2.00")]), ("long", [2**53 + 1, None])])
def test_item_ids_of_any_type_and_repeated_items(spark, kind, ids):
    first, second = "the first passage of a benchmark, long enough to be found", "quite another passage with words of its own inside"
    items = [(ids[0], first), (ids[0], first), (ids[1], second), (ids[1], first), (ids[0], None)]
    bench = spark.createDataFrame(items, f"item_id {kind}, text string")
    docs = spark.createDataFrame([(7, f"before {first} after"), (8, f"{second} {second}"), (9, "clean")], "doc_id int, text string")
    found = d.find_leaks(docs, bench)
    assert dict(found.dtypes)["item_id"] == bench.schema["item_id"].dataType.simpleString()
    got = sorted(((r.doc_id, r.item_id, r.start, r.distance) for r in found.collect()), key=repr)
    assert got == sorted([(7, ids[0], 7, 0), (7, ids[1], 7, 0), (8, ids[1], 0, 0)], key=repr)
    assert [r.doc_id for r in d.drop_leaking(docs, bench).collect()] == [9]
