"""Inputs that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

LONG = " ".join(f"word{i % 977} alpha{i % 31}" for i in range(20_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 6, "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 6, "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", "de"),
    (6, LONG, "en"),
    (7, LONG + " tail", None),
    (8, "Ünïcödé 日本語 🙂 straße", "de"),
    (8, "Ünïcödé 日本語 🙂 straße", "de"),
    (8, "same id, another text", "en"),
    (None, "no id at all", "en"),
    (None, None, None),
    (-5, "x", "fr"),
    (9, "a" * 700, "en"),
    (10, "12 34 :: -- 56", None),
]

# Names that operators use for their own columns or inside.
CLASHES = ["id", "h1", "label", "class", "n", "lang_pred", "rule", "host", "path", "verdict", "score", "range", "place", "_found", "spans"]


def documents(spark, rows=ROWS):
    """A table of documents with columns whose names clash with results."""
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], schema)


def random_texts(number, seed=3, words=12):
    """Short texts of few words, so that much repeats."""
    draw = random.Random(seed)
    known = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 6))) for _ in range(40)]
    return [" ".join(draw.choice(known) for _ in range(draw.randint(0, words))) for _ in range(number)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
