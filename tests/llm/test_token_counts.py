"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
from cases import ROWS, collected, documents
from tokenizers import Tokenizer

from buildscope.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'r", "e", "!", "<|endoftext|>", "<|endof", "é", "日", "5", "12", " <", "'", "ation", "\u3000", "🙂"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_of_texts_and_prefixes(library):
    counter = token_counts.counter(PATH)
    draw = random.Random(1)
    for _ in range(150):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        ends = list(range(len(text) + 1))
        exact = [library(text[:end]) for end in ends]
        assert counter.count(text) == exact[-1]
        assert counter.counts_at(text, ends) == exact
        budget = draw.randint(0, 6)
        assert counter.fitting(text, budget) == max(e for e, n in zip(ends, exact) if n <= budget)


def test_every_low_character(library):
    counter = token_counts.counter(PATH)
    for code in range(0x2100):
        for text in (f"a{chr(code)} b", chr(code) * 3 + "x"):
            assert counter.count(text) == library(text), hex(code)


def test_table(spark, library):
    found = token_counts.count_tokens(documents(spark), PATH, limit=100)
    want = [(k, len((t or "").encode()), library(t or ""), library(t or "") > 100) for k, t, _ in ROWS]
    assert collected(found) == sorted(want, key=repr)
    assert token_counts.count_tokens(documents(spark, []), PATH, limit=1).count() == 0


def test_truncate(spark, library):
    for row in token_counts.truncate(documents(spark), PATH, 7).collect():
        assert library(row.text) <= 7
    cut = {r.doc_id: r.text for r in token_counts.truncate(documents(spark, ROWS[:1]), PATH, 7).collect()}[1]
    assert ROWS[0][1].startswith(cut) and library(ROWS[0][1][: len(cut) + 1]) > 7
