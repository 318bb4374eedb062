"""Token counts: a prefix table that holds the exact number of byte-pair tokens of every prefix.

For one pre-token (a run that merges never leave) the table is filled from left to right. The last token of a prefix is the only
token that ends it and is *compatible* with the last token of the prefix before it: the byte-pair merges of the two, side by side,
give back exactly these two. So ``count[i] = count[i - len(last[i])] + 1``, no merge is ever simulated on a whole text, and the table
answers questions on prefixes (how many tokens has it, how much text fits a budget) without encoding again. Pre-tokens repeat, so a
worker keeps a bounded table of those it has met.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside texts count as one token each, as the
tokenizer library does by default; equal texts get equal counts, row by row; ids may be null or repeated. Only the id and the results
come back, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import Remembered, chunks

# How byte-level pre-tokenizers cut a text: fixed value of the tokenizer's format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens, and stretches between spaces, that a worker remembers.
REMEMBERED = 200_000
# Marks, in a node of the trie, the token that ends there; the other keys are bytes.
TOKEN = 256


def _byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts the tokens of texts and of their prefixes, for a byte-level ``tokenizer.json``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_symbols()
        raw = {symbol: bytes(byte[c] for c in symbol) for symbol in spec["model"]["vocab"] if all(c in byte for c in symbol)}
        self.tokens: dict[int, bytes] = {}
        self.trie: dict = {}
        for symbol, number in spec["model"]["vocab"].items():
            if symbol in raw:
                node = self.trie
                for value in raw[symbol]:
                    node = node.setdefault(value, {})
                node[TOKEN] = number
                self.tokens[number] = raw[symbol]
        self.longest = max(map(len, self.tokens.values()))
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for number, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[raw[left], raw[right]] = number
            self.halves.setdefault(raw[left] + raw[right], (raw[left], raw[right]))
        # Tokens that merging their own bytes gives: single bytes and the results of merges.
        self.reached = {n for n, t in self.tokens.items() if len(t) == 1 or t in self.halves}
        self.left_edges: dict[bytes, list[tuple[bytes, int]]] = {}
        self.right_edges: dict[bytes, list[tuple[bytes, int]]] = {}
        special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.special = set(special)
        self.cut_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        # Whether a token may follow another, as far as met.
        self.after: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.words = Remembered(lambda word: self.prefix_counts(word.encode())[-1], REMEMBERED)
        self.spaced = Remembered(lambda part: self.stretch_count(" " + part), REMEMBERED)

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The tokens at one edge of ``token`` while its bytes are merged, with the rank of the merge that ends each."""
        spines = self.right_edges if right else self.left_edges
        spine = spines.get(token)
        if spine is None:
            spine, part, ends = [], token, 1 << 60
            while part is not None:
                spine.append((part, ends))
                halves = self.halves.get(part)
                ends = self.rank[halves] if halves else 0
                part = halves[right] if halves else None
            spines[token] = spine
        return spine

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two tokens.

        It does unless some merge across the border comes before the merges that use up its two sides; of equal ranks, the merge
        further left comes first.
        """
        if self.known > 4 * REMEMBERED:
            self.after.clear()
            self.known = 0
        rank, begins = self.rank, self.edge(self.tokens[right], False)
        good = all(
            (across := rank.get((a, b))) is None or across >= a_ends or across > b_ends
            for a, a_ends in self.edge(self.tokens[left], True)
            for b, b_ends in begins
        )
        self.after.setdefault(left, {})[right] = good
        self.known += 1
        return good

    def prefix_counts(self, word: bytes) -> list[int]:
        """Tokens of every prefix of one pre-token; entry 0 is the empty prefix.

        Each prefix has one valid last token, so an end that has one needs no further look.
        """
        size = len(word)
        last = [-1] * (size + 1)
        count = [0] * (size + 1)
        for start in range(size):
            before, node, follows = last[start], self.trie, count[start] + 1
            after = self.after.get(before, {})
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                token = node.get(TOKEN)
                if token is None or last[end + 1] >= 0:
                    continue
                good = after.get(token) if start else token in self.reached
                if good is None:
                    good = self.fits(before, token)
                if good:
                    last[end + 1] = token
                    count[end + 1] = follows
        return count

    def stretch_count(self, stretch: str) -> int:
        """Tokens of a stretch of text that begins and ends where pre-tokens do."""
        return sum(map(self.words.__getitem__, self.pre_token.findall(stretch)))

    def sections(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """Start, string and whether it is a special string."""
        at = 0
        for special in self.cut_special.finditer(text) if self.cut_special else ():
            if special.start() > at:
                yield at, text[at : special.start()], False
            yield special.start(), special.group(), True
            at = special.end()
        if at < len(text):
            yield at, text[at:], False

    def count(self, text: str) -> int:
        total = 0
        for _, section, special in self.sections(text):
            if special:
                total += 1
            elif "  " in section or section.endswith(" "):
                total += self.stretch_count(section)
            else:
                # A pre-token begins at every single space: cut there, and count each part with the space before it.
                first, *rest = section.split(" ")
                total += self.stretch_count(first) + sum(map(self.spaced.__getitem__, rest))
        return total

    def counts_at(self, text: str, ends: list[int]) -> list[int]:
        """Tokens of ``text[:end]`` for each end, as if each prefix was encoded alone."""
        starts, totals, total = [], [], 0
        for begin, section, special in self.sections(text):
            for word in [section] if special else self.pre_token.findall(section):
                starts.append((begin, special))
                totals.append(total)
                begin += len(word)
                total += 1 if special else self.words[word]
        starts.append((len(text), False))
        totals.append(total)
        return [self._count_at(text, end, starts, totals) for end in ends]

    def _count_at(self, text: str, end: int, starts: list[tuple[int, bool]], totals: list[int]) -> int:
        if end >= len(text):
            return totals[-1]
        # Pre-tokens that end before the last character kept are as in the whole text; what follows is cut anew.
        low, high = 0, len(starts) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if starts[middle][0] < end else (low, middle - 1)
        if starts[low][1] and end < starts[low + 1][0] and low:
            low -= 1  # a special string cut short is plain text and may join the pre-token before it
        while low and text[starts[low][0] - 1].isspace():
            low -= 1  # how a run of white space is cut depends on what follows it
        return totals[low] + self.count(text[starts[low][0] : end])

    def fitting(self, text: str, budget: int) -> int:
        """The most characters from the start of ``text`` that are ``budget`` tokens or fewer."""
        if self.count(text) <= budget:
            return len(text)
        low, high = 0, min(len(text), max(1, budget) * self.longest)
        ends = list(range(low, high + 1))
        return max(end for end, n in zip(ends, self.counts_at(text, ends)) if n <= budget)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, one row per row of ``docs``."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [table.count(t) for t in texts]
            columns = [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)


def truncate(docs: DataFrame, tokenizer: str, budget: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the longest start of each text with ``budget`` tokens or fewer."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept = [t[: table.fitting(t, budget)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string())], ["id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {id_type}, text string").withColumnRenamed("id", id_col)
