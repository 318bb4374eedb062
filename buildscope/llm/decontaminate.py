"""Benchmark decontamination by the q-gram lemma, with banded alignment as the judge.

A document leaks an item if some stretch of it is within the item's edit budget ``e`` of the whole item. Such a stretch shares at least
``L + 1 - Q * (e + 1)`` of the item's character q-grams (length ``L``), and as the edits move the alignment by at most e, the shared ones
lie on e + 1 adjacent diagonals. So the q-grams of a text that occur in the benchmark are counted per item in overlapping bands of
diagonals; bands that reach the bound are kept and verified by an alignment inside the band. The filter loses nothing, and the
alignment leaves nothing wrong.

Characters are compared without case and with white space as spaces, one for one, so positions are those of the text. A letter whose
other case is several code points is kept. The budget is
``RATE`` of the item's length, less for items so short that the bound would be under ``Q`` q-grams; items under ``Q`` characters are no
passages and are ignored, as are null items.

The index of the benchmark is broadcast in slices of at most ``SLICE_CHARS`` characters, so memory is bounded whatever its size; each
slice is held against all whole texts.

Defined results: null and empty texts leak nothing; equal texts get equal results, row by row; ids may be null or repeated; a
repeated item counts once, and items with equal ids are one item of several texts, a leak of any of which is a leak of it; of several stretches the one of least distance is reported, the leftmost of equals. Only the
ids and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import arrow_type, chunks, tidy

Q = 10
RATE = 0.06
SLICE_CHARS = 2_000_000
BITMAP_BITS = 22
# A region of text and its item, aligned together with others of about the same length.
ALIGNED_AT_ONCE = 256
FAR = 1 << 20
# Code points from here on have no case.
CASELESS = 0x20000

_B = [np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4)]


class Index(NamedTuple):
    """Items, and where each q-gram of theirs is."""

    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    bounds: np.ndarray
    bitmap: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of a q-gram's places, and one past the last
    item: np.ndarray
    place: np.ndarray


def _folded(char: str) -> str:
    """The small letter of a letter's capital, so that all small forms of a capital are one; never more than one code point."""
    upper = char.upper()
    lower = (upper if len(upper) == 1 else char).lower()
    return lower if len(lower) == 1 else char


_SAME = np.arange(sys.maxunicode + 1, dtype=np.uint32)
_SAME[:CASELESS] = [ord(_folded(chr(i))) for i in range(CASELESS)]
_SAME[9:14] = 32


def characters(text: str) -> np.ndarray:
    """Code points, without case and with white space as spaces."""
    return _SAME[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_codes(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each character, by doubling: 2, 4, 8, 10."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    one = codes.astype(np.uint64)
    two = one[:-1] * _B[0] + one[1:]
    four = two[:-2] * _B[1] + two[2:]
    eight = four[:-4] * _B[2] + four[4:]
    ten = eight[:-2] * _B[1] + two[8:]
    ten ^= ten >> np.uint64(29)
    ten *= np.uint64(0xBF58476D1CE4E5B9)
    return ten


def edit_budget(length: int) -> int:
    return max(0, min(int(RATE * length), (length + 1) // Q - 2))


def build_index(items: list[tuple[object, str]]) -> Index:
    ids, texts, edits, bounds, grams, item, place = [], [], [], [], [], [], []
    for key, text in items:
        codes = characters(text)
        if len(codes) < Q:
            continue
        own = gram_codes(codes)
        grams.append(own)
        item.append(np.full(len(own), len(ids), np.int32))
        place.append(np.arange(len(own), dtype=np.int32))
        ids.append(key)
        texts.append(codes)
        edits.append(edit_budget(len(codes)))
        bounds.append(len(codes) + 1 - Q * (edits[-1] + 1))
    every = np.concatenate([np.zeros(0, np.uint64), *grams])
    order = np.argsort(every, kind="stable")
    known, first = np.unique(every[order], return_index=True)
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[known >> np.uint64(64 - BITMAP_BITS)] = True
    item = np.concatenate([np.zeros(0, np.int32), *item])[order]
    place = np.concatenate([np.zeros(0, np.int32), *place])[order]
    return Index(ids, texts, np.array(edits, np.int64), np.array(bounds, np.int64), bitmap, known, np.append(first, len(every)), item, place)


def candidates(texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int]]:
    """Text, item and lowest diagonal of the bands that reach the item's bound."""
    if not index.ids or not texts:
        return []
    starts = np.cumsum([0] + [len(t) for t in texts])
    joined = np.concatenate(texts)
    codes = gram_codes(joined)
    at = np.flatnonzero(index.bitmap[codes >> np.uint64(64 - BITMAP_BITS)])
    gram = np.minimum(np.searchsorted(index.grams, codes[at]), len(index.grams) - 1)
    text = np.searchsorted(starts, at, "right") - 1
    real = (index.grams[gram] == codes[at]) & (at + Q <= starts[text + 1])
    at, gram, text = at[real], gram[real], text[real]
    times = index.first[gram + 1] - index.first[gram]
    hit = np.repeat(np.arange(len(at)), times)
    if not len(hit):
        return []
    posting = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(index.first[gram], times)
    item = index.item[posting].astype(np.int64)
    diagonal = at[hit] - starts[text[hit]] - index.place[posting] + FAR
    edits = index.edits[item]
    width = edits + 1
    band = diagonal // width
    # Bands of 2e + 1 diagonals that begin at every (e + 1)th: e + 1 adjacent diagonals are inside one of them.
    also = (diagonal % width < edits).nonzero()[0]
    rows = np.stack([np.concatenate([text[hit], text[hit[also]]]), np.concatenate([item, item[also]]), np.concatenate([band, band[also] - 1])])
    order = np.lexsort(rows[::-1])
    rows = rows[:, order]
    new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)).nonzero()[0]
    counts = np.diff(np.append(new, rows.shape[1]))
    kept = new[counts >= index.bounds[rows[1, new]]]
    return [(int(t), int(i), int(b * (index.edits[i] + 1) - FAR)) for t, i, b in rows[:, kept].T]


def align(items: list[np.ndarray], regions: list[np.ndarray], free_start: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a stretch of its region, and where the stretch ends; all regions are as wide.

    A region is as long as its item plus the band. Row r of the table holds, for each diagonal k, the distance of the item's first r
    characters to a stretch that ends after r + k characters of the region.
    """
    width = len(regions[0]) - len(items[0]) + 1
    rows = max(map(len, items))
    item = np.zeros((len(items), rows), np.int64)
    region = np.full((len(items), rows + width), -1, np.int64)
    for i, (a, b) in enumerate(zip(items, regions)):
        item[i, : len(a)] = a
        region[i, : len(b)] = b
    ks = np.arange(width)
    cost = np.zeros((len(items), width), np.int64) + (0 if free_start else ks)
    lengths = np.array([len(a) for a in items])
    best = np.full(len(items), FAR)
    end = np.zeros(len(items), np.int64)
    for r in range(1, rows + 1):
        step = cost + (region[:, r - 1 : r - 1 + width] != item[:, r - 1 : r])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ks, axis=1) + ks
        done = lengths == r
        if done.any():
            best[done] = cost[done].min(axis=1)
            end[done] = cost[done].argmin(axis=1) + r
    return best, end


def verify(found: list[tuple[int, int, int]], texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    """Text, item, start, end and distance of the candidates within their budget."""
    out = []
    by_budget: dict[int, list] = {}
    for text, item, diagonal in found:
        edits = int(index.edits[item])
        # The path may leave the band of its shared q-grams by e on either side.
        start, stop = diagonal - edits, diagonal + 3 * edits + 1 + len(index.texts[item])
        region = np.full(stop - start, -1, np.int64)
        own = texts[text]
        a, b = max(0, start), min(len(own), stop)
        if a < b:
            region[a - start : b - start] = own[a:b]
        by_budget.setdefault(edits, []).append((len(index.texts[item]), text, item, start, region))
    for edits, rows in by_budget.items():
        rows.sort(key=lambda r: r[:4])
        for i in range(0, len(rows), ALIGNED_AT_ONCE):
            some = rows[i : i + ALIGNED_AT_ONCE]
            best, end = align([index.texts[r[2]] for r in some], [r[4] for r in some])
            good = np.flatnonzero(best <= edits)
            if not len(good):
                continue
            # Backward from its end each stretch is aligned again, which gives its start.
            backward = []
            for g in good:
                _, _, item, _, region = some[g]
                size = len(index.texts[item]) + 2 * edits
                stretch = np.full(size, -2, np.int64)
                taken = region[max(0, end[g] - size) : end[g]][::-1]
                stretch[: len(taken)] = taken
                backward.append(stretch)
            _, length = _anchored([index.texts[some[g][2]][::-1] for g in good], backward, edits)
            for g, n in zip(good, length):
                _, text, item, start, _ = some[g]
                stop = int(start + end[g])
                out.append((text, item, max(0, stop - int(n)), min(stop, len(texts[text])), int(best[g])))
    return out


def _anchored(items: list[np.ndarray], regions: list[np.ndarray], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``align`` for stretches that begin where the region does, which may also be shorter than their item."""
    shifted = [np.concatenate([np.full(edits, -3, np.int64), r]) for r in regions]
    width = 3 * edits + 1
    rows = max(map(len, items))
    item = np.zeros((len(items), rows), np.int64)
    region = np.full((len(items), rows + width), -1, np.int64)
    for i, (a, b) in enumerate(zip(items, shifted)):
        item[i, : len(a)] = a
        region[i, : len(b)] = b[: rows + width]
    ks = np.arange(width)
    cost = np.where(ks >= edits, ks - edits, FAR) + np.zeros((len(items), 1), np.int64)
    lengths = np.array([len(a) for a in items])
    best = np.full(len(items), FAR)
    used = np.zeros(len(items), np.int64)
    for r in range(1, rows + 1):
        step = cost + (region[:, r - 1 : r - 1 + width] != item[:, r - 1 : r])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ks, axis=1) + ks
        done = lengths == r
        if done.any():
            best[done] = cost[done].min(axis=1)
            used[done] = cost[done].argmin(axis=1) + r - edits
    return best, used


def leaks_in(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """The best stretch of each text and item id: text, (first) item of the id, start, end, distance."""
    codes = [characters(t) for t in texts]
    first: dict[object, int] = {}
    same = [first.setdefault(key, at) for at, key in enumerate(index.ids)]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, start, end, distance in verify(candidates(codes, index), codes, index):
        key = (text, same[item])
        if key not in best or (distance, start, end) < best[key]:
            best[key] = (distance, start, end)
    return [(text, item, start, end, distance) for (text, item), (distance, start, end) in sorted(best.items())]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """id, item id, start, end (code points, end exclusive) and edit distance of every leak."""
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type, in_arrow = benchmark.schema[item_col].dataType.simpleString(), arrow_type(benchmark, item_col)
    schema = f"id {id_type}, item {item_type}, start long, end long, distance long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") >= Q)
    out = None
    for shared in _indexes(benchmark, item_col, item_text):
        found = rows.mapInArrow(tidy(lambda batches, shared=shared: _search(batches, shared.value, in_arrow)), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, unchanged."""
    for shared in _indexes(benchmark, item_col, item_text):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text_col):
                leaking = {f[0] for f in leaks_in([t or "" for t in batch.column(text_col).to_pylist()], shared.value)}
                yield batch.filter(pa.array([i not in leaking for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """Indexes of the benchmark, of about ``SLICE_CHARS`` characters each, on all executors."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).dropna(subset=["text"]).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_CHARS))
    for number in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == number)
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(sorted(((r.item, r.text) for r in part.collect()), key=repr)))


def _search(batches: Iterator[pa.RecordBatch], index: Index, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = leaks_in([t or "" for t in batch.column("text").to_pylist()], index)
        ids = batch.column("id").take(pa.array([f[0] for f in found], pa.int64()))
        places = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)]
        items = [index.ids[f[1]] for f in found]
        yield pa.RecordBatch.from_arrays([ids, pa.array(items, item_type), *places], ["id", "item", "start", "end", "distance"])
