"""Ranked lexical search with hashed max-sketches.

The index holds one row per document: its distinct terms as 64-bit hashes with their counts, its length factor, and a sketch. A term's
impact on a document, what it adds to a score before the term's weight, folds into ``PROBES`` cells of the sketch that its hash
names; a cell keeps the maximum of what was folded into it, as one byte rounded up. The least of a term's cells is therefore never
below the term's impact, so

    bound(document, item) = sum of weight * least cell over the item's terms >= score

A search reads the index once per slice of the items. A task looks up all terms of the slice in the sketches of a block of
documents, and one matrix product gives the bounds of all pairs. For each item it then goes through the block in descending order
of bounds and scores exactly, from terms and counts, until the bound is below the last of the best ``k`` known to the task. Only
those are sent, at most ``k`` rows per task and item, and are ranked per item.

The score is in integers, ``div`` rounding down:

    N documents with terms, L terms of all documents, n terms of one, df documents that hold a term, tf its count in one
    weight = floor(1000 * ln((2N + 2) / (2 df + 1)))      m = 10 + (90 * n * N) div L
    score = sum of weight * ((1000000000 * tf) div (1000 * tf + 8 * m)) over the item's distinct terms

Products stay below 2^53 for scores (a weight is below 30,000, an impact at most 1,000,000, an item below 300,000 terms), so bounds
in doubles are exact. A sketch is as wide as the document needs, a power of two from ``CELLS_PER_TERM`` cells per distinct term, so
long texts are bounded as tightly as short ones.

Defined results: a null text has no terms; documents and items without terms, and pairs of score 0, give no row; equal scores are
ordered by id, null ids last, and rows of equal id each take a rank; the texts of rows with equal item ids are one item; a null item
id is an item like any other. Terms that stand for each other by a 64-bit hash collision would count as one. Only ids and results
come back, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildscope.llm.common import arrow_type, chunks
from buildscope.plans.tables import materialize

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FIND = re.compile(TERM).findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Cells that a term is folded into, and cells of a sketch per distinct term.
PROBES, CELLS_PER_TERM = 2, 8
#: Impacts are at most 1,000,000; a cell counts steps of this size, rounded up.
STEP = 4_000
#: Characters of items whose terms and weights are sent to all tasks at once.
SLICE_CHARS = 200_000
#: Documents whose bounds are held at once, and numbers in a block of looked up cells.
BLOCK, BLOCK_NUMBERS = 2_048, 4_000_000


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def term_counts(text: str | None) -> Counter:
    return Counter(FIND((text or "").translate(LOWER)))


def impacts(tf: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def width(terms: int) -> int:
    return 1 << max(6, (CELLS_PER_TERM * terms - 1).bit_length())


def cells(of: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of hashes in a sketch of this size, one array per probe."""
    mask = np.uint64(size - 1)
    return [(of >> np.uint64(32 * probe)) & mask for probe in range(PROBES)]


def sketch(terms: np.ndarray, found: np.ndarray) -> np.ndarray:
    out = np.zeros(width(len(terms)), np.uint8)
    steps = (-(-found // STEP)).astype(np.uint8)
    for places in cells(terms, len(out)):
        np.maximum.at(out, places, steps)
    return out


@dataclass(frozen=True)
class Index:
    """Documents (id, m, sketch, terms, counts), those without terms left out, and the totals N and L."""

    rows: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document with a term. The index is written to the shared folder."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(TERM))
    totals = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.regexp_count("text", F.lit(TERM)).cast("long")), F.lit(0)).alias("l")).first()
    n, l = totals.n, totals.l
    names = ["id", "m", "sketch", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found: list[tuple] = []
            for text in batch.column("text").to_pylist():
                counted = term_counts(text)
                terms = hashes(list(counted))
                counts = np.fromiter(counted.values(), np.int64, len(counted))
                order = np.argsort(terms)
                terms, counts = terms[order], counts[order]
                m = 10 + 90 * int(counts.sum()) * n // l
                found.append((m, sketch(terms, impacts(counts, m)).tobytes(), terms.tobytes(), counts.astype(np.uint32).tobytes()))
            columns = [pa.array([f[i] for f in found], pa.binary() if i else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    id_type = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {id_type}, m long, sketch binary, terms binary, counts binary")
    return Index(materialize(rows, "search-index"), n, l)


def _items(items: DataFrame, item_col: str, item_text: str) -> Iterator[list[Row]]:
    """(item, terms) of items, about ``SLICE_CHARS`` characters of them at a time; rows of one id are in one slice."""
    rows = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter(F.col("text").rlike(TERM))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-size // SLICE_CHARS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select("item", F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0)))).alias("term"))
    for number in range(slices):
        part = words.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == number)
        yield part.groupBy("item").agg(F.collect_set("term").alias("terms")).collect()


def _frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of these terms is: counted in the tasks, summed by term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            # Blocks: the terms of many documents in one array, each distinct in its document.
            values = batch.column("terms").to_pylist()
            for start in range(0, len(values), BLOCK):
                of = np.frombuffer(b"".join(values[start : start + BLOCK]), np.uint64)
                at = np.minimum(np.searchsorted(terms, of), len(terms) - 1)
                total += np.bincount(at[terms[at] == of], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    counted = index.rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(terms), np.int64)
    for row in counted.collect():  # at most one row per term of the slice
        out[row.term] = row.df
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Queries:
    """The items of a slice: all their terms, ascending, and of each item the places of its terms and their weights."""

    terms: np.ndarray
    weights: np.ndarray
    places: list[np.ndarray]


def bounds_of(sketches: list[bytes], m: np.ndarray, queries: Queries, matrix: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores: documents x items."""
    looked_up = np.zeros((len(sketches), len(queries.terms)), np.float32)
    sizes = np.array([len(s) for s in sketches])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        table = np.frombuffer(b"".join(sketches[r] for r in rows), np.uint8).reshape(len(rows), size)
        first, *others = cells(queries.terms, int(size))
        least = table[:, first]
        for places in others:
            np.minimum(least, table[:, places], out=least)
        looked_up[rows] = least
    return looked_up.astype(np.float64) @ matrix


class Best:
    """The best k of one item so far, as (score descending, id ascending, null last)."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, key) -> None:
        self.rows.append((score, key))
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]) if r[1] is not None else (-r[0], True))
        del self.rows[self.k :]


def best_in(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> list[Best]:
    """The best k documents of these batches for every item."""
    best = [Best(k) for _ in queries.places]
    matrix = np.zeros((len(queries.terms), len(queries.places)))
    for item, places in enumerate(queries.places):
        matrix[places, item] = queries.weights[places] * float(STEP)
    block = max(16, min(BLOCK, BLOCK_NUMBERS // max(1, len(queries.terms))))
    for batch in batches:
        for start in range(0, batch.num_rows, block):
            part = batch.slice(start, block)
            ids = part.column("id").to_pylist()
            terms, counts = part.column("terms"), part.column("counts")
            m = part.column("m").to_numpy()
            bounds = bounds_of(part.column("sketch").to_pylist(), m, queries, matrix)
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for item, places in enumerate(queries.places):
                top, of_item = best[item], bounds[:, item]
                hopeful = np.flatnonzero(of_item >= top.least)
                for row in hopeful[np.argsort(-of_item[hopeful], kind="stable")]:
                    if of_item[row] < top.least:
                        break
                    if row not in known:
                        known[row] = np.frombuffer(terms[row].as_buffer(), np.uint64), np.frombuffer(counts[row].as_buffer(), np.uint32)
                    own, tf = known[row]
                    wanted = queries.terms[places]
                    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                    held = own[at] == wanted
                    found = impacts(tf[at[held]].astype(np.int64), m[row])
                    score = int((queries.weights[places][held] * found).sum())
                    if score >= top.least:
                        top.add(score, ids[row])
    return best


def search(
    index: Index, items: DataFrame, k: int = 10, *, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The k documents of highest score of each item: item id, rank from 1, document id, score."""
    spark = index.rows.sparkSession
    id_type, to_arrow = index.rows.schema["id"].dataType.simpleString(), arrow_type(index.rows, "id")
    item_type = items.schema[item_col].dataType
    out = spark.createDataFrame([], f"item {item_type.simpleString()}, rank int, id {id_type}, score long")
    for slice_ in filter(None, _items(items, item_col, item_text)):
        words = sorted({t for row in slice_ for t in row.terms})
        hashed = hashes(words)
        terms = np.unique(hashed)
        place = dict(zip(words, np.searchsorted(terms, hashed).tolist()))
        frequency = _frequencies(index, terms)
        weights = np.array([weight(index.documents, int(df)) for df in frequency], np.int64)
        places = [np.array(sorted({place[t] for t in row.terms}), np.int64) for row in slice_]
        shared = spark.sparkContext.broadcast(Queries(terms, weights, places))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            found = best_in(batches, shared.value, k)
            rows = [(number, key, score) for number, top in enumerate(found) for score, key in top.rows]
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.int64(), to_arrow, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["number", "id", "score"])

        found = index.rows.mapInArrow(run, f"number long, id {id_type}, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row.item) for i, row in enumerate(slice_)], f"number long, item {item_type.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(names), "number").select("item", "rank", "id", "score"))
    return out.withColumnsRenamed({"item": item_col, "id": id_col})

