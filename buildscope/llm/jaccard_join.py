"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, and the components of its links.

A document's set are its distinct word n-grams, as 64-bit hashes; documents with equal sets are one *class*. In a global order of
n-grams, rare ones first, two sets of sizes x <= y with the wanted similarity share an n-gram among the first few of each (its prefix), so
only prefixes are joined. How rare an n-gram is comes from a sketch: occurrences in all documents, counted by hash in ``BUCKETS``
counters. Any global order gives the same links; a good one gives few candidates.

A candidate pair must pass the length filter (``least * y <= 100 * x``), the positional filter (the n-grams after the shared one must
still suffice) and the suffix filter (the sizes of ``PARTS`` hash partitions of both sets bound their difference from below). A pair is
verified once, on whole sets.

Groups of near copies would give pairs in the square of their size, and nearly all would join what is joined already. So, first, every
member of a prefix group is held only against one leader per band of lengths, the one of least draw; verified links give components. The
draw is of the class, the round and one of ``LEADERS`` shares of the n-grams, so groups with nearly the same members have few leaders
between them, and n near copies give at most 4 n pairs, whatever number of n-grams they share. In each of the ``DRAWN_ROUNDS`` that
follow, every member draws in every block up to ``DRAWN`` each of the pairs with larger and with smaller sets that lead out of its
component and pass the filters: most of them link, so what is near a component joins it. Only then all pairs that are left *between* components are listed. Groups are searched in blocks of
``BLOCK`` members, so none is gathered in one task; a pair that was not drawn is put off, and no link between components is lost.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; texts with fewer words
than an n-gram have all their words as one; rows with equal text or id get equal results, row by row; a component's id is its least
id, null only if it has no other. Only the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import byte_texts, chunks, partitions, tidy
from buildscope.llm.components import components
from buildscope.llm.repeats import BASES, Rolling, mixed
from buildscope.plans.tables import materialize, release

BUCKETS = 1 << 22
BUCKET_SHIFT = np.uint64(64 - 22)
BUCKETS_PER_ROW = 1 << 14
PARTITIONS_PER_SKETCH = 8
PARTS = 128
# Leaders that a round draws for the n-grams of a band: few, so that near copies meet the same ones.
LEADERS = (4,)
STAR_ROUNDS = len(LEADERS)
# Rounds after those in which members draw pairs out of their component, and how many in each block.
DRAWN_ROUNDS, DRAWN = 2, 8
BLOCK = 2_000
# Pairs of a block that are looked at together.
CELLS = 1 << 14
# Bits of the filter that finds the texts of candidate classes; a full filter only reads more.
FILTER_BITS = 1 << 23


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = mixed(Rolling(data, 0).of(begin, end) + (end - begin).astype(np.uint64) * BASES[1])
    first = np.searchsorted(begin, starts)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        grams = mixed(grams + words[k : len(words) - size + 1 + k] * BASES[k & 1])
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for word in range(a, b):
                whole = mixed(whole + words[word : word + 1] * BASES[1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A number for the set, whatever the order."""
    return int(mixed(mixed(tokens).sum(keepdims=True) + np.uint64(len(tokens)))[0].view(np.int64))


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """The sketch: how often n-grams of each bucket occur, over all rows of ``docs`` (text)."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in chunks(batches):
            tokens = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(byte_texts(batch.column("text")), size)])
            np.add.at(counts, (tokens >> BUCKET_SHIFT).astype(np.int64), 1)
        for number, row in enumerate(counts.reshape(-1, BUCKETS_PER_ROW)):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["row", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist()):
                if row in totals:
                    totals[row] += np.frombuffer(counts, np.int32)
                else:
                    totals[row] = np.frombuffer(counts, np.int32).copy()
        for row, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["row", "counts"])

    # Several partitions in a task, so that partial sketches stay a small part of the input, and tasks do not grow with it.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-docs.rdd.getNumPartitions() // PARTITIONS_PER_SKETCH))
    parts = docs.coalesce(tasks).mapInArrow(tidy(count), "row int, counts binary")
    summed = parts.repartition(partitions(spark), "row").mapInArrow(tidy(add), "row int, counts binary")
    out = np.zeros(BUCKETS, np.int32)
    for row in summed.collect():  # BUCKETS numbers, whatever the size of the input
        out[row.row * BUCKETS_PER_ROW : (row.row + 1) * BUCKETS_PER_ROW] = np.frombuffer(bytes(row.counts), np.int32)
    return out


def prefix_size(n: int, least: int) -> int:
    """N-grams of a set of n that meet those of any set with the similarity."""
    return n - -(-least * n // 100) + 1


def index_size(n: Column, least: int) -> Column:
    """Of the prefix, those that meet the prefix of a set that is no smaller."""
    return n - F.ceil(n * (2 * least) / F.lit(100 + least)) + 1


def describe(docs: DataFrame, size: int, least: int) -> DataFrame:
    """For each row of ``docs`` (id, text): id, hash of the text, n, class, prefix (rare first) and sizes of the hash partitions."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bucket_counts(docs.select("text"), size))
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in chunks(batches):
            sets = shingle_sets(byte_texts(batch.column("text")), size)
            classes, prefixes, parts = [], [], []
            for tokens in sets:
                order = np.lexsort((tokens, counts[(tokens >> BUCKET_SHIFT).astype(np.int64)]))
                classes.append(class_of(tokens))
                prefixes.append(tokens[order[: prefix_size(len(tokens), least) if len(tokens) else 0]].view(np.int64))
                sizes = np.bincount((tokens & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                # Cut at what a byte holds, sizes differ by less, so the bound stays one.
                parts.append(np.minimum(sizes, 255).astype(np.uint8).tobytes())
            columns = [
                batch.column("id"), batch.column("h1"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h1", "n", "class", "prefix", "parts"])

    rows = docs.select("id", F.xxhash64("text").alias("h1"), "text")
    return rows.mapInArrow(tidy(run), f"id {id_type}, h1 long, n long, class long, prefix array<long>, parts binary")


def prefix_groups(described: DataFrame) -> DataFrame:
    """Prefix n-grams that more than one class has: token, members, class, n, place."""
    classes = described.filter("n > 0").dropDuplicates(["class"])
    rows = classes.select("class", "n", F.posexplode("prefix").alias("place", "token")).select("token", "class", (F.shiftleft("n", 32) + F.col("place")).alias("np"))
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(shared, "token").select("token", "members", "class", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place"))


def passes(least: int) -> Column:
    """The length and positional filter, for the sides x and y of a pair that share an n-gram; sizes in either order."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * least / F.lit(100 + least))
    possible = 1 + F.least(F.col("x.n") - F.col("x.place") - 1, F.col("y.n") - F.col("y.place") - 1)
    return (small * 100 >= large * least) & (possible >= needed)


def suffix_filtered(pairs: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose hash partitions, by size, allow enough common n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sizes(batch.column(c).to_pylist()) for c in ("x", "y"))
            total = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            needed = -(-least * total // (100 + least))
            good = np.abs(x - y).sum(axis=1) <= total - 2 * needed
            yield batch.select(["a", "b"]).filter(pa.array(good))

    first = parts.select(F.col("class").alias("a"), F.col("n").alias("m"), F.col("parts").alias("x"))
    second = parts.select(F.col("class").alias("b"), "n", F.col("parts").alias("y"))
    return pairs.join(first, "a").join(second, "b").mapInArrow(tidy(run), "a long, b long")


def _sizes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, PARTS).astype(np.int16)


def _ordered_pair() -> list[Column]:
    return [F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")]


def star_pairs(members: DataFrame, least: int, number: int) -> DataFrame:
    """Each member of a prefix group with the leader of its band of lengths and of the band below, if not joined yet."""
    sides = members.select(
        "token", F.floor(F.log("n") / F.lit(math.log(100 / least))).alias("band"), F.struct("class", "label", "n", "place").alias("x"),
        F.xxhash64("class", F.lit(number), F.pmod("token", F.lit(LEADERS[number]))).alias("draw"),
    )
    leaders = sides.groupBy("token", "band").agg(F.min(F.struct("draw", "x")).alias("first")).select("token", "band", F.col("first.x").alias("y"))
    held = sides.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "x")
    return held.join(leaders, ["token", "band"]).filter(F.col("x.label") != F.col("y.label")).filter(passes(least)).select(*_ordered_pair()).distinct()


def left_pairs(members: DataFrame, parts: DataFrame, least: int, drawn: int | None = None, number: int = 0) -> DataFrame:
    """Pairs of a prefix group between components: all, or in every block the ``drawn`` of least draw of each member
    as the smaller side, and as the larger, in this round.

    Groups over ``BLOCK`` are dealt out as pairs of blocks.
    """
    mixed_groups = members.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    rows = members.join(mixed_groups, "token", "left_semi").join(parts.select("class", "parts"), "class")
    blocks = F.ceil(F.col("members") / BLOCK)
    own = F.pmod(F.xxhash64("class"), blocks)
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    side = ["own", "class", "label", "n", "place", "parts"]
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *side)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j", *side[:-1])])
            now = [numbers, _sizes(batch.column("parts").to_pylist())]
            held = [np.concatenate([held[0], now[0]], axis=1), np.concatenate([held[1], now[1]])] if held else now
            ends = np.flatnonzero((held[0][:3, 1:] != held[0][:3, :-1]).any(axis=0)) + 1
            if len(ends):  # the last block may go on
                yield _crossed(held[0], held[1], [0, *ends], least, drawn, number)
                held = [held[0][:, ends[-1] :].copy(), held[1][ends[-1] :].copy()]
        if held:
            yield _crossed(held[0], held[1], [0, held[0].shape[1]], least, drawn, number)

    dealt = rows.repartition(partitions(members.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(tidy(pairs), "a long, b long").distinct()


def _crossed(numbers: np.ndarray, parts: np.ndarray, ends: list[int], least: int, drawn: int | None, number: int) -> pa.RecordBatch:
    found = [_cross(numbers[1:, a:b], parts[a:b], least, drawn, number) for a, b in zip(ends, ends[1:])]
    out = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(side) for side in out], ["a", "b"])


def _cross(numbers: np.ndarray, parts: np.ndarray, least: int, drawn: int | None, number: int) -> np.ndarray:
    """The pairs of two blocks (or within one) that differ in component and pass the filters; of each member those ``drawn``, if given."""
    none = np.zeros((2, 0), np.int64)
    if (numbers[4] == numbers[4, 0]).all():
        return none
    order = np.lexsort((numbers[3], numbers[5]))
    (i, j), parts = numbers[:2, 0], parts[order]
    own, classes, labels, n, place = numbers[2:, order]
    reach = np.searchsorted(n, 100 * n // least, "right")
    first = np.flatnonzero(place < n - -(-2 * least * n // (100 + least)) + 1)
    every, at_once = np.arange(len(n)), max(1, CELLS // len(n))
    kept = none, np.zeros(0, np.uint64)
    out = []
    for start in range(0, len(first), at_once):
        a = first[start : start + at_once, None]
        good = (every > a) & (every < reach[a]) & (labels != labels[a])
        if i != j:
            good &= own != own[a]
        x, y = good.nonzero()
        x = a[x, 0]
        needed = -(-least * (n[x] + n[y]) // (100 + least))
        near = 1 + np.minimum(n[x] - place[x] - 1, n[y] - place[y] - 1) >= needed
        x, y, needed = x[near], y[near], needed[near]
        near = np.abs(parts[x] - parts[y]).sum(axis=1) <= n[x] + n[y] - 2 * needed
        found = np.stack([x[near], y[near]])
        if drawn is None:
            out.append(found)
            continue
        ab = np.sort(classes[found], axis=0).view(np.uint64)
        draw = mixed(mixed(ab[0] + np.uint64(number)) + ab[1])
        found, draw = np.concatenate([kept[0], found], axis=1), np.concatenate([kept[1], draw])
        few = _first_of(found[0], draw, drawn) | _first_of(found[1], draw, drawn)
        kept = found[:, few], draw[few]
    x, y = np.concatenate([*out, kept[0]], axis=1)
    return np.sort(np.stack([classes[x], classes[y]]), axis=0)


def _first_of(side: np.ndarray, draw: np.ndarray, number: int) -> np.ndarray:
    """Which are among the ``number`` of least draw of their side."""
    order = np.lexsort((draw, side))
    ordered = side[order]
    out = np.zeros(len(side), bool)
    out[order] = np.arange(len(side)) - np.searchsorted(ordered, ordered) < number
    return out


def sets_of(docs: DataFrame, described: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """Class and sorted n-grams of some classes; one text of each is read again."""
    texts = described.filter("n > 0").join(classes, "class", "left_semi").groupBy("class").agg(F.min("h1").alias("h1"))
    texts = materialize(texts, "candidates")
    bits = texts.select(F.pmod("h1", F.lit(FILTER_BITS)).alias("bit")).select(F.shiftright("bit", 6).cast("int").alias("word"), F.col("bit").bitwiseAND(F.lit(63)).cast("int").alias("at"))
    words = bits.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 64, np.uint64)  # fixed size
    for row in words:
        table[row.word] = np.int64(row.bits).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h1 = batch.column("h1").to_numpy(zero_copy_only=False)
            bit = np.mod(h1, FILTER_BITS)
            batch = batch.filter(pa.array((shared.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if batch.num_rows:
                sets = shingle_sets(byte_texts(batch.column("text")), size)
                columns = [batch.column("h1"), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "class", "tokens"])

    found = docs.select(F.xxhash64("text").alias("h1"), "text").mapInArrow(tidy(run), "h1 long, class long, tokens binary")
    sets = materialize(found.join(texts, ["h1", "class"], "left_semi").dropDuplicates(["class"]).select("class", "tokens"), "candidate-sets")
    release(texts)
    return sets


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """a, b and whether they link, by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, linked boolean")


def class_labels(docs: DataFrame, described: DataFrame, size: int, least: int) -> DataFrame | None:
    """``node`` (a class that links with another) and ``label``; None if there is none."""
    groups = materialize(prefix_groups(described), "prefix-groups")
    # Of the classes in prefix groups only.
    parts = described.filter("n > 0").join(groups.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    parts = materialize(parts.select("class", "n", "parts"), "partition-sizes")
    judged: list[DataFrame] = []
    labels = None
    for number in range(STAR_ROUNDS + DRAWN_ROUNDS + 1):
        members = groups.withColumn("label", F.col("class"))
        if labels is not None:
            members = groups.join(labels, groups["class"] == labels["node"], "left").select(*groups.columns, F.coalesce("label", "class").alias("label"))
        if number < STAR_ROUNDS:
            pairs = suffix_filtered(star_pairs(members, least, number), parts, least)
        else:
            pairs = left_pairs(members, parts, least, DRAWN if number < STAR_ROUNDS + DRAWN_ROUNDS else None, number)
        for known in judged:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        classes = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        sets = sets_of(docs, described, classes, size)
        judged.append(materialize(verified(pairs, sets, least), "verified"))
        release(pairs, sets)
        if not judged[-1].filter("linked").isEmpty():
            links = [known.filter("linked").select("a", "b") for known in judged]
            release(labels)
            labels = materialize(components(reduce(DataFrame.unionByName, links)), "labels")
    release(groups, parts, *judged)
    return labels


def join(docs: DataFrame, *, size: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, the hash of its text and the component's label.

    Two documents link when ``100 * intersection >= least * union`` of their sets of ``size``-word n-grams.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = materialize(describe(texts, size, least), "sets")
    labels = class_labels(texts, described, size, least)
    rows = described.select("id", "h1", "n", "class")
    if labels is None:
        rows = rows.withColumn("label", F.col("class"))
    else:
        rows = rows.join(labels, rows["class"] == labels["node"], "left").select("id", "h1", "n", F.coalesce("label", "class").alias("label"))
    some = rows.filter("n > 0")
    least_ids = some.groupBy("label").agg(F.min("id").alias("component_id"))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "h1", "label"]
    alone = rows.filter("n = 0").withColumn("component_id", F.col("id")).withColumn("label", F.lit(None).cast("long"))
    return some.join(least_ids, "label").select(*columns).unionByName(alone.select(*columns))
