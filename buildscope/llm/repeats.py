"""Suffix-array dedup: removes every byte of a passage of ``WINDOW`` bytes that also starts anywhere else.

A suffix array cut at ``WINDOW`` bytes, or radix passes that order suffixes, would put equal windows side by side. Only this grouping is
needed, and it is found without ordering suffixes: by anchors (winnowing), where whatever is alone in its group drops out. A digit is
here the string of an anchor:

1. *Anchor digit.* Of the ``DIGIT``-byte strings inside a window the one of least hash is its anchor (leftmost among equals), so equal
   windows have equal anchors at equal offsets. Anchors are few, one in about fifty places, and only they are shuffled. An anchor whose
   digit is nowhere else is done. If all places of a digit agree on everything around it that a window could reach, all their windows
   are repeated.
2. *Remaining digits.* Places that share the digit and differ around it carry these surroundings, one place for each that occur. A
   group of at most ``GROUP`` places is finished in one task: for each offset of the anchor in a window, windows are grouped by all their bytes. Larger groups are split
   further: the offsets are cut into ranges, each range keyed by the bytes that its windows have in common (one alone drops out, and
   agreement settles the rest), and what is left is grouped window by window. So no group is gathered in one task, whatever its size.

Hashes of 128 bits stand for strings. The repeated windows of a text are joined to spans and cut out. Equal texts are one text with a
count of copies; a text of ``WINDOW`` bytes or more with copies is repeated as a whole.

Defined results: a null text is empty; texts under ``WINDOW`` bytes keep all; matches never cross texts; rows with equal text get
equal results, row by row; ids may be null or repeated. Only the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import byte_texts, chunks, partitions
from buildscope.plans.tables import materialize, release

WINDOW, DIGIT = 200, 100
# Offsets of an anchor in its windows: 0 to REACH.
REACH = WINDOW - DIGIT
# Places that share a digit, and differ around it, finished in one task (about 100 MB); larger groups are split.
GROUP = 16_000
# Ranges of offsets that a larger group is split into.
RANGES = ((0, 24), (25, 49), (50, 74), (75, 100))
# Rows that a task turns into arrays at once.
ROWS = 4_096
PLACE_BITS = 20  # of a chunk's places, in the packed minimum; longer texts use more

_random = np.random.default_rng(20)
#: Odd multipliers and byte values of two rolling hashes, and byte values for each place around an anchor.
BASES = _random.integers(1 << 62, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
VALUES = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
AROUND = _random.integers(0, 1 << 63, (2, 2 * REACH, 256), np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    known = _powers.get(which)
    if known is None or len(known[0]) < size:
        size = max(size, 1 << PLACE_BITS)
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        steps = np.full(size, base)
        steps[0] = 1
        back = np.full(size, inverse)
        back[0] = 1
        known = _powers[which] = (np.cumprod(steps), np.cumprod(back))
    return known


class Rolling:
    """Hashes of any stretch of a byte array."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        powers, self.back = _powers_of(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[which][data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from minima within blocks of that width."""
    size = len(values)
    blocks = -(-size // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:size] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: size - width + 1], ahead[width - 1 : size])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts: number of the text, place in it, hash of the digit, hash of all that windows could reach."""
    texts_at = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < WINDOW:
        return none, none, none, none
    first, second = Rolling(data, 0), Rolling(data, 1)
    digit = mixed(first.of(np.arange(size - DIGIT + 1), np.arange(DIGIT, size + 1)))
    bits = np.uint64(max(PLACE_BITS, size.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_minimum((digit & ~low) | np.arange(len(digit), dtype=np.uint64), REACH + 1)
    whole = np.ones(len(least), bool)  # windows inside one text
    for start, end in zip(texts_at, texts_at[1:]):
        whole[max(start, end - WINDOW + 1) : end] = False
    places = np.unique((least[whole] & low).astype(np.int64))
    number = np.searchsorted(texts_at, places, "right") - 1
    begin, end = texts_at[number], texts_at[number + 1]
    lo, hi = np.maximum(places - REACH, begin), np.minimum(places + WINDOW, end)
    around = mixed(second.of(lo, hi) + ((places - lo) * 1_000 + (hi - places)).astype(np.uint64) * BASES[0])
    return number, places - begin, digit[places].view(np.int64), around.view(np.int64)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        number, place, digit, around = anchors(byte_texts(batch.column("text")))
        h1 = batch.column("h1").to_numpy(zero_copy_only=False)[number]
        h2 = batch.column("h2").to_numpy(zero_copy_only=False).astype(np.int64)[number]
        yield _batch(["digit", "around", "h1", "hp"], digit, around, h1, (h2 << 32) | place)


def cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each place listed with a text: digit, number of places that share it, the bytes before and after it, the span of offsets."""
    names = ["digit", "n", "h1", "h2", "place", "bytes", "low", "high"]
    for batch in chunks(batches):
        out: list[tuple] = []
        rows = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), byte_texts(batch.column("text")), batch.column("places").to_pylist())
        for h1, h2, text, places in rows:
            for p in places:
                at = p["place"]
                low, high = max(0, at + WINDOW - len(text)), min(REACH, at)
                out.append((p["digit"], p["n"], h1, h2, at, text[at - high : at] + text[at + DIGIT : at + WINDOW - low], low, high))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        yield _batch(names, *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)])


def surroundings(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of hashed bytes from the anchor outward: before it by length, after it by length (two hashes each), and the offsets' span."""
    low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
    grid = np.zeros((len(low), 2 * REACH), np.uint8)
    for i, (value, h) in enumerate(zip(rows.column("bytes").to_pylist(), high)):
        data = np.frombuffer(value, np.uint8)
        grid[i, :h] = data[:h][::-1]
        grid[i, REACH : REACH + len(data) - h] = data[h:]
    before = np.zeros((2, len(low), REACH + 1), np.uint64)
    after = np.zeros((2, len(low), REACH + 1), np.uint64)
    sides = np.arange(2 * REACH)
    for which in (0, 1):
        hashed = AROUND[which][sides, grid]
        np.cumsum(hashed[:, :REACH], axis=1, out=before[which][:, 1:])
        np.cumsum(hashed[:, REACH:], axis=1, out=after[which][:, 1:])
    return before, after, low, high


def _repeated(rows: pa.RecordBatch) -> np.ndarray:
    """For each row and offset, whether another row of its digit has the same window there."""
    before, after, low, high = surroundings(rows)
    offsets = np.arange(REACH + 1)
    valid = (offsets >= low[:, None]) & (offsets <= high[:, None])
    digit = rows.column("digit").to_numpy().view(np.uint64)[:, None]
    keys = [mixed(before[w] + after[w][:, ::-1] + mixed(digit + offsets.astype(np.uint64) * BASES[w])) for w in (0, 1)]
    row, offset = np.nonzero(valid)
    a, b = keys[0][valid], keys[1][valid]
    order = np.argsort(a, kind="stable")
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    hit = np.zeros(len(a), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out = np.zeros(valid.shape, bool)
    out[row[hit], offset[hit]] = True
    return out


def _spans(rows: pa.RecordBatch, repeated: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated offsets as spans of bytes."""
    edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    place = rows.column("place").to_numpy()[row]
    h1, h2 = (rows.column(c).to_numpy()[row] for c in ("h1", "h2"))
    return _batch(["h1", "h2", "start", "end"], h1, h2, place - (past - 1), place - first + WINDOW)


def finish_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, for rows sorted by digit; a batch ends where a digit does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            digits = part.column("digit").to_numpy()
            # What follows the last change of digit stays for the next round.
            last = int(np.searchsorted(digits, digits[-1]))
            if last or (held and held[-1].column("digit")[-1].as_py() != digits[0]):
                done = _together([*held, part.slice(0, last)])
                yield _spans(done, _repeated(done))
                held = []
            held.append(part.slice(last))
    if held:
        done = _together(held)
        yield _spans(done, _repeated(done))


def _together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def split_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row and range of offsets: hashes of what its windows have in common, and of all they reach."""
    names = ["common", "common2", "all", "h1", "h2", "place", "first", "last", "digit", "bytes", "low", "high"]
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            rows = batch.slice(begin, ROWS)
            before, after, low, high = surroundings(rows)
            digit = rows.column("digit").to_numpy().view(np.uint64)
            for first, last in RANGES:
                here = np.flatnonzero((high >= first) & (low <= last))
                a, b = np.maximum(first, low[here]), np.minimum(last, high[here])
                salt = mixed(digit[here] + np.uint64(first) * BASES[1])
                common = [mixed(before[w][here, first] + after[w][here, REACH - last] + salt) for w in (0, 1)]
                reach = mixed(before[0][here, b] + after[0][here, REACH - a] + (a * 1_000 + b).astype(np.uint64) * BASES[0])
                taken = rows.take(pa.array(here))
                keep = {c: taken.column(c) for c in ("h1", "h2", "place", "digit", "bytes", "low", "high")}
                yield _batch(names, common[0].view(np.int64), common[1].view(np.int64), reach.view(np.int64), keep["h1"], keep["h2"], keep["place"], pa.array(a, pa.int32()), pa.array(b, pa.int32()), keep["digit"], keep["bytes"], keep["low"], keep["high"])


def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a row's range of offsets, by hash."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            rows = batch.slice(begin, ROWS)
            before, after, _, _ = surroundings(rows)
            digit = rows.column("digit").to_numpy().view(np.uint64)
            first, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            row = np.repeat(np.arange(len(first)), last - first + 1)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            keys = [mixed(before[w][row, offset] + after[w][row, REACH - offset] + mixed(digit[row] + offset.astype(np.uint64) * BASES[w])).view(np.int64) for w in (0, 1)]
            place = rows.column("place").to_numpy()[row] - offset
            yield _batch(["w1", "w2", "h1", "h2", "start"], *keys, rows.column("h1").to_numpy()[row], rows.column("h2").to_numpy()[row], place)


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its bytes, the bytes and spans removed, the digest of what is left, the spans."""
    for batch in chunks(batches):
        out = []
        for text, copies, starts, ends in zip(byte_texts(batch.column("text")), *(batch.column(c).to_pylist() for c in ("copies", "starts", "ends"))):
            if copies > 1 and len(text) >= WINDOW:
                spans = [(0, len(text))]
            else:
                spans = joined(starts or [], ends or [], len(text))
            kept, at = [], 0
            for start, end in spans:
                kept.append(text[at:start])
                at = end
            kept.append(text[at:])
            out.append((len(text), sum(e - s for s, e in spans), len(spans), sha256(b"".join(kept)).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        yield _batch(["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], batch.column("h1"), batch.column("h2"), *columns)


def joined(starts: list[int], ends: list[int], size: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, inside the text."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts, ends)):
        start, end = max(0, start), min(size, end)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Starts and ends of repeated windows, joined to spans as far as known, for distinct texts (h1, h2, text)."""
    parts = partitions(texts.sparkSession)
    found = texts.mapInArrow(find_anchors, "digit long, around long, h1 long, hp long")
    groups = (
        found.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("least"), F.max("around").alias("most"))
        .filter("n > 1").select("digit", (F.col("least") == F.col("most")).alias("agree"))
    )
    shared = materialize(found.join(groups.select("digit", "agree"), "digit"), "shared-digits")
    places = shared.select("digit", "around", "agree", "h1", F.shiftright("hp", 32).cast("int").alias("h2"), F.col("hp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place"))
    reach = ["h1", "h2", (F.col("place") - REACH).alias("start"), (F.col("place") + WINDOW).alias("end")]
    agreed = places.filter("agree").select(*reach)
    # Places that agree with another one, if not with all, have only repeated windows; one of them stands for all.
    open_ = places.filter("NOT agree")
    kinds = open_.groupBy("digit", "around").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("h1", "h2", "place")).alias("first"))
    kinds = materialize(kinds, "surroundings-of-digits")
    alike = open_.join(kinds.filter("copies > 1").select("digit", "around"), ["digit", "around"], "left_semi").select(*reach)
    sizes = kinds.groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    single = kinds.select("digit", "first.*").join(sizes, "digit")
    # The places of one text are one row, bounded by its length.
    open_ = single.groupBy("h1", "h2").agg(F.collect_list(F.struct("digit", "n", "place")).alias("places"))
    cut = texts.join(open_, ["h1", "h2"]).mapInArrow(cut_surroundings, "digit long, n long, h1 long, h2 int, place long, bytes binary, low int, high int")
    cut = materialize(cut, "surroundings")
    small = cut.filter(F.col("n") <= GROUP).repartition(parts, "digit").sortWithinPartitions("digit")
    found = agreed.unionByName(alike).unionByName(small.mapInArrow(finish_groups, "h1 long, h2 int, start long, end long"))
    large = cut.filter(F.col("n") > GROUP)
    if not large.isEmpty():
        found = found.unionByName(_split_spans(large))
    # A row for each text, bounded by its length.
    spans = materialize(found.groupBy("h1", "h2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "spans")
    release(shared, kinds, cut)
    return spans


def _split_spans(large: DataFrame) -> DataFrame:
    """Spans of repeated windows of groups too large for one task: by ranges of offsets, then by window."""
    ranges = large.mapInArrow(
        split_ranges, "common long, common2 long, all long, h1 long, h2 int, place long, first int, last int, digit long, bytes binary, low int, high int"
    )
    counted = ranges.groupBy("common", "common2").agg(F.count(F.lit(1)).alias("n"), F.min("all").alias("least"), F.max("all").alias("most")).filter("n > 1")
    ranges = ranges.join(counted, ["common", "common2"])
    settled = ranges.filter("least = most").select("h1", "h2", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + WINDOW).alias("end"))
    windows = ranges.filter("least <> most").select("h1", "h2", "place", "first", "last", "digit", "bytes", "low", "high")
    windows = windows.mapInArrow(list_windows, "w1 long, w2 long, h1 long, h2 int, start long")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"], "left_semi").select("h1", "h2", "start", (F.col("start") + WINDOW).alias("end"))
    return settled.unionByName(single)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    texts = docs.select(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), text.alias("text")).dropDuplicates(["h1", "h2"])
    spans = repeated_spans(texts)
    cleaned = (
        texts.join(copies, ["h1", "h2"]).join(spans, ["h1", "h2"], "left")
        .mapInArrow(remove_spans, "h1 long, h2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    )
    return rows.join(cleaned, ["h1", "h2"]).select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
