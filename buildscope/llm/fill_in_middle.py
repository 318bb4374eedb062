"""Fill-in-the-middle transformation with an indexable skip list.

A text is cut into units, its lines, and the units are the bottom lane of a skip list. The height of a unit's tower is drawn from a
hash of its number, so half of the units reach the lane above. Every link of every lane carries two widths: the units and the code
points that it skips. A cut at a rank goes down from the highest lane, follows a link as long as the units passed do not exceed the
rank, and adds up both widths; it ends at the code point where the unit of that rank starts, after about two steps in each lane.
Both cuts of a text use the same list.

The ranks come from the first groups of eight hex digits of the SHA-256 of ``seed:id``, so a row's form does not depend on other
rows, and reruns agree:

    prefix ends after min(h1 % (n+1), h2 % (n+1)) units, middle after the larger, suffix is the rest
    plain if h3 % 100 >= rate, otherwise suffix-prefix-middle if h4 % 100 < spm_rate, otherwise prefix-suffix-middle

Rows are transformed one by one inside the partition that holds them; nothing is shuffled, and a task holds about a megabyte of text
at a time unless one text is longer.

Defined results: a null text is empty; an empty text, and one that contains a mark, stays plain, with null lengths; a null id counts
as empty text; rows of equal ids are cut at ranks from equal hashes; a text without line ends is one unit, so its cuts fall on its
ends. Only the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Odd constant that spreads unit numbers over 64 bits; the trailing zeros of the product's upper half are a tower's height.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class SkipList:
    """Units of given lengths; ``start`` finds where the unit of a rank starts."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.units, self.length = len(lengths), int(lengths.sum())
        # Place 0 is the head, place i stands before unit i; each lane lists the places that its links join, ends included.
        starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        mixed = np.arange(1, self.units, dtype=np.uint64) * SPREAD >> np.uint64(32)
        places = np.arange(self.units + 1)
        # Lanes from the bottom up: links as (units skipped, code points skipped), and where each link starts in the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = np.arange(self.units + 1)
        bit = 0
        while True:
            self.lanes.append((np.diff(places), np.diff(starts[places]), below))
            if len(places) <= 2:
                break
            inner = places[1:-1]
            kept = (mixed[inner - 1] >> np.uint64(bit)) & np.uint64(1) == 0
            chosen = np.concatenate(([0], np.flatnonzero(kept) + 1, [len(places) - 1]))
            places, below, bit = places[chosen], chosen, bit + 1
            if bit == 32:  # towers are no higher; the last lane is walked
                self.lanes.append((np.diff(places), np.diff(starts[places]), below))
                break

    def start(self, rank: int) -> int:
        """Code points before the unit of this rank; the whole length for the number of units."""
        units = points = at = 0
        for depth in range(len(self.lanes) - 1, -1, -1):
            unit_widths, point_widths, below = self.lanes[depth]
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units += int(unit_widths[at])
                points += int(point_widths[at])
                at += 1
            at = int(below[at])
        return points


def line_lengths(text: str) -> np.ndarray:
    """Code points of each line, its line feed included."""
    if not text:
        return np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, text.split("\n")), np.int64)
    lengths[:-1] += 1
    return lengths if lengths[-1] else lengths[:-1]


def transformed(text: str, key: str, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    lengths = line_lengths(text)
    n = len(lengths)
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    units = SkipList(lengths)
    a, b = units.start(low), units.start(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, SPM, a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, PSM, a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50
) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars, output. ``rate`` and ``spm_rate`` are per cent."""
    schema = "n long, form string, prefix_chars long, middle_chars long, output string"
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            found = [transformed(t or "", k or "", seed, rate, spm_rate) for k, t in zip(keys, texts)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it. No mark occurs in the text, nor can one arise where a text meets a mark."""
    first, second = F.lit(PREFIX), F.lit(SUFFIX)
    last = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    rest = F.split_part(output, F.lit(MIDDLE), F.lit(1))
    psm = F.concat(F.split_part(F.split_part(rest, first, F.lit(2)), second, F.lit(1)), last, F.split_part(rest, second, F.lit(2)))
    spm = F.concat(F.split_part(rest, first, F.lit(2)), last, F.split_part(F.split_part(rest, second, F.lit(2)), first, F.lit(1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
