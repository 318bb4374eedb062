"""Mixing sources to target weights by a time-varying curriculum; DataFrame expressions only.

A mix takes from each source as many words as its target says and gives every occurrence of a document a position in training,
between 0 and 1.

Targets. The mix has ``share`` times the words of all sources, dealt by weight. A source stops at ``most`` times its own words;
what it cannot give is dealt to the others by weight, until none is above. That is one level: sources ordered by most * words /
weight stop one after the other while the level, what is left divided by the weights that are left, is higher than their ratio.

Order. The documents of a source stand in the order of an MD5 of seed, id, text and copy, and are taken from the front, over again from
the front when the source ends, until the target is reached; the last occurrence is cut to the words that are still wanted, so a
source gives its target, rounded down, to the word.

Positions. A source's weight over time t is a schedule, linear between knots. With W(t) its integral from 0, the source should have
given target * W(t) / W(1) words by t. An occurrence that starts after c words of its source thus stands at the t where W(t) =
W(1) * c / target: the knots before it are passed, and the rest is a quadratic equation. Sorted by position, with a range sort, the
occurrences are the training order.

How it spreads. Words before a document are sums over ranges of the hash (first level) and a window inside a range (second level);
a range is of one source, their number grows with the rows, and rows that agree in source, id, size and text hash are counted
before they are shuffled and spread again in blocks of ``BLOCK`` copies. So neither a source, nor an id, nor a group of copies
meets in one task. One row per source, or per range, is all that is sorted in a single window.

Defined results: a null text has no words; documents without words are taken nowhere, with an empty list; a null source is a source
like any other, the last one; sources are numbered by code point; rows that agree in everything take places next to each other or
elsewhere, it is the same; a null id counts as empty text in the hash; if no source has words all targets are 0. Only the id and
the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildscope.plans.tables import materialize

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a row that are placed together, and rows in a range of the hash, about.
BLOCK, RANGE_ROWS = 1_024, 4_000
HASH_BITS = 32

Schedule = Sequence[tuple[float, float]]
#: Knots (t, weight) of the schedules; sources take them in turn: even, rising, falling.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.75, 1.5), (1.0, 1.5)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)),
)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of (source, source_size) the same with number (from 0, by code point, null last), weight and target."""
    if min(weights) <= 0 or most < share:
        raise ValueError("weights must be positive, and most at least share")
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("number"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("number") % len(weights) + 1)
    rows = rows.select("*", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("weights_left"),
    )
    # The level if just the sources before this one stop. It is above the ratio of every source that stops, and falls after the first
    # source that does not, whose level is the one that holds.
    level = F.col("left") / F.col("weights_left")
    rows = rows.select("*", F.when(level * F.col("weight") <= F.col("cap"), level).alias("open"))
    held = F.max("open").over(everything)
    return rows.select("source", "source_size", "number", "weight", F.coalesce(F.least("cap", held * F.col("weight")), F.col("cap")).alias("target"))


def _integrals(schedule: Schedule) -> list[float]:
    """The integral of a schedule up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def _checked(schedule: Schedule) -> Schedule:
    ts, ws = [t for t, _ in schedule], [w for _, w in schedule]
    if ts[0] != 0 or ts[-1] != 1 or ts != sorted(set(ts)) or min(ws) < 0 or any(a == b == 0 for a, b in zip(ws, ws[1:])):
        raise ValueError("a schedule runs from t = 0 to 1, with weights that are not negative and never 0 for a while")
    return schedule


def position(part: Column, schedule: Schedule) -> Column:
    """The t by which the share ``part`` of a schedule's integral is given."""
    sums = _integrals(_checked(schedule))
    wanted = part * sums[-1]
    out = None
    for (t0, w0), (t1, w1), before in reversed(list(zip(schedule, schedule[1:], sums))):
        # w0 * x + slope * x * x / 2 = rest, solved in the form that stands a slope of 0.
        slope = (w1 - w0) / (t1 - t0)
        rest = wanted - before
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        x = F.when(rest > 0, rest * 2 / (root + w0)).otherwise(0.0)
        t = F.least(x + t0, F.lit(float(t1)))
        out = t if out is None else F.when(wanted < before_next, t).otherwise(out)
        before_next = before
    return out


def mix(
    docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedules: Sequence[Schedule] = SCHEDULES,
    seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: id, source, size, source_size, target, and ``taken``, array of (pass, position, words) of its occurrences."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_hash"))
    equal = rows.groupBy("source", "id", "size", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))
    units = equal.select("source", "id", "size", "text_hash", "copies", F.explode(blocks).alias("block"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "text_hash", F.col("block").cast("string")).cast("binary"))
    copies = F.least(F.col("copies") - F.col("block") * BLOCK, F.lit(BLOCK))
    units = units.select("source", "id", "size", "text_hash", "block", copies.alias("copies"), digest.alias("digest"))
    units = materialize(units.withColumn("hash", F.conv(F.substring("digest", 1, HASH_BITS // 4), 16, 10).cast("long")), "mix-units")

    total = F.sum(F.col("size") * F.col("copies"))
    sizes = units.groupBy("source").agg(total.alias("source_size"))
    known = targets(sizes, weights, share, most)
    # Ranges of the hash, so many that each has a bounded number of rows of any source.
    ranges = 1 << max(0, math.ceil(math.log2(max(1, units.count()) / RANGE_ROWS)))
    units = units.withColumn("range", F.floor(F.col("hash") / float((1 << HASH_BITS) // ranges)))
    sums = units.groupBy("source", "range").agg(total.alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    facts = sums.join(known, sums["source"].eqNullSafe(known["source"])).drop(known["source"])
    same = units["source"].eqNullSafe(facts["source"]) & (units["range"] == facts["range"])
    placed = units.join(facts, same).drop(facts["source"], facts["range"])
    inside = Window.partitionBy("source", "range").orderBy("digest", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    placed = placed.select("*", start.alias("start"))

    each = placed.select("id", "source", "size", "source_size", "target", "number", "start", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    each = each.select("id", "source", "size", "source_size", "target", "number", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    passes = F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))

    def occurrence(number: Column) -> Column:
        at = F.col("start") + number * F.col("source_size")
        words = F.least(F.greatest(F.floor("target") - at, F.lit(0)), F.col("size"))
        part = F.try_divide(at, F.col("target"))
        t = F.lit(None).cast("double")
        for turn, schedule in reversed(list(enumerate(schedules))):
            t = F.when(F.col("number") % len(schedules) == turn, position(part, schedule)).otherwise(t)
        return F.struct(number.alias("pass"), t.alias("position"), words.alias("words"))

    found = F.filter(F.transform(passes, occurrence), lambda o: o["words"] > 0)
    return each.select("id", "source", "size", "source_size", "target", found.alias("taken")).withColumnsRenamed({"id": id_col, "source": source_col})


def training_order(mixed: DataFrame) -> DataFrame:
    """The occurrences of a mix, one row each, sorted by position over all partitions."""
    names = [c for c in mixed.columns if c != "taken"]
    rows = mixed.select(*names, F.explode("taken").alias("taken")).select(*names, "taken.*")
    return rows.orderBy("position", *names[:1], "pass")
