"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (runs between white space) weighted by how often they occur. For each of ``SAMPLES`` positions k and
each term, a hash of the term and k gives r and c, both Gamma(2, 1), and b, uniform in (0, 1). With w the weight,

    t = floor(ln(w) / r + b)        ln(a) = ln(c) - r * (t - b) - r

and the text's sample at k is the pair (term, t) of smallest a. Two texts share the sample at k with probability equal to the
generalised Jaccard similarity of their weights, sum(min) / sum(max), so the share of equal positions estimates it.

All of it is DataFrame expressions: words are exploded, counted and reduced per text inside the partition that holds the text, so
neither words nor samples are shuffled. A sample is kept as one long, the rank of ln(a) above 32 bits of the pair's hash, and the
fingerprint shows 16 of these bits as four hex digits.

Defined results: a null text is empty; an empty or blank text has no terms and the fingerprint ``EMPTY``, which equals itself and
nothing else; equal texts have equal fingerprints; rows with equal ids are told apart by their place in the order. Only the id and
the results come back, so other columns cannot clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from buildscope.llm.common import partitions, sha256_of
from buildscope.plans.tables import materialize

SAMPLES = 32
SEED = 977
EMPTY = "-"
# Ranges of ids for each partition of a shuffle; they decide the layout only.
RANGES_PER_PARTITION = 16
# Keys per range that are read to choose the split points. They decide the layout only.
SPLIT_SAMPLE = 8
#: The steps of ln(a) that a sample's rank tells apart, to the unit.
STEPS = float(1 << 20)


def _uniform(bits: Column) -> Column:
    """32 bits to a number in (0, 1)."""
    return (bits.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) / 4294967296.0


def sample(term: Column, weight: Column, k: int) -> Column:
    """The sample of one term at position k, comparable over the terms of a text."""
    first, second, third = (F.xxhash64(term, F.lit(SEED + 3 * k + i)) for i in range(3))
    r = -F.log(_uniform(first) * _uniform(F.shiftrightunsigned(first, 32)))
    ln_c = F.log(-F.log(_uniform(second) * _uniform(F.shiftrightunsigned(second, 32))))
    b = _uniform(third)
    t = F.floor(F.log(weight.cast("double")) / r + b)
    rank = F.floor((ln_c - r * (t - b) - r) * STEPS)
    return F.shiftleft(rank, 32) + F.xxhash64(term, t).bitwiseAND(F.lit(0xFFFFFFFF))


def samples_of(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and ``samples``, array<long>, of each text with words; no shuffle if ``texts`` is partitioned by some of the keys."""
    words = texts.select(*keys, F.explode(F.split(F.col(text), r"\s+")).alias("word")).filter("word != ''")
    counted = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))
    least = [F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(SAMPLES)]
    return counted.groupBy(*keys).agg(*least).select(*keys, F.array(*[f"s{k}" for k in range(SAMPLES)]).alias("samples"))


def as_text(samples: Column) -> Column:
    digits = F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFF)))), 4, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(EMPTY))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal positions of two fingerprints."""
    ks = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.filter(ks, lambda k: F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4)))
    either_empty = (a == EMPTY) | (b == EMPTY)
    return F.when(either_empty, (a == b).cast("double")).otherwise(F.size(same) / F.lit(float(SAMPLES)))


def _constant(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _parsed(values: list[str], kind: str) -> Column:
    """A constant array of values that were written as JSON."""
    return F.from_json(F.lit("[" + ",".join(values) + "]"), f"array<{kind}>")


def _split_points(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys, descending and as JSON, that cut the rows into about equal shares: from a sample by hash."""
    tie = F.pmod(F.xxhash64("key.id", "key.h"), F.lit(1 << 30))
    share = min(1.0, SPLIT_SAMPLE * ranges / max(1, keys.count()))
    chosen = keys.filter(tie < int(share * (1 << 30))).distinct().orderBy(F.desc("key")).limit(2 * SPLIT_SAMPLE * ranges)
    sample = [r.key for r in chosen.select(F.to_json("key").alias("key")).collect()]
    return list(dict.fromkeys(sample[i * len(sample) // ranges] for i in range(1, ranges) if sample))


def _points_from(value: Column, points: list[str], kind: str) -> Column:
    """How many of the descending ``points`` are no smaller than ``value``, by halving."""
    steps = [1 << i for i in reversed(range(len(points).bit_length()))]
    descending = _parsed(points, kind)

    def halve(at: Column, step: Column) -> Column:
        further = F.when(at + step <= len(points), F.element_at(descending, F.least(at + step, F.lit(len(points)))) >= value).otherwise(False)
        return F.when(further, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(step) for step in steps]), F.lit(0), halve) if points else F.lit(0)


def ordered(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` (id, text) in descending order of id without a sort in one task.

    Returns range, place (0 for the largest id), next_place, id, text and the next document's text; the last is followed by the
    first. Ranges of ids meet in one partition each; the first rows of a range are copied into the range before it, so every row
    finds its successor where it is. Equal ids are ordered by text; null ids come last.
    """
    ranges = RANGES_PER_PARTITION * partitions(docs.sparkSession)
    # Rows stand in descending order of this key: by id, then by hash of the text, null ids last. Equal ids can be cut apart.
    keyed = docs.select(F.col(id_col).alias("id"), "text", F.struct(F.col(id_col).alias("id"), F.bitwise_not(F.xxhash64("text")).alias("h")).alias("key"))
    key_type = f"struct<id:{keyed.schema['id'].dataType.simpleString()},h:bigint>"
    points = _split_points(keyed.select("key"), ranges)
    placed = keyed.select(_points_from(F.col("key"), points, key_type).cast("int").alias("range"), "key", "id", "text")
    # Range 0 holds the largest keys.
    sizes = sorted(tuple(r) for r in placed.groupBy("range").agg(F.count(F.lit(1)), F.to_json(F.max("key"))).collect())
    if not sizes:
        return placed.select("range", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("next_place"), "id", "text", F.lit("").alias("next_text"))
    # Of each range: the place of its first row, the key that begins it, and the range before it; before the first stands the last.
    starts, heads, befores = [0] * (len(points) + 1), ["null"] * (len(points) + 1), [0] * (len(points) + 1)
    at = 0
    for i, (number, size, head) in enumerate(sizes):
        starts[number], heads[number], befores[number] = at, head, sizes[i - 1][0]
        at += size
    of_range = lambda values: F.element_at(_constant(values), F.col("range") + 1)
    head = F.element_at(_parsed(heads, key_type), F.col("range") + 1)
    copied = F.col("key").eqNullSafe(head)
    here = F.struct(F.col("range"), F.lit(False).alias("ahead"))
    ahead = F.struct(of_range(befores).cast("int").alias("range"), F.lit(True).alias("ahead"))
    dealt = placed.select(F.explode(F.when(copied, F.array(here, ahead)).otherwise(F.array(here))).alias("to"), "id", "text")
    dealt = dealt.select("to.range", "to.ahead", "id", "text").repartition(partitions(docs.sparkSession), "range")
    window = Window.partitionBy("range").orderBy("ahead", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    rows = dealt.select("*", F.row_number().over(window).alias("n"), F.lead("text").over(window).alias("next_text")).filter("NOT ahead")
    place = of_range(starts) + F.col("n") - 1
    return rows.select("range", place.alias("place"), ((place + 1) % F.lit(at)).alias("next_place"), "id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The last half of ``text`` replaced by as much of the start of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), other.substr(F.lit(1), half))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next document's."""
    rows = ordered(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")), id_col)
    rows = rows.select("range", "place", "next_place", "id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    facts = rows.select("place", "next_place", "id", F.length("text").cast("long").alias("n_chars"), sha256_of(F.col("edited")).alias("edited_sha256"))
    sides = rows.select("range", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("of")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("of")))).alias("x"))
    prints = samples_of(sides.select("range", "place", "x.side", "x.of"), ["range", "place", "side"], "of")
    own, changed = (F.max(F.when(F.col("side") == side, as_text(F.col("samples")))) for side in (0, 1))
    prints = prints.groupBy("range", "place").agg(own.alias("fingerprint"), changed.alias("edited_fingerprint")).drop("range")
    # Written once: each fingerprint is read for its own row and for the row before it.
    known = materialize(facts.join(prints, "place", "left"), "fingerprints")
    following = known.select(F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    joined = known.join(following, "next_place", "left")
    names = ("fingerprint", "edited_fingerprint", "next_fingerprint")
    joined = joined.select("id", "n_chars", "edited_sha256", *[F.coalesce(F.col(c), F.lit(EMPTY)).alias(c) for c in names])
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
