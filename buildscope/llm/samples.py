"""Bounded samples of labelled rows, to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 1 << 30


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo: what folds are cut by. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def sampled_labels(labels: DataFrame, most_rows: int) -> DataFrame:
    """Of distinct (id, label) rows about twice ``most_rows``, as many of each label, by hash of the id; never over four times as many."""
    rows = labels.dropna().distinct().select("*", F.pmod(F.xxhash64("id"), F.lit(HASHES)).alias("hash"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.lit(False)
    for value, n in sizes.items():
        wanted = wanted | ((F.col("label") == F.lit(value)) & (F.col("hash") < int(min(1.0, 2 * most_rows / len(sizes) / n) * HASHES)))
    return rows.filter(wanted).select("id", "label").limit(4 * most_rows)


def labelled_sample(rows: DataFrame, label: str, text: str, most_rows: int, most_chars: int) -> list[tuple[str, object]]:
    """At most ``most_rows`` pairs of text and label, about as many of each label, chosen by hash of the text.

    Every row is counted, and rows of equal text are one. Texts over ``most_chars`` characters are not learned from, so the sample
    fits the driver: both bounds are parameters of the fit and do not concern what is predicted.
    """
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text")).dropna().filter(F.length("text").between(1, most_chars))
    rows = rows.select("*", F.pmod(F.xxhash64("text"), F.lit(HASHES)).alias("hash"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return []
    share = most_rows // len(sizes)
    wanted = F.lit(False)
    for value, n in sizes.items():
        # A little more than the share; the surplus is cut below.
        wanted = wanted | ((F.col("label") == F.lit(value)) & (F.col("hash") < int(min(1.0, 1.2 * share / n) * HASHES)))
    chosen = rows.filter(wanted).dropDuplicates(["text"]).orderBy("hash", "text").limit(2 * most_rows).select("label", "text")
    taken: dict[object, int] = {}
    out = []
    for row in chosen.collect():
        taken[row.label] = taken.get(row.label, 0) + 1
        if taken[row.label] <= share:
            out.append((row.text, row.label))
    return out
