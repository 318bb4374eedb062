"""URL filters: a sort-merge range join of urls with allow and block rules.

The canonical key of a host is its labels reversed, each followed by a dot (``a.example.org`` -> ``org.example.a.``). A rule for a
host and all its subdomains is then the interval of keys that start with the rule's key, and intervals are nested or disjoint. Urls
and rules are sorted together; one sweep keeps the stack of rules whose interval holds the current key. Each level of the stack
finds its longest path that starts the url's path, and the longest rule of all levels wins.

The sorted order is cut into ranges at split points taken from a bounded sample of urls, which decides only the layout. A rule is
copied into every range that its interval meets, so ranges are swept independently. The split key ends in a hash of the row, so one
host, or one url, that fills a third of the table is spread over many ranges.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; equal urls get equal verdicts, row by
row; of equal rules with different verdicts, block wins; rules with a null host, path or verdict are ignored; among rules of equal
length the longer host wins. Only the id and the results come back, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildscope.llm.common import partitions

# Urls read to choose split points. They decide the layout of the sweep, never a result.
SPLIT_SAMPLE = 4_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, the winning rule (host and path joined) or null, verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.xxhash64(id_col, url_col).alias("tie"))
    urls = urls.select("*", host_key(F.col("host")).alias("key"))
    place = F.concat_ws("\0", "key", "path", F.hex("tie"))
    ranges = 4 * partitions(spark)
    bounds = _split_points(urls.select(place.alias("place"), "tie"), ranges)

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return places.map(lambda p: bisect_right(bounds, p)).astype("int32")

    rules = (
        rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", host_key(F.col("host")).alias("key"))
        .withColumn("range", F.explode(F.sequence(range_of(F.col("key")), range_of(F.concat("key", F.lit(LAST))))))
    )
    id_type = urls.schema["id"].dataType.simpleString()
    events = urls.select(range_of(place).alias("range"), "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    opened = rules.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict")
    swept = (
        events.unionByName(opened)
        .repartition(partitions(spark), "range")
        .sortWithinPartitions("range", "key", "kind", "path")
        .mapInArrow(lambda batches: _sweep(batches, default), f"id {id_type}, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("id", id_col)


def _split_points(places: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` keys that cut the urls into about equal shares, from a sample by hash that is small before it is sent."""
    share = min(1.0, SPLIT_SAMPLE / max(1, places.count()))
    chosen = places.filter(F.pmod("tie", F.lit(1 << 30)) < int(share * (1 << 30))).select("place").limit(2 * SPLIT_SAMPLE)
    sample = sorted(r.place for r in chosen.collect())
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))


class _Level:
    """The rules of one host on the stack, by length of path."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host = key, host
        self.rules: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        self.rules[path] = verdict
        self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if path[:n] in self.rules), None)


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Verdicts of the urls among the rows. Ids are taken over as they are, never turned into Python or pandas values."""
    stack: list[_Level] = []
    current = None
    names = ["range", "key", "kind", "host", "path", "verdict"]
    for batch in batches:
        found: list[tuple] = []
        for at, (part, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            if part != current:
                current, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Level(key, host))
                stack[-1].add(path, verdict)
                continue
            best = None
            for level in stack:
                longest = level.longest(path)
                if longest is not None and (best is None or len(level.host) + len(longest) >= best[0]):
                    best = (len(level.host) + len(longest), level.host + longest, level.rules[longest])
            found.append((at, host, path, best and best[1], best[2] if best else default))
        texts = [pa.array([f[i] for f in found], pa.string()) for i in range(1, 5)]
        ids = batch.column("id").take(pa.array([f[0] for f in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *texts], ["id", "host", "path", "rule", "verdict"])
