"""Exact quantiles per group, for groups of any size.

Three ways by the size of the group, all exact:

* small groups are brought together whole, many of them in a task, and their values
  sorted as arrays;
* larger ones are ranked by a window sort over value counts, which spills to disk;
* a group beyond ``SORT_ROWS`` is first narrowed: a mergeable sketch brackets every
  wanted rank, values below a bracket are only counted, and only the values inside are
  sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildscope.plans.tables import materialize

MAP_ROWS = 10_000
SORT_ROWS = 1_000_000
# Rows of small groups that are sorted together.
ROWS_AT_ONCE = 20_000
SKETCH_ACCURACY = 10_000
# Resolutions of the sketch by which a bracket is wider than the wanted rank on either side.
MARGIN = 2.0


def quantile_name(column: str, prob: float) -> str:
    return f"{column}_q{prob:g}"


def exact_quantiles(
    rows: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    key: str = "model_id",
    *,
    map_rows: int | None = None,
    sort_rows: int | None = None,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per key with a column ``<column>_q<prob>`` for each column and probability.

    Linear interpolation between ranks, nulls ignored; a group without values has nulls.
    The group sizes are counted first, over the key column alone.
    """
    columns, probs = list(columns), list(probs)
    map_rows = MAP_ROWS if map_rows is None else map_rows
    sort_rows = SORT_ROWS if sort_rows is None else sort_rows
    base = rows.select(key, *columns)
    sizes = base.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > map_rows)
    if sizes.isEmpty():
        return _by_sort(base, columns, probs, key)
    sizes = materialize(sizes, "group-sizes")

    def part(groups: DataFrame, how: str) -> DataFrame:
        return base.join(groups.select(key), key, how)

    found = _by_sort(part(sizes, "left_anti"), columns, probs, key)
    found = found.unionByName(
        _by_rank(part(sizes.filter(F.col("_rows") <= sort_rows), "left_semi"), columns, probs, key)
    )
    huge = sizes.filter(F.col("_rows") > sort_rows)
    if huge.isEmpty():
        return found
    return found.unionByName(
        _by_bracket(part(huge, "left_semi"), columns, probs, key, accuracy)
    )


def overall_quantiles(rows: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, Column]:
    """The same over all rows, by column name, as scalar subqueries; null without rows."""
    found = exact_quantiles(rows.select(F.lit(0).alias("_all"), *columns), columns, probs, "_all")
    row = found.select(F.struct("*").alias("_row")).scalar()
    return {name: row[name] for name in found.columns if name != "_all"}


def _by_sort(base: DataFrame, columns: list[str], probs: list[float], key: str) -> DataFrame:
    """Quantiles of groups of which each fits a task."""
    names = [quantile_name(c, p) for c in columns for p in probs]
    schema = T.StructType([base.schema[key], *[T.StructField(name, T.DoubleType(), True) for name in names]])

    def quantiles(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        out = [rows.column(0).combine_chunks().take(pa.array(starts))]
        for c in columns:
            column = rows.column(c).combine_chunks()
            present = column.is_valid().to_numpy(zero_copy_only=False)
            values, own = column.filter(pa.array(present)).to_numpy(zero_copy_only=False), group[present]
            values = values[np.lexsort((values, own))]
            n = np.bincount(own, minlength=len(starts))
            first = np.cumsum(n) - n
            for p in probs:
                at = np.where(n > 0, float(p) * (n - 1), 0.0)
                low, high = np.floor(at), np.ceil(at)
                ends = [values[np.minimum(first + place.astype(np.int64), len(values) - 1)] if len(values) else np.zeros(len(n)) for place in (low, high)]
                # The arithmetic of ``_interpolate``.
                with np.errstate(invalid="ignore", over="ignore"):
                    mixed = (high - at) * ends[0] + (at - low) * ends[1]
                out.append(pa.array(np.where((low == high) | (ends[0] == ends[1]), ends[0], mixed), mask=n == 0))
        return pa.RecordBatch.from_arrays(out, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            starts = _group_starts(rows)
            if len(starts) > 1:  # the last group may go on
                yield quantiles(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            rows = rows.combine_chunks()
            yield quantiles(rows, _group_starts(rows))

    rows = base.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Where the groups begin, of rows sorted by the first column."""
    codes = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])


def _interpolate(prob: float, n: Column, first: Column, after: Column) -> Column:
    """Value at ``prob`` from aggregated rows that cover the 0-based ranks ``first .. after - 1``.

    The arithmetic is that of ``percentile`` and ``_by_sort``, so a group's size never changes its result.
    """
    position = F.lit(float(prob)) * (n - 1)
    low, high = F.floor(position), F.ceil(position)
    at_low = F.max(F.when((first <= low) & (low < after), F.col("_value")))
    at_high = F.max(F.when((first <= high) & (high < after), F.col("_value")))
    mixed = F.max(high - position) * at_low + F.max(position - low) * at_high
    return F.when(at_low == at_high, at_low).otherwise(mixed)


def _wide(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    return [
        F.max(F.when(F.col("_column") == i, F.col(f"_p{j}"))).alias(quantile_name(c, p))
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]


def _by_rank(base: DataFrame, columns: list[str], probs: list[float], key: str) -> DataFrame:
    values = base.select(key, F.posexplode(F.array(*columns)).alias("_column", "_value"))
    # Nulls stay as one counted row, so that a group without any value still gets its row.
    counted = values.groupBy(key, "_column", "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(key, "_column")
    running = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    ranked = counted.withColumn("_after", F.sum(present).over(running)).withColumn(
        "_total", F.sum(present).over(group)
    )
    first, after, n = F.col("_after") - present, F.col("_after"), F.col("_total")
    picked = ranked.groupBy(key, "_column").agg(
        *[_interpolate(p, n, first, after).alias(f"_p{j}") for j, p in enumerate(probs)]
    )
    return picked.groupBy(key).agg(*_wide(columns, probs))


def _by_bracket(
    base: DataFrame, columns: list[str], probs: list[float], key: str, accuracy: int
) -> DataFrame:
    margin = MARGIN / accuracy
    cells = [(i, j, c, p) for i, c in enumerate(columns) for j, p in enumerate(probs)]
    summary: list[Column] = []
    for i, c in enumerate(columns):
        summary += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}")]
        edges = [min(max(p + s, 0.0), 1.0) for p in probs for s in (-margin, margin)]
        summary.append(F.percentile_approx(c, edges, accuracy).alias(f"_sketch{i}"))
    sketched = base.groupBy(key).agg(*summary)
    bounds = [F.col(key)] + [F.col(f"_n{i}") for i in range(len(columns))]
    for i, j, _, p in cells:
        # The sketch is off by at most n / accuracy ranks; below that resolution keep everything.
        trusted = F.col(f"_n{i}") > 10 * accuracy
        low = F.when(trusted & F.lit(p - margin > 0.0), F.col(f"_sketch{i}")[2 * j]).otherwise(F.col(f"_min{i}"))
        high = F.when(trusted & F.lit(p + margin < 1.0), F.col(f"_sketch{i}")[2 * j + 1]).otherwise(F.col(f"_max{i}"))
        bounds += [low.alias(f"_lo{i}_{j}"), high.alias(f"_hi{i}_{j}")]
    brackets = materialize(sketched.select(*bounds), "brackets")
    bounded = base.join(brackets, key)

    below = bounded.groupBy(key).agg(
        *[F.count(F.when(F.col(c) < F.col(f"_lo{i}_{j}"), 1)).alias(f"_below{i}_{j}") for i, j, c, _ in cells]
    )
    inside = F.array(
        *[
            F.when(
                F.col(c).between(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")),
                F.struct(F.lit(i).alias("column"), F.lit(j).alias("prob"), F.col(c).alias("value")),
            )
            for i, j, c, _ in cells
        ]
    )
    counted = (
        bounded.select(key, F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("_cell"))
        .select(
            key,
            F.col("_cell.column").alias("_column"),
            F.col("_cell.prob").alias("_prob"),
            F.col("_cell.value").alias("_value"),
        )
        .groupBy(key, "_column", "_prob", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    offsets = (
        below.join(brackets.select(key, *[f"_n{i}" for i in range(len(columns))]), key)
        .select(
            key,
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("_column"),
                            F.lit(j).alias("_prob"),
                            F.col(f"_below{i}_{j}").alias("_below"),
                            F.col(f"_n{i}").alias("_total"),
                        )
                        for i, j, _, _ in cells
                    ]
                )
            ).alias("_cell"),
        )
        .select(key, "_cell.*")
    )
    group = Window.partitionBy(key, "_column", "_prob")
    running = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_inside", F.sum("_n").over(running)).join(
        offsets, [key, "_column", "_prob"], "right"
    )
    after = F.col("_below") + F.col("_inside")
    first = after - F.col("_n")
    wanted = reduce(
        lambda chosen, item: F.when(F.col("_prob") == item[0], item[1]).otherwise(chosen),
        [(j, _interpolate(p, F.col("_total"), first, after)) for j, p in enumerate(probs)],
        F.lit(math.nan),
    )
    # The ranks around the wanted one must lie inside the bracket, or the sketch was off by more than it promises.
    low, high = F.floor(_position(probs) * (F.col("_total") - 1)), F.ceil(_position(probs) * (F.col("_total") - 1))
    missed = (F.col("_total") > 0) & ((F.max("_inside") + F.max("_below") <= F.max(high)) | (F.max("_below") > F.max(low)))
    picked = ranked.groupBy(key, "_column", "_prob", "_total").agg(wanted.alias("_picked"), F.coalesce(missed, F.lit(True)).alias("_missed"))
    picked = materialize(picked, "picked")
    again = picked.filter((F.col("_total") > 0) & F.col("_missed")).select(key).distinct()
    if not again.isEmpty():
        # Such a group is sorted whole.
        found = _wide_by_prob(picked.join(again, key, "left_anti"), cells, key)
        return found.unionByName(_by_rank(base.join(again, key, "left_semi"), columns, probs, key))
    return _wide_by_prob(picked, cells, key)


def _position(probs: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_prob") + 1)


def _wide_by_prob(picked: DataFrame, cells: list[tuple], key: str) -> DataFrame:
    return picked.groupBy(key).agg(
        *[
            F.max(F.when((F.col("_column") == i) & (F.col("_prob") == j), F.col("_picked"))).alias(
                quantile_name(c, p)
            )
            for i, j, c, p in cells
        ]
    )
