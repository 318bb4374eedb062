"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column.

    Spark orders NaN above all numbers, so ``NaN > 1`` is true; the checks rely on
    NULL being the only missing value.
    """
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def fixed_point(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the binary value half-even (as ``%.2f``).

    ``format_string`` rounds the shortest decimal instead, and grouping separators
    must not appear, hence the explicit pattern.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def blank(column: Column) -> Column:
    """Null or empty text. White space counts as text."""
    return column.isNull() | (column == "")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` with 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def distance(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)
