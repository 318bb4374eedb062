"""From outlier scores to flags, probabilities and reports.

These operators take any table with a score where lower means more unusual.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildscope.operators.portfolio import contamination
from buildscope.plans.quantiles import exact_quantiles, quantile_name
from buildscope.plans.tables import materialize
from buildscope.schemas import ANOMALIES


def score_ranges(scored: DataFrame) -> DataFrame:
    """Lowest and highest score per model."""
    return scored.groupBy("model_id").agg(
        F.min("anomaly_score").alias("_min_score"), F.max("anomaly_score").alias("_max_score")
    )


def score_limits(
    scored: DataFrame, share: float | Callable[[Column], Column] = contamination, sizes: DataFrame | None = None
) -> DataFrame:
    """Per model the expected share of outliers and the score below which an element is flagged.

    ``share`` is that share, or a function from the element count of a model to it.
    ``sizes`` (model_id, element_count) gives the count where the scored rows are not
    all elements. A model without a share is left out.
    """
    if sizes is None:
        sizes = scored.groupBy("model_id").agg(F.count(F.lit(1)).alias("element_count"))
    wanted = (share(F.col("element_count")) if callable(share) else F.lit(share)).cast("double")
    # The shares that occur; a function of the size should have few.
    shares = sorted(r[0] for r in sizes.select(wanted.alias("share")).distinct().dropna().collect())
    quantiles = exact_quantiles(scored, ["anomaly_score"], shares)
    offset = F.lit(None).cast("double")
    for value in shares:
        offset = F.when(wanted == value, F.col(f"`{quantile_name('anomaly_score', value)}`")).otherwise(offset)
    return (
        sizes.join(quantiles, "model_id")
        .select("model_id", wanted.alias("contamination"), offset.alias("offset"))
        .filter(F.col("contamination").isNotNull())
    )


def probability(score: Column, low: Column, high: Column) -> Column:
    """1 for the lowest score, 0 for the highest, 0.5 where all scores are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise(F.lit(1.0) - (score - low) / (high - low))


def flag_anomalies(
    scored: DataFrame,
    share: float | Callable[[Column], Column] = contamination,
    limits: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``is_anomaly`` and ``anomaly_probability`` to scored rows.

    ``limits`` from an earlier fit fixes the flagging score; the probability range is
    always that of the rows at hand. Models too small for a share are left out.
    """
    if limits is None:
        limits = score_limits(scored, share, sizes)
    current = materialize(score_ranges(scored).join(limits, "model_id"), "score-limits")
    joined = scored.join(current, "model_id")
    return joined.select(
        *scored.columns,
        (F.col("anomaly_score") < F.col("offset")).alias("is_anomaly"),
        probability(F.col("anomaly_score"), F.col("_min_score"), F.col("_max_score")).alias("anomaly_probability"),
    )


def get_anomalies(anomalies: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows with at least the given probability; without a threshold, every row."""
    if threshold is None:
        return anomalies
    return anomalies.filter(F.col("anomaly_probability") >= threshold)


def to_anomalies(flagged: DataFrame) -> DataFrame:
    """The columns of the ``ANOMALIES`` schema."""
    return flagged.select(*ANOMALIES.fieldNames())


def most_probable(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows of each model with the highest probability."""
    order = Window.partitionBy("model_id").orderBy(F.desc("anomaly_probability"), "global_id", "ifc_type")
    return anomalies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def anomalies_by_type(anomalies: DataFrame, elements: DataFrame, n: int = 5) -> DataFrame:
    """Per model the ``n`` types with the most flagged elements, and their share of all elements of the type."""
    flagged = (
        anomalies.filter("is_anomaly").groupBy("model_id", "ifc_type").agg(F.count(F.lit(1)).alias("anomaly_count"))
    )
    order = Window.partitionBy("model_id").orderBy(F.desc("anomaly_count"), "ifc_type")
    top = flagged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    totals = elements.groupBy("model_id", "ifc_type").agg(F.count(F.lit(1)).alias("type_count"))
    return top.join(totals, ["model_id", "ifc_type"]).withColumn(
        "pct_of_type", F.col("anomaly_count") / F.col("type_count") * 100.0
    )


# Lower bounds of high and medium confidence.
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.6


def anomaly_confidence(anomalies: DataFrame) -> DataFrame:
    """Per model: probability statistics of the flagged rows and their number per confidence band."""
    p = F.col("anomaly_probability")
    high, medium = p >= HIGH_CONFIDENCE, p >= MEDIUM_CONFIDENCE
    return (
        anomalies.filter("is_anomaly")
        .groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.avg(p).alias("mean_probability"),
            F.max(p).alias("max_probability"),
            F.min(p).alias("min_probability"),
            F.count_if(high).alias("high_confidence"),
            F.count_if(medium & ~high).alias("medium_confidence"),
            F.count_if(~medium).alias("low_confidence"),
        )
    )
