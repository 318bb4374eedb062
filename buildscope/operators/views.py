"""The tables behind the dashboard charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildscope.operators.metrics import issue_counts, model_summary, pareto
from buildscope.operators.portfolio import FAILURE, anomaly_counts, successes
from buildscope.plans.quantiles import overall_quantiles, quantile_name
from buildscope.plans.tables import materialize

# Display order of the severities.
SEVERITY_ORDER = {"critical": 0, "major": 1, "minor": 2}


def quality_ranking(results: DataFrame) -> DataFrame:
    """Successful models, lowest score first."""
    return successes(results).select("model_name", "quality_score").orderBy("quality_score", "model_name")


def critical_or_total_top(results: DataFrame, n: int = 10) -> DataFrame:
    """Models with the most critical issues; with no critical issue anywhere, with the most issues."""
    good = successes(results).select("model_name", "critical_issues", "total_issues")
    by_critical = good.agg(F.max("critical_issues") > 0).scalar()
    return (
        good.withColumn("_critical", by_critical)
        .filter(~F.col("_critical") | (F.col("critical_issues") > 0))
        .select(
            "model_name",
            F.when(F.col("_critical"), F.col("critical_issues")).otherwise(F.col("total_issues")).alias("issue_count"),
            F.when(F.col("_critical"), F.lit("critical_issues")).otherwise(F.lit("total_issues")).alias("ranked_by"),
        )
        .orderBy(F.desc("issue_count"), "model_name")
        .limit(n)
    )


def issue_rate_histogram(results: DataFrame, bins: int = 20) -> DataFrame:
    """Models per bin of equal width between the lowest and the highest issue rate."""
    rates = successes(results).select(F.col("issue_rate_per_1k").alias("_rate"))
    span = rates.agg(
        F.min("_rate").alias("low"), ((F.max("_rate") - F.min("_rate")) / float(bins)).alias("width")
    )
    edges = span.select(F.struct("low", "width")).scalar()
    low, width = F.col("_edges.low"), F.col("_edges.width")
    bin_of = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_rate") - low) / width))).otherwise(F.lit(0))
    counted = (
        rates.withColumn("_edges", edges)
        .groupBy(bin_of.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("model_count"))
    )
    # A fixed number of rows, empty bins included.
    all_bins = span.filter(F.col("low").isNotNull()).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "low", "width"
    )
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("model_count", F.lit(0)).alias("model_count"),
    )


def issue_rate_percentiles(results: DataFrame) -> DataFrame:
    results = materialize(successes(results).select("issue_rate_per_1k"), "issue-rates")
    ranks = overall_quantiles(results, ["issue_rate_per_1k"], [0.5, 0.95])
    return results.agg(*[F.first(ranks[quantile_name("issue_rate_per_1k", prob)]).alias(name) for prob, name in ((0.5, "p50"), (0.95, "p95"))])


def anomaly_rate_top(results: DataFrame, n: int = 10) -> DataFrame:
    """Models with the highest outlier rate, in percent."""
    return (
        successes(results)
        .filter(F.col("anomaly_count") > 0)
        .select("model_name", "anomaly_rate", (F.col("anomaly_rate") * 100.0).alias("anomaly_pct"))
        .orderBy(F.desc("anomaly_rate"), "model_name")
        .limit(n)
    )


def portfolio_pareto(issues: DataFrame) -> DataFrame:
    """Share and running share of the issue types across all models."""
    totals = issue_counts(issues).groupBy("issue_type").agg(F.sum("count").alias("count"))
    return pareto(totals, key=None)


def top_offender_models(results: DataFrame, n: int = 10) -> DataFrame:
    return (
        successes(results)
        .select("model_name", "quality_score", "critical_issues", "total_issues", "issue_rate_per_1k", "element_count")
        .orderBy(F.desc("total_issues"), "model_name")
        .limit(n)
    )


def failed_models(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == FAILURE).select("model_name", "error_message")


def one_model(table: DataFrame, model_id: str) -> DataFrame:
    return table.filter(F.col("model_id") == model_id)


def model_drilldown(
    features: DataFrame, issues: DataFrame, model_id: str, anomalies: DataFrame | None = None
) -> DataFrame:
    """KPIs of one model from tables of features, issues and anomalies.

    The filter reaches scans of stored tables. Issues or anomalies that are still to be derived must be derived from
    ``one_model`` of the features, or the work is done for every model.
    """
    this = F.col("model_id") == model_id
    summary = model_summary(features.filter(this), issues.filter(this))
    if anomalies is None:
        return summary
    total = F.greatest(F.lit(1), F.col("total_elements"))
    return summary.join(anomaly_counts(anomalies.filter(this)), "model_id", "left").withColumn(
        "anomaly_rate_pct", F.col("anomaly_count") / total * 100.0
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, order in SEVERITY_ORDER.items():
        rank = F.when(severity == name, F.lit(order)).otherwise(rank)
    return rank


def top_issues(issues: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` issues of each model, most severe first, an unknown severity last."""
    order = Window.partitionBy("model_id").orderBy(
        F.asc_nulls_last("_severity"), "global_id", "issue_type", "message", "ifc_type", "element_name"
    )
    return (
        issues.withColumn("_severity", severity_rank(F.col("severity")))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            "model_id", "rank", "severity", "issue_type", "ifc_type", "global_id", "element_name", "message"
        )
    )


def top_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` flagged elements of each model with the lowest score."""
    order = Window.partitionBy("model_id").orderBy("anomaly_score", "global_id", "ifc_type")
    return (
        anomalies.filter(F.col("is_anomaly"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            "model_id",
            "rank",
            "ifc_type",
            "global_id",
            "anomaly_score",
            F.bround(F.col("anomaly_probability") * 100.0, 1).alias("anomaly_probability_pct"),
        )
    )


def quality_gate(scores: DataFrame, threshold: float = 80.0, score: str = "quality_score") -> DataFrame:
    """PASS for a score at or above the threshold, else FAIL."""
    return scores.withColumn("gate", F.when(F.col(score) >= threshold, F.lit("PASS")).otherwise(F.lit("FAIL")))
