"""Metrics and scoring per model.

Everything is derived from two small aggregates: element totals per model, and issue
counts per (model, element type, issue type, severity).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildscope.functions.columns import blank
from buildscope.plans.tables import materialize

# Weight of an issue in the quality score.
SEVERITY_WEIGHTS = {"critical": 3.0, "major": 2.0, "minor": 1.0}
UNKNOWN_WEIGHT = 1.0
SEVERITIES = ("critical", "major", "minor")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issue counts per (model, element type, issue type, severity); missing columns are null."""
    kept = [
        F.col(c) if c in issues.columns else F.lit(None).cast("string").alias(c)
        for c in ("ifc_type", "issue_type", "severity")
    ]
    return (
        issues.select("model_id", *kept)
        .groupBy("model_id", "ifc_type", "issue_type", "severity")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def severity_weight(severity: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Weight of a severity, matched in lower case; an unknown severity weighs 1."""
    weight = F.lit(UNKNOWN_WEIGHT)
    for name, value in (weights or SEVERITY_WEIGHTS).items():
        weight = F.when(F.lower(severity) == name, F.lit(float(value))).otherwise(weight)
    return weight


def quality_score(total: Column, weighted: Column) -> Column:
    score = F.lit(100.0) - weighted / total * 100.0
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(F.lit(0.0))


def issue_rate_per_1000(total: Column, issues: Column) -> Column:
    return F.when(total > 0, issues / total * 1000.0).otherwise(F.lit(0.0))


def metadata_completeness(elements: DataFrame) -> DataFrame:
    """Per model: elements and the percentage with name, object type and geometry.

    Empty text counts as missing; a column the table lacks counts as 0 %.
    """

    def present(column: str) -> Column:
        if column not in elements.columns:
            return F.lit(0.0)
        return F.avg(F.when(blank(F.col(column)), 0.0).otherwise(1.0)) * 100.0

    geometry = (
        F.avg(F.col("has_geometry").cast("double")) * 100.0 if "has_geometry" in elements.columns else F.lit(0.0)
    )
    return elements.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_elements"),
        present("name").alias("name_pct"),
        present("object_type").alias("object_type_pct"),
        F.coalesce(geometry, F.lit(0.0)).alias("geometry_pct"),
    )


def severity_totals(counts: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Per model with issues: total, the three severities (matched exactly) and the weighted sum."""
    n = F.col("count")
    return counts.groupBy("model_id").agg(
        F.sum(n).alias("total_issues"),
        *[F.sum(F.when(F.col("severity") == s, n).otherwise(0)).alias(s) for s in SEVERITIES],
        F.sum(severity_weight(F.col("severity"), weights) * n).alias("weighted_issues"),
    )


def severity_breakdown(elements: DataFrame, issues: DataFrame) -> DataFrame:
    """Per model of ``elements``: counts of the three severities, zero when there are none."""
    models = elements.groupBy("model_id").agg(F.count(F.lit(1)).alias("_rows")).select("model_id")
    found = severity_totals(issue_counts(issues))
    return models.join(found, "model_id", "left").select(
        "model_id", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES]
    )


def model_summary(elements: DataFrame, issues: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row per model with every scalar metric."""
    return _summary(metadata_completeness(elements), issue_counts(issues), weights)


def _summary(totals: DataFrame, counts: DataFrame, weights: Mapping[str, float] | None) -> DataFrame:
    joined = totals.join(severity_totals(counts, weights), "model_id", "left").fillna(
        0, ["total_issues", *SEVERITIES, "weighted_issues"]
    )
    total = F.col("total_elements")
    return joined.select(
        "model_id",
        "total_elements",
        quality_score(total, F.col("weighted_issues")).alias("quality_score"),
        "total_issues",
        issue_rate_per_1000(total, F.col("total_issues")).alias("issue_rate_per_1000"),
        "name_pct",
        "object_type_pct",
        "geometry_pct",
        *SEVERITIES,
    )


def quality_scores(elements: DataFrame, issues: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    return model_summary(elements, issues, weights).select("model_id", "total_elements", "total_issues", "quality_score")


def issues_by(counts: DataFrame, column: str) -> DataFrame:
    """Issue counts per model and value of ``column``; nulls are not counted."""
    return (
        counts.filter(F.col(column).isNotNull()).groupBy("model_id", column).agg(F.sum("count").alias("count"))
    )


def top_offenders(issues: DataFrame, group_col: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` most frequent values per model, ties by value."""
    return _ranked(issues_by(issue_counts(issues), group_col), group_col, top_n)


def _ranked(counted: DataFrame, column: str, top_n: int) -> DataFrame:
    order = Window.partitionBy("model_id").orderBy(F.desc("count"), column)
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def pareto(counted: DataFrame, column: str = "issue_type", key: str | None = "model_id") -> DataFrame:
    """Share and running share of each issue type, most frequent first.

    The windows run over one row per issue type and model, never over issues.
    """
    keys = [key] if key else []
    group = Window.partitionBy(*keys)
    running = group.orderBy(F.desc("count"), column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("count").over(group)
    return counted.select(
        *keys,
        column,
        "count",
        (F.col("count") / total).alias("pct"),
        (F.sum("count").over(running) / total).alias("cum_pct"),
        F.row_number().over(group.orderBy(F.desc("count"), column)).alias("rank"),
    )


def pareto_issue_types(issues: DataFrame, top_n: int | None = None) -> DataFrame:
    table = pareto(issues_by(issue_counts(issues), "issue_type"))
    return table if top_n is None else table.filter(F.col("rank") <= top_n)


# The metrics of the report, in its order.
KPI_METRICS = (
    "total_elements", "quality_score", "total_issues", "issue_rate_per_1000",
    "name_pct", "object_type_pct", "geometry_pct", "critical", "major", "minor",
)


def kpi_long(summary: DataFrame) -> DataFrame:
    """Ten (metric, value) rows per model."""
    return summary.select("model_id", *[F.col(m).cast("double").alias(m) for m in KPI_METRICS]).unpivot(
        "model_id", list(KPI_METRICS), "metric", "value"
    )


def severity_frame(summary: DataFrame) -> DataFrame:
    """Three rows per model in the order critical, major, minor."""
    return summary.select("model_id", *SEVERITIES).unpivot("model_id", list(SEVERITIES), "severity", "count")


def build_metrics(
    elements: DataFrame,
    issues: DataFrame,
    *,
    severity_weights: Mapping[str, float] | None = None,
    top_n: int = 10,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The nested metrics document per model, and the long tables behind the charts.

    The issues are read once: everything else comes from their written counts.
    """
    counts = materialize(issue_counts(issues), "issue-counts")
    summary = _summary(metadata_completeness(elements), counts, severity_weights)
    by_ifc_type, by_type = issues_by(counts, "ifc_type"), issues_by(counts, "issue_type")
    table = pareto(by_type)

    def offenders(counted: DataFrame, column: str) -> DataFrame:
        top = _ranked(counted, column, top_n)
        entries = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(column).alias("key"), F.col("count"))))
        pairs = F.transform(entries, lambda e: F.struct(e["key"], e["count"]))
        return top.groupBy("model_id").agg(F.map_from_entries(pairs).alias(f"top_{column}"))

    head = (
        table.filter(F.col("rank") <= top_n)
        .groupBy("model_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "issue_type", "count", "pct", "cum_pct"))).alias("_head"))
        .select(
            "model_id",
            F.transform(
                "_head", lambda e: F.struct(e["issue_type"], e["count"], e["pct"], e["cum_pct"])
            ).alias("pareto_issue_types"),
        )
    )
    nothing = F.from_json(F.lit("{}"), "map<string,bigint>")
    no_rows = F.from_json(F.lit("[]"), "array<struct<issue_type:string,count:bigint,pct:double,cum_pct:double>>")
    document = (
        summary.join(offenders(by_ifc_type, "ifc_type"), "model_id", "left")
        .join(offenders(by_type, "issue_type"), "model_id", "left")
        .join(head, "model_id", "left")
        .select(
            "model_id",
            "total_elements",
            "quality_score",
            "total_issues",
            F.struct(*SEVERITIES).alias("severity_breakdown"),
            "issue_rate_per_1000",
            F.struct("name_pct", "object_type_pct", "geometry_pct").alias("metadata_completeness"),
            F.struct(
                F.coalesce("top_ifc_type", nothing).alias("ifc_type"),
                F.coalesce("top_issue_type", nothing).alias("issue_type"),
            ).alias("top_offenders"),
            F.coalesce("pareto_issue_types", no_rows).alias("pareto_issue_types"),
        )
    )
    frames = {
        "kpi": kpi_long(summary),
        "severity": severity_frame(summary),
        "issues_by_ifc_type": by_ifc_type,
        "issues_by_type": by_type,
        "pareto_issue_types": table,
    }
    return document, frames
