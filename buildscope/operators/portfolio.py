"""Portfolio roll-up: one row per model, then one row overall.

Inputs after ``model_results`` have one row per model, so their exact percentiles and
top lists are over models, not elements. The roll-ups read such a table several times and
write it first, unless it is a written one.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildscope.operators.checks import Limits, SEVERITY_OF, count_issues_by_model, severity_counts
from buildscope.operators.metrics import (
    SEVERITIES,
    SEVERITY_WEIGHTS,
    issue_rate_per_1000,
    metadata_completeness,
    quality_score,
)
from buildscope.plans.quantiles import overall_quantiles, quantile_name
from buildscope.plans.tables import materialize
from buildscope.schemas import MODEL_RESULTS

SUCCESS, FAILURE = "success", "failure"

# Expected share of outliers by model size, and the size a model must exceed.
CONTAMINATION_BANDS = ((1000, 0.02), (500, 0.03))
CONTAMINATION_SMALL = 0.05
MIN_ELEMENTS_FOR_ML = 10


def contamination(element_count: Column) -> Column:
    """Expected outlier share of a model; null where it has too few elements to learn from."""
    share = F.lit(CONTAMINATION_SMALL)
    for bound, value in sorted(CONTAMINATION_BANDS):
        share = F.when(element_count > bound, F.lit(value)).otherwise(share)
    return F.when(element_count > MIN_ELEMENTS_FOR_ML, share)


def adaptive_contamination(elements: DataFrame) -> DataFrame:
    sizes = elements.groupBy("model_id").agg(F.count(F.lit(1)).alias("element_count"))
    return sizes.withColumn("contamination", contamination(F.col("element_count")))


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("model_id").agg(F.count_if("is_anomaly").alias("anomaly_count"))


def model_scores(features: DataFrame, weights: Mapping[str, float] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Score of each model from counted issues; the issue rows are not made."""
    weights = {**SEVERITY_WEIGHTS, **(weights or {})}
    counts = count_issues_by_model(features, limits)
    counted = counts.select("model_id", F.col("element_count").alias("total_elements"), *[severity_counts(s).alias(s) for s in SEVERITIES])
    issues = reduce(lambda a, b: a + b, [F.col(s) for s in SEVERITIES])
    weighted = reduce(lambda a, b: a + b, [F.col(s) * F.lit(weights[s]) for s in SEVERITIES])
    return counted.select(
        "model_id", "total_elements", issues.alias("total_issues"), quality_score(F.col("total_elements"), weighted).alias("quality_score")
    )


def model_results(
    features: DataFrame,
    anomalies: DataFrame | None = None,
    runtime: Column | None = None,
    limits: Limits = Limits(),
    paths: DataFrame | None = None,
) -> DataFrame:
    """One success row per model in the ``MODEL_RESULTS`` schema.

    ``paths`` (model_id, path) gives where models came from, else a path is made from the id.
    A runtime that was not measured is null.

    Issues are counted, not made: two aggregations over the element table and joins of
    one-row-per-model results.
    """
    counts = count_issues_by_model(features, limits)
    completeness = metadata_completeness(features).drop("total_elements")
    joined = counts.join(completeness, "model_id")
    if anomalies is not None:
        joined = joined.join(anomaly_counts(anomalies), "model_id", "left")
    else:
        joined = joined.withColumn("anomaly_count", F.lit(None).cast("long"))
    if paths is not None:
        joined = joined.join(paths.select("model_id", "path"), "model_id", "left")
    else:
        joined = joined.withColumn("path", F.concat("model_id", F.lit(".ifc")))
    total = F.col("element_count")
    joined = joined.select(
        "*", *[severity_counts(s).alias(f"{s}_issues") for s in SEVERITIES]
    ).withColumn("total_issues", sum((F.col(t) for t in list(SEVERITY_OF)[1:]), F.col(list(SEVERITY_OF)[0])))
    weighted = sum(
        (F.col(f"{s}_issues") * F.lit(SEVERITY_WEIGHTS[s]) for s in SEVERITIES[1:]),
        F.col(f"{SEVERITIES[0]}_issues") * F.lit(SEVERITY_WEIGHTS[SEVERITIES[0]]),
    )
    return joined.select(
        F.col("model_id").alias("model_name"),
        F.col("path").alias("model_path"),
        F.lit(SUCCESS).alias("status"),
        total.alias("element_count"),
        "total_issues",
        *[f"{s}_issues" for s in SEVERITIES],
        quality_score(total, weighted).alias("quality_score"),
        issue_rate_per_1000(total, F.col("total_issues")).alias("issue_rate_per_1k"),
        ((F.col("name_pct") + F.col("object_type_pct") + F.col("geometry_pct")) / 3.0).alias(
            "metadata_completeness_pct"
        ),
        "anomaly_count",
        (F.col("anomaly_count") / total).alias("anomaly_rate"),
        (runtime if runtime is not None else F.lit(None)).cast("double").alias("runtime_seconds"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"),
        F.lit(None).cast("string").alias("error_message"),
    )


def failure_results(failures: DataFrame) -> DataFrame:
    """Failure rows from (model_name, model_path, error_message): zeros and the message."""
    fixed = {
        "status": F.lit(FAILURE),
        "anomaly_count": F.lit(None),
        "anomaly_rate": F.lit(None),
        "processed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    }
    given = {"model_name", "model_path", "error_message"}
    return failures.select(
        *[
            (F.col(f.name) if f.name in given else fixed.get(f.name, F.lit(0))).cast(f.dataType).alias(f.name)
            for f in MODEL_RESULTS.fields
        ]
    )


def with_failures(results: DataFrame, failures: DataFrame) -> DataFrame:
    return results.unionByName(failure_results(failures))


def successes(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == SUCCESS)


def _written(results: DataFrame) -> DataFrame:
    return results if hasattr(results, "_scratch_path") else materialize(results, "results")


def portfolio_kpis(results: DataFrame) -> DataFrame:
    """One row of portfolio KPIs; no row for an empty portfolio.

    Without any successful model only the three counts are set.
    """
    results = _written(results)
    ok = F.col("status") == SUCCESS
    ranks = overall_quantiles(successes(results), ["quality_score", "issue_rate_per_1k", "runtime_seconds"], [0.5, 0.95])

    def rank(column: str, prob: float) -> Column:
        return F.first(ranks[quantile_name(column, prob)])

    def of(column: str) -> Column:
        return F.when(ok, F.col(column))

    success = F.count_if(ok)
    return (
        results.agg(
            F.count(F.lit(1)).alias("total_models"),
            success.alias("success_models"),
            F.count_if(~ok).alias("failed_models"),
            F.when(success > 0, success / F.count(F.lit(1))).alias("success_rate"),
            F.avg(of("quality_score")).alias("avg_quality_score"),
            rank("quality_score", 0.5).alias("median_quality_score"),
            F.min(of("quality_score")).alias("min_quality_score"),
            F.max(of("quality_score")).alias("max_quality_score"),
            F.stddev_samp(of("quality_score")).alias("std_quality_score"),
            F.sum(of("total_issues")).alias("total_issues"),
            F.sum(of("critical_issues")).alias("total_critical_issues"),
            F.sum(of("major_issues")).alias("total_major_issues"),
            F.sum(of("minor_issues")).alias("total_minor_issues"),
            F.avg(of("issue_rate_per_1k")).alias("avg_issue_rate_per_1k"),
            rank("issue_rate_per_1k", 0.5).alias("median_issue_rate_per_1k"),
            rank("issue_rate_per_1k", 0.95).alias("p95_issue_rate_per_1k"),
            F.sum(of("element_count")).alias("total_elements"),
            F.avg(of("element_count")).alias("avg_elements_per_model"),
            F.avg(of("metadata_completeness_pct")).alias("avg_metadata_completeness"),
            F.sum(of("runtime_seconds")).alias("total_runtime_seconds"),
            F.avg(of("runtime_seconds")).alias("avg_runtime_seconds"),
            rank("runtime_seconds", 0.95).alias("p95_runtime_seconds"),
        )
        .filter(F.col("total_models") > 0)
    )


def best_worst_model(results: DataFrame) -> DataFrame:
    """Names of the models with the highest and the lowest score; equal scores by name."""
    best_key = F.struct((-F.col("quality_score")).alias("s"), F.col("model_name"))
    worst_key = F.struct(F.col("quality_score").alias("s"), F.col("model_name"))
    return successes(results).agg(
        F.min(best_key)["model_name"].alias("best_model"), F.min(worst_key)["model_name"].alias("worst_model")
    )


def portfolio_anomaly_kpis(results: DataFrame) -> DataFrame:
    """Outlier totals and rates over models that were searched; no row when none was."""
    searched = successes(_written(results)).filter(F.col("anomaly_rate").isNotNull())
    ranks = overall_quantiles(searched, ["anomaly_rate"], [0.5, 0.95])
    return (
        searched.agg(
            F.count(F.lit(1)).alias("models_with_ml"),
            F.sum("anomaly_count").alias("total_anomalies"),
            F.avg("anomaly_rate").alias("avg_anomaly_rate"),
            F.first(ranks[quantile_name("anomaly_rate", 0.5)]).alias("median_anomaly_rate"),
            F.first(ranks[quantile_name("anomaly_rate", 0.95)]).alias("p95_anomaly_rate"),
            F.max("anomaly_rate").alias("max_anomaly_rate"),
        )
        .filter(F.col("models_with_ml") > 0)
    )


TOP_MODELS = 5


def top_models(results: DataFrame, column: str, n: int = TOP_MODELS) -> DataFrame:
    """The ``n`` models with the highest ``column``, ties by name; empty below ``n`` successes."""
    good = successes(results)
    enough = good.agg(F.count(F.lit(1)) >= n).scalar()
    return good.select("model_name", column).orderBy(F.desc(column), "model_name").limit(n).filter(enough)


def below_threshold(results: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Successful models with a score under the threshold, and their share in percent."""
    below = F.count_if(F.col("quality_score") < threshold)
    total = F.count(F.lit(1))
    return successes(results).agg(
        F.lit(float(threshold)).alias("quality_threshold"),
        below.alias("models_below_threshold"),
        (below / F.greatest(total, F.lit(1)) * 100.0).alias("pct_below_threshold"),
    )


def portfolio_metrics(results: DataFrame, threshold: float = 80.0) -> DataFrame:
    """The portfolio document: KPIs, best and worst model, outlier roll-up and top lists in one row."""
    results = _written(results)

    def top_list(column: str, name: str) -> DataFrame:
        ranked = top_models(results, column).select(
            F.struct((-F.col(column)).alias("_order"), F.col("model_name"), F.col(column))
            .alias("_entry")
        )
        entries = F.array_sort(F.collect_list("_entry"))
        return ranked.agg(
            F.transform(entries, lambda e: F.struct(e["model_name"], e[column])).alias(name)
        )

    def fields(part: DataFrame) -> dict[str, Column]:
        """The columns of a one-row part, each taken from one subquery."""
        row = part.select(F.struct("*").alias("_row")).scalar()
        return {c: row[c] for c in part.columns}

    return portfolio_kpis(results).withColumns(
        {
            **fields(best_worst_model(results)),
            **fields(portfolio_anomaly_kpis(results).drop("models_with_ml")),
            **fields(below_threshold(results, threshold)),
            **fields(top_list("critical_issues", "top_models_by_critical")),
            **fields(top_list("total_issues", "top_models_by_issues")),
        }
    )
