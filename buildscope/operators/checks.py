"""Rule checks: elements with features in, one row per violation out.

The local rules look at one element at a time, so all of them run in a single scan
without a shuffle. Only duplicate ids compare elements with each other; their count
moves nothing but the two key columns, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildscope.functions.columns import blank, distance, fixed_point
from buildscope.plans.tables import materialize
from buildscope.schemas import ISSUES

CRITICAL, MAJOR, MINOR = "critical", "major", "minor"

# The issue types and their severities.
SEVERITY_OF = {
    "missing_name": MAJOR,
    "missing_object_type": MINOR,
    "duplicate_global_id": CRITICAL,
    "degenerate_geometry": MAJOR,
    "extreme_dimension": CRITICAL,
    "coordinate_anomaly": MINOR,
    "extreme_aspect_ratio": MINOR,
}
METADATA_RULES = ("missing_name", "missing_object_type")
GEOMETRY_RULES = ("degenerate_geometry", "extreme_dimension", "coordinate_anomaly", "extreme_aspect_ratio")
LOCAL_RULES = METADATA_RULES + GEOMETRY_RULES

DIMENSIONS = ("dim_x", "dim_y", "dim_z")
CENTROID = ("centroid_x", "centroid_y", "centroid_z")
RATIOS = ("aspect_ratio_xy", "aspect_ratio_yz", "aspect_ratio_xz")

DUPLICATE_KEY = ["model_id", "global_id"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the geometry rules, in metres."""

    min_dimension: float = 0.001
    max_dimension: float = 10000.0
    max_distance: float = 100000.0
    max_aspect_ratio: float = 100.0


@dataclass(frozen=True)
class Violation:
    """One way an element can break a rule: when it does, and the measured value to report."""

    issue_type: str
    broken: Column
    value: Column
    before: str
    digits: int | None
    after: str

    def message(self, value: Column) -> Column:
        if self.digits is None:
            return F.lit(self.before)
        return F.concat(F.lit(self.before), fixed_point(value, self.digits), F.lit(self.after))


def local_violations(columns: Iterable[str], rules: Iterable[str], limits: Limits) -> Iterator[Violation]:
    """The violations the given columns allow to test. A geometry rule without its column is skipped."""
    columns, rules = set(columns), set(rules)
    nothing = F.lit(None).cast("double")
    if "missing_name" in rules:
        yield Violation("missing_name", blank(F.col("name")), nothing, "Element has no name assigned", None, "")
    if "missing_object_type" in rules:
        yield Violation(
            "missing_object_type", blank(F.col("object_type")), nothing, "Element has no ObjectType assigned", None, ""
        )
    if "has_geometry" not in columns:
        return
    solid = F.col("has_geometry")
    for name in [d for d in DIMENSIONS if d in columns]:
        size = F.col(name)
        if "degenerate_geometry" in rules:
            yield Violation(
                "degenerate_geometry", solid & (size < limits.min_dimension), size,
                f"Dimension {name} = ", 6, f" (< {limits.min_dimension}m)",
            )
        if "extreme_dimension" in rules:
            yield Violation(
                "extreme_dimension", solid & (size > limits.max_dimension), size,
                f"Dimension {name} = ", 2, f"m (> {limits.max_dimension}m, possible scale issue)",
            )
    if "coordinate_anomaly" in rules and columns.issuperset(CENTROID):
        far = distance(*[F.col(c) for c in CENTROID])
        yield Violation(
            "coordinate_anomaly", solid & (far > limits.max_distance), far,
            "Element ", 2, f"m from origin (> {limits.max_distance}m)",
        )
    if "extreme_aspect_ratio" in rules:
        for name in [r for r in RATIOS if r in columns]:
            ratio = F.col(name)
            extreme = (ratio > limits.max_aspect_ratio) | (ratio < 1 / limits.max_aspect_ratio)
            yield Violation(
                "extreme_aspect_ratio", solid & extreme, ratio,
                f"{name} = ", 2, " (extreme, possibly incorrect)",
            )


def _element_name(df: DataFrame) -> Column:
    return F.col("name") if "name" in df.columns else F.lit(None).cast("string")


def local_issues(df: DataFrame, rules: Iterable[str] = LOCAL_RULES, limits: Limits = Limits()) -> DataFrame:
    """Violations of the element-local rules, in one scan.

    Rows that break no rule are dropped first; the others are expanded to their broken
    rules. Text is made last, so a consumer that counts issues never formats a message.
    """
    violations = list(local_violations(df.columns, rules, limits))
    if not violations:
        return empty_issues(df)
    found = F.array(
        *[
            F.when(v.broken, F.struct(F.lit(i).alias("which"), v.value.alias("value")))
            for i, v in enumerate(violations)
        ]
    )
    any_broken = reduce(lambda a, b: a | b, [v.broken for v in violations])
    hits = df.filter(any_broken).select(
        "model_id", "global_id", "ifc_type", _element_name(df).alias("_name"),
        F.explode(F.filter(found, lambda hit: hit.isNotNull())).alias("_hit"),
    )
    which, value = F.col("_hit.which"), F.col("_hit.value")

    def lookup(texts: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), which + 1)

    message = F.lit(None).cast("string")
    for i, v in enumerate(violations):
        message = F.when(which == i, v.message(value)).otherwise(message)
    issue_type = lookup([v.issue_type for v in violations])
    return hits.select(
        "model_id", "global_id", "ifc_type",
        issue_type.alias("issue_type"),
        lookup([SEVERITY_OF[v.issue_type] for v in violations]).alias("severity"),
        message.alias("message"),
        F.when(issue_type != "missing_name", F.col("_name")).alias("element_name"),
    )


def check_missing_name(df: DataFrame) -> DataFrame:
    return local_issues(df, ["missing_name"])


def check_missing_object_type(df: DataFrame) -> DataFrame:
    return local_issues(df, ["missing_object_type"])


def check_degenerate_geometry(df: DataFrame, min_dimension: float = 0.001) -> DataFrame:
    return local_issues(df, ["degenerate_geometry"], Limits(min_dimension=min_dimension))


def check_extreme_dimensions(df: DataFrame, max_dimension: float = 10000.0) -> DataFrame:
    return local_issues(df, ["extreme_dimension"], Limits(max_dimension=max_dimension))


def check_coordinate_anomalies(df: DataFrame, max_distance: float = 100000.0) -> DataFrame:
    return local_issues(df, ["coordinate_anomaly"], Limits(max_distance=max_distance))


def check_extreme_aspect_ratios(df: DataFrame, max_ratio: float = 100.0) -> DataFrame:
    return local_issues(df, ["extreme_aspect_ratio"], Limits(max_aspect_ratio=max_ratio))


def duplicated_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once in their model, with the number of occurrences.

    Null ids are left out: they are missing, not equal.
    """
    return (
        df.filter(F.col("global_id").isNotNull())
        .groupBy(*DUPLICATE_KEY)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def check_duplicate_global_ids(df: DataFrame) -> DataFrame:
    """One critical issue per occurrence of an id that is not unique in its model.

    The repeated ids, counted before the shuffle, are written, so that the join back knows
    their size; adaptive execution splits an id with very many elements.
    """
    repeated = materialize(duplicated_ids(df), "duplicate-ids")
    elements = df.select(*DUPLICATE_KEY, "ifc_type", _element_name(df).alias("element_name"))
    return elements.join(repeated, DUPLICATE_KEY).select(
        "model_id", "global_id", "ifc_type",
        F.lit("duplicate_global_id").alias("issue_type"),
        F.lit(CRITICAL).alias("severity"),
        F.concat(
            F.lit("GlobalId appears "), F.col("occurrences").cast("string"), F.lit(" times (must be unique)")
        ).alias("message"),
        "element_name",
    )


def run_all_checks(
    df: DataFrame,
    min_dimension: float = 0.001,
    max_dimension: float = 10000.0,
    max_distance: float = 100000.0,
    max_aspect_ratio: float = 100.0,
) -> DataFrame:
    """All seven checks. Without a ``has_geometry`` column only the metadata checks apply."""
    limits = Limits(min_dimension, max_dimension, max_distance, max_aspect_ratio)
    return local_issues(df, LOCAL_RULES, limits).unionByName(check_duplicate_global_ids(df))


def empty_issues(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUES)


def count_issues_by_model(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per model: element count and one count per issue type, without making the issues.

    Two aggregations: the local rules are summed in the scan, and the ids are counted
    over the key columns alone.
    """
    sums: dict[str, Column] = {name: F.lit(0) for name in LOCAL_RULES}
    for v in local_violations(df.columns, LOCAL_RULES, limits):
        sums[v.issue_type] = sums[v.issue_type] + F.when(v.broken, 1).otherwise(0)
    local = df.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("element_count"),
        *[F.sum(total).cast("long").alias(name) for name, total in sums.items()],
    )
    repeated = duplicated_ids(df).groupBy("model_id").agg(F.sum("occurrences").alias("duplicate_global_id"))
    return local.join(repeated, "model_id", "left").withColumn(
        "duplicate_global_id", F.coalesce("duplicate_global_id", F.lit(0))
    )


def severity_counts(severity: str) -> Column:
    """Sum of the issue-type counts of one severity, over ``count_issues_by_model``."""
    names = [name for name, level in SEVERITY_OF.items() if level == severity]
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def issues_summary(issues: DataFrame) -> DataFrame:
    """Per model: total, counts by severity and by type, and the three severity totals."""
    # A few rows per model, read three times.
    cube = materialize(
        issues.groupBy("model_id", "severity", "issue_type").agg(F.count(F.lit(1)).alias("_n")), "issue-counts"
    )

    def counts(column: str) -> DataFrame:
        per = cube.groupBy("model_id", column).agg(F.sum("_n").alias("_n"))
        # At most one entry per severity or issue type.
        entries = F.sort_array(F.collect_list(F.struct(F.col(column), F.col("_n"))))
        return per.groupBy("model_id").agg(F.map_from_entries(entries).alias(f"by_{column}"))

    totals = cube.groupBy("model_id").agg(
        F.sum("_n").alias("total_issues"),
        *[
            F.sum(F.when(F.col("severity") == s, F.col("_n")).otherwise(0)).alias(f"{s}_count")
            for s in (CRITICAL, MAJOR, MINOR)
        ],
    )
    return (
        totals.join(counts("severity"), "model_id")
        .join(counts("issue_type"), "model_id")
        .withColumnRenamed("by_issue_type", "by_type")
    )


def with_clean_models(summary: DataFrame, models: DataFrame) -> DataFrame:
    """Add the models without any issue to an issues summary: zeros and empty maps."""
    nothing = F.from_json(F.lit("{}"), "map<string,bigint>")
    filled = models.select("model_id").distinct().join(summary, "model_id", "left")
    return filled.select(
        "model_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_issues", "critical_count", "major_count", "minor_count")],
        *[F.coalesce(c, nothing).alias(c) for c in ("by_severity", "by_type")],
    )


def severity_samples(issues: DataFrame, severities: Iterable[str] = (CRITICAL, MAJOR), n: int = 5) -> DataFrame:
    """The first ``n`` issues of each severity per model, in key order."""
    order = Window.partitionBy("model_id", "severity").orderBy("global_id", "issue_type", "message", "ifc_type", "element_name")
    return (
        issues.filter(F.col("severity").isin(list(severities)))
        .withColumn("sample_rank", F.row_number().over(order))
        .filter(F.col("sample_rank") <= n)
    )


def model_health(elements: DataFrame, issues: DataFrame) -> DataFrame:
    """Per model: elements, distinct ids with issues, and the rest as clean, with percentages.

    Clean is total rows less distinct ids, so repeated ids count as clean rows.
    """
    totals = elements.groupBy("model_id").agg(F.count(F.lit(1)).alias("total_elements"))
    # A null id is one distinct value here, as it is among the issue rows.
    troubled = (
        issues.select(*DUPLICATE_KEY).distinct().groupBy("model_id").agg(F.count(F.lit(1)).alias("elements_with_issues"))
    )
    total, bad = F.col("total_elements"), F.col("elements_with_issues")
    return (
        totals.join(troubled, "model_id", "left")
        .withColumn("elements_with_issues", F.coalesce(bad, F.lit(0)))
        .withColumn("clean_elements", total - bad)
        .withColumn("issue_pct", bad / total * 100.0)
        .withColumn("clean_pct", F.col("clean_elements") / total * 100.0)
    )


# Lower bounds of the score tiers, best first.
SCORE_TIERS = ((90.0, "excellent"), (70.0, "good"), (50.0, "moderate"))
LOWEST_TIER = "poor"


def score_tier(score: Column, tiers: Iterable[tuple[float, str]] = SCORE_TIERS, lowest: str = LOWEST_TIER) -> Column:
    tier = F.lit(lowest)
    for bound, label in sorted(tiers):
        tier = F.when(score >= bound, F.lit(label)).otherwise(tier)
    return tier
