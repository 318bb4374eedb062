"""The registered queries: one per operator, each over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildscope.operators import (
    anomaly,
    checks,
    forest,
    geometry,
    metrics,
    portfolio,
    preprocess,
    profile,
    views,
)
from buildscope.plans.pipeline import analyse_directory
from buildscope.plans.tables import materialize, scratch_path
from buildscope.schemas import FEATURES, GEOMETRY_COLUMNS, ISSUES
from buildscope.sources import step, step_files, step_shapes, tables
from buildscope.workload import inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CUSTOM_WEIGHTS = {"critical": 10.0, "major": 1.0}
DRILLDOWN_MODEL = "model_3"
SIZES = ["dim_x", "dim_y", "dim_z"]
ML = list(preprocess.ML_FEATURES)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums and averages, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.features(spark, sf)


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return checks.run_all_checks(_features(spark, sf))


def _summary(spark: SparkSession, sf: str, weights: dict | None = None) -> DataFrame:
    return metrics.model_summary(_features(spark, sf), _issues(spark, sf), weights)


# --- sources and sinks -------------------------------------------------------------


@query
def step_scan(spark, sf):
    return step.parse_entities(inputs.step_records(spark, sf))


@query
def step_elements(spark, sf):
    return step.extract_elements(step.parse_entities(inputs.step_records(spark, sf)))


@query
def step_elements_first_100(spark, sf):
    return step.extract_elements(step.parse_entities(inputs.step_records(spark, sf)), max_elements=100, keep_entity_id=True)


@query
def model_metadata(spark, sf):
    return step.header_metadata(inputs.header_records(spark, sf))


@query
def validate_models(spark, sf):
    records = inputs.header_records(spark, sf).unionByName(inputs.step_records(spark, sf))
    return step.validate_models(inputs.model_listing(spark, sf), records.select("path", "record"))


@query
def features_roundtrip(spark, sf):
    path = scratch_path(spark, "features")
    tables.save_features(_features(spark, sf).select(*FEATURES.fieldNames()), path)
    return tables.load_features(spark, path)


@query
def model_listing(spark, sf):
    """The model files found in folders of several depths, archives included."""
    folder = scratch_path(spark, "listed-files")
    step_files.write_models(inputs.step_file_text(spark, sf), folder)
    return step.discover_models(spark, folder, recursive=True, pattern="*.{ifc,ifczip}").select("model_id", (F.col("length") > 0).alias("filled"))


@query
def elements_csv(spark, sf):
    """The element table from its CSV files, in which an empty text is no value."""
    path = scratch_path(spark, "elements-csv")
    rows = inputs.elements(spark, sf)
    tables.save_elements_to_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query
def summary_report(spark, sf):
    report = step.summary_report(step.header_metadata(inputs.header_records(spark, sf)), inputs.elements(spark, sf))
    return report.select(
        "model_id",
        F.col("metadata.schema").alias("schema"),
        F.col("metadata.originating_system").alias("originating_system"),
        "statistics.total_elements",
        "statistics.unique_types",
        F.explode("statistics.elements_by_type").alias("ifc_type", "type_count"),
    )


# --- geometry ----------------------------------------------------------------------


@query
def mesh_bbox(spark, sf):
    return geometry.with_bounding_box(inputs.meshes(spark, sf)).select("model_id", "global_id", *geometry.BOX)


@query
def mesh_bbox_ragged(spark, sf):
    return geometry.mesh_features(inputs.meshes(spark, sf, ragged=True)).select(
        "model_id", "global_id", "has_geometry", *geometry.BOX
    )


@query
def mesh_bbox_long(spark, sf):
    return geometry.bounding_box_of_vertices(inputs.vertices(spark, sf))


@query
def mesh_features(spark, sf):
    return geometry.mesh_features(inputs.meshes(spark, sf)).select(
        "model_id", "global_id", "has_geometry", *GEOMETRY_COLUMNS
    )


@query
def geometry_summary(spark, sf):
    found = geometry.geometry_summary(inputs.shared_id_meshes(spark, sf))
    triples = ("centroid", "bbox_min", "bbox_max", "dimensions", "aspect_ratios")
    return found.select(
        "model_id",
        "global_id",
        "entity_id",
        "has_geometry",
        "bbox_volume",
        *[F.get(t, F.lit(i)).alias(f"{t}_{i}") for t in triples for i in range(3)],
    )


@query
def geometry_features(spark, sf):
    return geometry.compute_geometry_features(inputs.mesh_elements(spark, sf), inputs.shared_id_meshes(spark, sf))


# --- profiles ----------------------------------------------------------------------


@query
def element_summary(spark, sf):
    return profile.element_summary(_features(spark, sf))


@query
def element_summary_top10(spark, sf):
    return profile.element_summary(_features(spark, sf), top_n=10)


@query
def element_summary_top3(spark, sf):
    return profile.element_summary(_features(spark, sf), top_n=3)


@query
def attribute_presence(spark, sf):
    return rounded(profile.attribute_presence(_features(spark, sf)), "name_pct", "object_type_pct")


@query
def geometry_coverage(spark, sf):
    return rounded(profile.geometry_coverage(_features(spark, sf)), "coverage_percentage", "complete_percentage")


@query
def ml_ready_features(spark, sf):
    return profile.ml_ready_features(_features(spark, sf))


@query
def feature_stats(spark, sf):
    return rounded(profile.feature_statistics(_features(spark, sf)), "mean", "std", "p25", "p50", "p75")


@query
def volume_extremes(spark, sf):
    return profile.volume_extremes(_features(spark, sf))


@query
def unusual_ratios(spark, sf):
    return profile.unusual_ratios(_features(spark, sf))


@query
def geometry_sample(spark, sf):
    return profile.geometry_sample(_features(spark, sf)).select(
        "model_id", "sample_rank", "global_id", "ifc_type", "name", *SIZES, "bbox_volume"
    )


# --- checks ------------------------------------------------------------------------


@query
def check_missing_name(spark, sf):
    return checks.check_missing_name(_features(spark, sf))


@query
def check_missing_object_type(spark, sf):
    return checks.check_missing_object_type(_features(spark, sf))


@query
def check_duplicate_global_ids(spark, sf):
    return checks.check_duplicate_global_ids(_features(spark, sf))


@query
def check_degenerate_geometry(spark, sf):
    return checks.check_degenerate_geometry(_features(spark, sf))


@query
def check_extreme_dimensions(spark, sf):
    return checks.check_extreme_dimensions(_features(spark, sf))


@query
def check_coordinate_anomalies(spark, sf):
    return checks.check_coordinate_anomalies(_features(spark, sf))


@query
def check_extreme_aspect_ratios(spark, sf):
    return checks.check_extreme_aspect_ratios(_features(spark, sf))


@query
def run_all_checks(spark, sf):
    return _issues(spark, sf)


@query
def run_all_checks_custom_limits(spark, sf):
    return checks.run_all_checks(_features(spark, sf), 1.0, 45.0, 90000.0, 50.0)


@query
def issues_summary(spark, sf):
    summary = checks.with_clean_models(checks.issues_summary(_issues(spark, sf)), inputs.elements(spark, sf))

    def text(column):
        pairs = F.sort_array(F.map_entries(column))
        return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")

    return summary.withColumns({"by_severity": text("by_severity"), "by_type": text("by_type")})


@query
def severity_samples(spark, sf):
    return checks.severity_samples(_issues(spark, sf)).select(
        "model_id", "severity", "sample_rank", "global_id", "issue_type", "message", "ifc_type", "element_name"
    )


@query
def model_health(spark, sf):
    return rounded(checks.model_health(_features(spark, sf), _issues(spark, sf)), "issue_pct", "clean_pct")


@query
def score_tiers(spark, sf):
    scores = metrics.quality_scores(_features(spark, sf), _issues(spark, sf))
    published = ((90.0, "excellent"), (80.0, "good"), (70.0, "moderate"))
    return rounded(
        scores.select(
            "model_id",
            "quality_score",
            checks.score_tier(F.col("quality_score")).alias("tier"),
            checks.score_tier(F.col("quality_score"), published).alias("published_tier"),
        ),
        "quality_score",
    )


# --- metrics -----------------------------------------------------------------------


@query
def severity_breakdown(spark, sf):
    return metrics.severity_breakdown(_features(spark, sf), _issues(spark, sf))


@query
def issue_rate(spark, sf):
    return rounded(
        _summary(spark, sf).select("model_id", "total_elements", "total_issues", "issue_rate_per_1000"),
        "issue_rate_per_1000",
    )


@query
def metadata_completeness(spark, sf):
    return rounded(metrics.metadata_completeness(_features(spark, sf)), "name_pct", "object_type_pct", "geometry_pct")


@query
def top_offenders_ifc_type(spark, sf):
    return metrics.top_offenders(_issues(spark, sf), "ifc_type", 3)


@query
def top_offenders_issue_type(spark, sf):
    return metrics.top_offenders(_issues(spark, sf), "issue_type", 3)


@query
def quality_score(spark, sf):
    return rounded(portfolio.model_scores(_features(spark, sf)), "quality_score")


@query
def quality_score_custom_weights(spark, sf):
    return rounded(portfolio.model_scores(_features(spark, sf), CUSTOM_WEIGHTS), "quality_score")


@query
def kpi_long(spark, sf):
    return rounded(metrics.kpi_long(_summary(spark, sf)), "value")


@query
def severity_frame(spark, sf):
    return metrics.severity_frame(_summary(spark, sf))


@query
def issues_by_ifc_type(spark, sf):
    return metrics.issues_by(metrics.issue_counts(_issues(spark, sf)), "ifc_type")


@query
def issues_by_type(spark, sf):
    return metrics.issues_by(metrics.issue_counts(_issues(spark, sf)), "issue_type")


@query
def pareto(spark, sf):
    return metrics.pareto_issue_types(_issues(spark, sf))


@query
def pareto_top_n(spark, sf):
    return metrics.pareto_issue_types(_issues(spark, sf), top_n=3)


def _document_columns(document: DataFrame) -> DataFrame:
    def text(column):
        return F.array_join(
            F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","
        )

    head = F.array_join(
        F.transform("pareto_issue_types", lambda e: F.format_string("%s:%d:%.12f:%.12f", e["issue_type"], e["count"], e["pct"], e["cum_pct"])), ","
    )
    return rounded(
        document.select(
            "model_id", "total_elements", "quality_score", "total_issues", "issue_rate_per_1000",
            "severity_breakdown.*", "metadata_completeness.*",
            text("top_offenders.ifc_type").alias("top_ifc_types"),
            text("top_offenders.issue_type").alias("top_issue_types"),
            head.alias("pareto"),
        ),
        "quality_score", "issue_rate_per_1000", "name_pct", "object_type_pct", "geometry_pct",
    )


@query
def metrics_document(spark, sf):
    return _document_columns(metrics.build_metrics(_features(spark, sf), _issues(spark, sf), top_n=5)[0])


@query
def metrics_json(spark, sf):
    """The document as it comes back from its JSON files."""
    path = scratch_path(spark, "metrics-json")
    document, _ = metrics.build_metrics(_features(spark, sf), _issues(spark, sf), top_n=5)
    tables.save_metrics(document, path)
    return _document_columns(spark.read.schema(document.schema).json(path))


# --- portfolio ---------------------------------------------------------------------

RESULT_FLOATS = ("quality_score", "issue_rate_per_1k", "metadata_completeness_pct", "anomaly_rate", "runtime_seconds")


@query
def model_results(spark, sf):
    return rounded(inputs.results(spark, sf).drop("processed_at"), *RESULT_FLOATS)


@query
def anomaly_rate_known(spark, sf):
    """Which models have an anomaly rate, where the numbers of one model cannot be learned from."""
    damaged = (F.col("model_id") == DRILLDOWN_MODEL) & (F.col("entity_id") % 20 == 3)
    features = _features(spark, sf).withColumn("dim_z", F.when(damaged, 1.7e308).otherwise(F.col("dim_z")))
    found, _ = forest.detect_anomalies(features, portfolio.contamination, n_estimators=20)
    return portfolio.model_results(features, found).select(F.col("model_name").alias("model_id"), F.col("anomaly_rate").isNotNull().alias("known"))


@query
def portfolio_from_step(spark, sf):
    """The elements written as model files, read back, checked, scored and rolled up by the workflow; its table of results."""
    folder, output = scratch_path(spark, "step-files"), scratch_path(spark, "step-portfolio")
    step_files.write_models(inputs.step_file_text(spark, sf), folder)
    analyse_directory(spark, folder, output, recursive=True, archives=True)
    results, _ = tables.load_portfolio_data(spark, output)
    shown = F.regexp_replace("model_path", "^.*/step-files-[0-9a-f]+/(.*)[.]ifc(zip)?$", "$1").alias("model_path")
    return rounded(results.select("model_name", shown, *[c for c in results.columns if c not in ("model_name", "model_path", "processed_at", "runtime_seconds")]), *RESULT_FLOATS[:-1])


@query
def boxes_from_step(spark, sf):
    """Bodies of six kinds under three nested placements, written as model files, read back and boxed in metres."""
    folder = scratch_path(spark, "body-files")
    step_files.write_models(inputs.body_file_text(spark, sf), folder)
    boxes, _ = step_shapes.read_shapes(step.parse_entities(step_files.read_models(spark, folder)))
    numbers = [*geometry.BOX, *[f"{part}_{axis}" for part in ("centroid", "dim") for axis in geometry.AXES]]
    return rounded(boxes.select("model_id", "entity_id", "global_id", "has_geometry", *numbers), *numbers, digits=8)


@query
def model_results_with_failures(spark, sf):
    return rounded(inputs.all_results(spark, sf).drop("processed_at"), *RESULT_FLOATS)


@query
def adaptive_contamination(spark, sf):
    return portfolio.adaptive_contamination(inputs.elements(spark, sf))


@query
def portfolio_kpis(spark, sf):
    kpis = portfolio.portfolio_kpis(inputs.all_results(spark, sf))
    return rounded(kpis, *[f.name for f in kpis.schema.fields if f.dataType.typeName() == "double"])


@query
def best_worst_model(spark, sf):
    return portfolio.best_worst_model(inputs.all_results(spark, sf))


@query
def portfolio_anomaly_kpis(spark, sf):
    kpis = portfolio.portfolio_anomaly_kpis(inputs.all_results(spark, sf, _flagged(spark, sf)))
    return rounded(kpis, "avg_anomaly_rate", "median_anomaly_rate", "p95_anomaly_rate", "max_anomaly_rate")


@query
def top_models_critical(spark, sf):
    return portfolio.top_models(inputs.all_results(spark, sf), "critical_issues")


@query
def top_models_issues(spark, sf):
    return portfolio.top_models(inputs.all_results(spark, sf), "total_issues")


@query
def below_threshold(spark, sf):
    return rounded(portfolio.below_threshold(inputs.all_results(spark, sf)), "pct_below_threshold")


@query
def portfolio_metrics(spark, sf):
    found = portfolio.portfolio_metrics(inputs.all_results(spark, sf, _flagged(spark, sf)))

    def text(column, value):
        return F.array_join(
            F.transform(column, lambda e: F.concat(e["model_name"], F.lit(":"), e[value].cast("string"))), ","
        )

    whole = found.withColumns(
        {name: text(name, value) for name, value in (("top_models_by_critical", "critical_issues"), ("top_models_by_issues", "total_issues"))}
    )
    return rounded(whole, *[f.name for f in whole.schema.fields if f.dataType.typeName() == "double"])


# --- dashboard tables --------------------------------------------------------------


@query
def quality_ranking(spark, sf):
    return rounded(views.quality_ranking(inputs.all_results(spark, sf)), "quality_score")


@query
def critical_or_total_top(spark, sf):
    return views.critical_or_total_top(inputs.all_results(spark, sf))


@query
def total_top_without_critical(spark, sf):
    """No id and no size limit, hence no critical issue."""
    nameless = _features(spark, sf).withColumn("global_id", F.lit(None).cast("string"))
    return views.critical_or_total_top(portfolio.model_results(nameless, limits=checks.Limits(max_dimension=1e9)))


@query
def issue_rate_histogram(spark, sf):
    return rounded(views.issue_rate_histogram(inputs.all_results(spark, sf)), "bin_start", "bin_end")


@query
def issue_rate_percentiles(spark, sf):
    return rounded(views.issue_rate_percentiles(inputs.all_results(spark, sf)), "p50", "p95")


@query
def anomaly_rate_top(spark, sf):
    found = views.anomaly_rate_top(inputs.all_results(spark, sf, _flagged(spark, sf)))
    return rounded(found, "anomaly_rate", "anomaly_pct")


@query
def portfolio_pareto(spark, sf):
    return views.portfolio_pareto(_issues(spark, sf))


@query
def issues_sink_pareto(spark, sf):
    """The portfolio Pareto from the written issue tables of all models."""
    path = scratch_path(spark, "issues")
    tables.save_issues(_issues(spark, sf).select(*ISSUES.fieldNames()), path)
    return views.portfolio_pareto(tables.scan_issues(spark, path))


@query
def top_offender_models(spark, sf):
    return rounded(views.top_offender_models(inputs.all_results(spark, sf)), "quality_score", "issue_rate_per_1k")


@query
def failed_models(spark, sf):
    return views.failed_models(inputs.all_results(spark, sf))


@query
def model_drilldown(spark, sf):
    this = views.one_model(_features(spark, sf), DRILLDOWN_MODEL)
    found = views.model_drilldown(this, checks.run_all_checks(this), DRILLDOWN_MODEL, _flagged_of(this))
    return rounded(
        found, "quality_score", "issue_rate_per_1000", "name_pct", "object_type_pct", "geometry_pct", "anomaly_rate_pct"
    )


@query
def stored_drilldown(spark, sf):
    """The same model from tables written for all models, without a search for outliers."""
    path, rows = scratch_path(spark, "stored"), _features(spark, sf).select(*FEATURES.fieldNames())
    tables.save_features(rows, f"{path}/features")
    tables.save_issues(checks.run_all_checks(rows).select(*ISSUES.fieldNames()), f"{path}/issues")
    features, issues, _ = tables.load_model_data(spark, path, DRILLDOWN_MODEL)
    return rounded(
        views.model_drilldown(features, issues, DRILLDOWN_MODEL), "quality_score", "issue_rate_per_1000", "name_pct", "object_type_pct", "geometry_pct"
    )


@query
def top_issues(spark, sf):
    return views.top_issues(_issues(spark, sf))


@query
def top_anomalies(spark, sf):
    return rounded(views.top_anomalies(_flagged(spark, sf)), "anomaly_score")


@query
def quality_gate(spark, sf):
    scores = metrics.quality_scores(_features(spark, sf), _issues(spark, sf)).select("model_id", "quality_score")
    return rounded(views.quality_gate(scores), "quality_score")


# --- outliers: preparation ---------------------------------------------------------


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.select_ml_features(_features(spark, sf), ["global_id"])


@query
def ml_select(spark, sf):
    wild = _features(spark, sf).withColumn(
        "dim_x", F.when(F.col("dim_x") > 10000.0, F.lit(float("inf"))).otherwise(F.col("dim_x"))
    )
    return preprocess.select_ml_features(wild, ["global_id"])


@query
def impute_median(spark, sf):
    return rounded(preprocess.handle_missing_values(_selected(spark, sf)), *ML)


@query
def impute_mean(spark, sf):
    return rounded(preprocess.handle_missing_values(_selected(spark, sf), "mean"), *ML)


@query
def impute_constant(spark, sf):
    return preprocess.handle_missing_values(_selected(spark, sf), "constant", 999.0)


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.handle_missing_values(_selected(spark, sf), "constant", 0.0)


@query
def scale_robust(spark, sf):
    return rounded(preprocess.scale_features(_filled(spark, sf), "robust")[0], *ML)


@query
def scale_standard(spark, sf):
    return rounded(preprocess.scale_features(_filled(spark, sf), "standard")[0], *ML)


@query
def scale_pretrained(spark, sf):
    rows = _filled(spark, sf)
    scaler = materialize(preprocess.fit_scaler(rows, "robust"), "scaler")
    doubled = rows.withColumns({c: F.col(c) * 2.0 for c in ML})
    return rounded(preprocess.scale_features(doubled, scaler=scaler)[0], *ML)


@query
def preprocess_features(spark, sf):
    return rounded(preprocess.preprocess_features(_features(spark, sf))[0], *ML)


@query
def derived_features(spark, sf):
    derived = preprocess.add_derived_features(_selected(spark, sf))
    return derived.select("model_id", "global_id", *[c for c in derived.columns if c not in ("model_id", "global_id", *ML)])


# --- outliers: flags on a score SQL can express ------------------------------------


def _scored_of(features: DataFrame) -> DataFrame:
    """Minus the summed distances of the sides from the median of their model, in quartile ranges.

    Rounded, so that equal distances are equal scores however they were added up.
    """
    rows = features.select("model_id", "global_id", "ifc_type", "has_geometry", *SIZES)
    scaled, _ = preprocess.preprocess_features(rows)
    score = F.round(-(F.abs("dim_x") + F.abs("dim_y") + F.abs("dim_z")), 9)
    return materialize(scaled.select("model_id", "global_id", "ifc_type", score.alias("anomaly_score")), "scored")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_of(_features(spark, sf))


def _flagged_of(features: DataFrame) -> DataFrame:
    return anomaly.flag_anomalies(_scored_of(features), sizes=portfolio.adaptive_contamination(features))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    sizes = portfolio.adaptive_contamination(inputs.elements(spark, sf))
    return anomaly.flag_anomalies(_scored(spark, sf), sizes=sizes)


ANOMALY_FLOATS = ("anomaly_score", "anomaly_probability")


@query
def anomaly_flag(spark, sf):
    return rounded(_flagged(spark, sf).drop("anomaly_probability"), "anomaly_score")


@query
def anomaly_probability(spark, sf):
    return rounded(_flagged(spark, sf).drop("is_anomaly"), *ANOMALY_FLOATS)


@query
def anomalies_over_threshold(spark, sf):
    return rounded(anomaly.get_anomalies(anomaly.to_anomalies(_flagged(spark, sf)), 0.5), *ANOMALY_FLOATS)


@query
def anomaly_top10(spark, sf):
    return rounded(anomaly.most_probable(_flagged(spark, sf)), *ANOMALY_FLOATS)


@query
def anomaly_by_type(spark, sf):
    return rounded(anomaly.anomalies_by_type(_flagged(spark, sf), inputs.elements(spark, sf)), "pct_of_type")


@query
def anomaly_confidence(spark, sf):
    return rounded(
        anomaly.anomaly_confidence(_flagged(spark, sf)), "mean_probability", "max_probability", "min_probability"
    )


# --- outliers: the forest ----------------------------------------------------------


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Elements whose key SQL can say as well. A few rows share it; they are drawn alike."""
    return _features(spark, sf).withColumn("element_key", F.col("entity_id"))


def _detector() -> forest.AnomalyDetector:
    return forest.AnomalyDetector(portfolio.contamination)


@query
def forest_nodes(spark, sf):
    fitted = _detector().fit(_keyed(spark, sf)).forest
    return rounded(forest.forest_nodes(fitted.trees), "threshold")


@query
def forest_scores(spark, sf):
    return rounded(_detector().fit_predict(_keyed(spark, sf)).drop("element_key"), *ML, "anomaly_probability")


@query
def detect_anomalies(spark, sf):
    return rounded(forest.detect_anomalies(_keyed(spark, sf))[0], "anomaly_probability")


@query
def forest_roundtrip(spark, sf):
    path = forest.forest_path(spark)
    rows = _keyed(spark, sf)
    _detector().fit(rows).save_model(path)
    return rounded(forest.AnomalyDetector.load_model(spark, path).get_anomalies(rows), "anomaly_probability")
