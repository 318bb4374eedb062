"""The whole portfolio workflow as one series of Spark jobs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildscope.operators import checks, metrics, portfolio
from buildscope.operators.anomaly import to_anomalies
from buildscope.operators.forest import AnomalyDetector
from buildscope.operators.geometry import attach_features, compute_geometry_features
from buildscope.plans.tables import materialize
from buildscope.schemas import FEATURES, GEOMETRY_COLUMNS
from buildscope.sources import step, step_files, step_shapes, tables


def run_portfolio_analysis(
    features: DataFrame,
    output: str,
    *,
    failures: DataFrame | None = None,
    paths: DataFrame | None = None,
    enable_ml: bool = False,
    n_estimators: int = 100,
    quality_threshold: float = 80.0,
    limits: checks.Limits = checks.Limits(),
    started: float | None = None,
) -> DataFrame:
    """Check, score and roll up every model; write all tables under ``output``.

    Writes features, issues, anomalies (with ``enable_ml``), metrics and the portfolio
    results, and returns the portfolio document. Each stage reads what the one before
    it wrote. ``failures`` are models that could not be read, as
    (model_name, model_path, error_message); ``paths`` (model_id, path) are where the others
    came from. A model's runtime is its share, by elements, of the seconds measured from
    ``started`` (``time.monotonic()``, by default the call) to the roll-up: models are worked on
    together, so there is no other time of a single one.
    """
    started = time.monotonic() if started is None else started
    spark = features.sparkSession
    kept = [c for c in (*FEATURES.fieldNames(), "element_key") if c in features.columns]
    tables.save_by_model(features.select(*kept), f"{output}/features")
    rows = spark.read.schema(features.select(*kept).schema).parquet(f"{output}/features")

    found = checks.run_all_checks(
        rows, limits.min_dimension, limits.max_dimension, limits.max_distance, limits.max_aspect_ratio
    )
    tables.save_issues(found, f"{output}/issues")
    issues = tables.load_issues(spark, f"{output}/issues")

    document, _ = metrics.build_metrics(rows, issues)
    tables.save_metrics(document, f"{output}/metrics")

    anomalies = None
    if enable_ml:
        detector = AnomalyDetector(portfolio.contamination, n_estimators)
        tables.save_anomalies(to_anomalies(detector.fit_predict(rows)), f"{output}/anomalies")
        anomalies = tables.load_anomalies(spark, f"{output}/anomalies")

    total = rows.agg(F.count(F.lit(1))).scalar()
    runtime = F.lit(time.monotonic() - started) * F.col("element_count") / total
    results = portfolio.model_results(rows, anomalies, runtime, limits=limits, paths=paths)
    if failures is not None:
        results = portfolio.with_failures(results, failures)
    results = materialize(results, "results")
    overall = materialize(portfolio.portfolio_metrics(results, quality_threshold), "portfolio")
    tables.save_portfolio_results(results, overall, output)
    return overall


def analyse_directory(
    spark: SparkSession,
    directory: str,
    output: str,
    meshes: DataFrame | None = None,
    *,
    recursive: bool = False,
    archives: bool = False,
    types: DataFrame | None = None,
    record_end: str | None = step.DETECT,
    shapes: bool = True,
    **options,
) -> DataFrame:
    """The workflow from a folder of model files.

    Every file, and with ``archives`` every ``.ifczip``, gives one result row: a file that cannot be read, or that holds no
    product, a failure row. Entity types outside the table of product types are counted under
    ``unlisted_types``. ``meshes`` holds the world-coordinate vertices of the elements; without it, boxes come from the
    bodies in the files (``step_shapes.read_shapes``), and items of kinds that are not read are counted under ``unread_items``.
    With ``shapes=False`` and without meshes no element has geometry.
    """
    started = time.monotonic()
    listing = step.discover_models(spark, directory, recursive, "*.{ifc,ifczip}" if archives else "*.ifc")
    if record_end == step.DETECT:
        records = step_files.read_models(spark, directory, recursive, archives=archives)
    else:
        records = step.read_records(spark, directory, recursive, record_end)
    checked = materialize(
        step.validate_models(listing.withColumns({"exists": F.lit(True), "is_file": F.lit(True)}), records).join(
            listing.select("path", "model_id"), "path"
        ),
        "validated",
    )
    failures = checked.filter(~F.col("is_valid")).select(
        F.col("model_id").alias("model_name"),
        F.col("path").alias("model_path"),
        F.concat(F.lit("IFCLoadError: "), F.col("error")).alias("error_message"),
    )
    broken = checked.filter(~F.col("is_valid")).select("model_id")
    # Written, as the files are read and parsed for each of the tables that follow else.
    entities = materialize(step.parse_entities(records), "entities")
    unlisted = step.unlisted_types(entities, types).join(broken, "model_id", "left_anti")
    unlisted.write.mode("overwrite").parquet(f"{output}/unlisted_types")
    elements = step.extract_elements(entities, types, keep_entity_id=True)
    elements = elements.join(broken, "model_id", "left_anti").withColumnRenamed("entity_id", "element_key")
    elements = materialize(elements, "elements")
    empty = checked.filter("is_valid").join(elements.select("model_id"), "model_id", "left_anti")
    failures = failures.unionByName(
        empty.select(
            F.col("model_id").alias("model_name"), F.col("path").alias("model_path"), F.lit("NoElements: no product in the file").alias("error_message")
        )
    )
    if meshes is not None:
        features = compute_geometry_features(elements, meshes)
    elif shapes:
        boxes, unread = step_shapes.read_shapes(entities, types)
        unread.join(broken, "model_id", "left_anti").write.mode("overwrite").parquet(f"{output}/unread_items")
        features = attach_features(elements, boxes)
    else:
        features = elements.withColumns({"has_geometry": F.lit(False), **{c: F.lit(None).cast("double") for c in GEOMETRY_COLUMNS}})
    paths = checked.filter("is_valid").select("model_id", "path")
    return run_portfolio_analysis(features, output, failures=failures, paths=paths, started=started, **options)
