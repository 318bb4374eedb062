"""Reading and writing the engine's tables.

Large tables are Parquet, sorted by model where a reader wants single models. CSV and
JSON are exports of small results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildscope.functions.columns import missing_to_null
from buildscope.schemas import ANOMALIES, FEATURES, ISSUES, MODEL_RESULTS


def save_by_model(df: DataFrame, path: str) -> None:
    """Write a table in which the rows of a model lie together.

    Rebalancing brings a model's rows to one task and splits a large model over many. The
    number of files follows the size of the table, not the number of models: each file is
    sorted by model, so a filter on one model skips row groups by dictionary or Bloom filter,
    and pages by their lowest and highest model.
    """
    (
        df.hint("rebalance", "model_id")
        .sortWithinPartitions("model_id")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#model_id", True)
        .parquet(path)
    )


def save_features(features: DataFrame, path: str) -> None:
    save_by_model(features, path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature table; raises when it is missing. A filter on model_id reads the pages with that model."""
    return missing_to_null(spark.read.schema(FEATURES).parquet(path))


def save_issues(issues: DataFrame, path: str) -> None:
    save_by_model(issues, path)


def save_anomalies(anomalies: DataFrame, path: str) -> None:
    save_by_model(anomalies, path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_elements_to_csv(elements: DataFrame, path: str) -> None:
    export_csv(elements, path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; nulls are kept as in the source documents."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def save_metrics(metrics: DataFrame, path: str) -> None:
    export_json(metrics, path)


def _read_optional(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema) if kind == "parquet" else spark.read
    try:
        return getattr(reader, kind)(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_issues(spark: SparkSession, path: str) -> DataFrame:
    """The issues of all models; empty when there is no table."""
    return _read_optional(spark, path, ISSUES)


def scan_issues(spark: SparkSession, path: str) -> DataFrame:
    """All issues under a folder, passing over files that cannot be read."""
    return spark.read.schema(ISSUES).option("ignoreCorruptFiles", True).parquet(path)


def load_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return _read_optional(spark, path, ANOMALIES)


def save_portfolio_results(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """Write the model table as CSV and JSON, and the portfolio document as JSON."""
    export_csv(results, f"{path}/portfolio_summary.csv")
    export_json(results, f"{path}/portfolio_summary.json")
    export_json(metrics, f"{path}/portfolio_metrics.json")


def load_portfolio_data(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The model table (an error when missing) and the portfolio document (empty when missing)."""
    results = spark.read.schema(MODEL_RESULTS).option("header", True).csv(f"{path}/portfolio_summary.csv")
    metrics = _read_optional(spark, f"{path}/portfolio_metrics.json", "total_models bigint", "json")
    return results, metrics


def load_model_data(spark: SparkSession, path: str, model_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features (an error when missing), issues and metrics of one model."""
    this = F.col("model_id") == model_id
    features = load_features(spark, f"{path}/features").filter(this)
    issues = load_issues(spark, f"{path}/issues").filter(this)
    metrics = _read_optional(spark, f"{path}/metrics", "model_id string", "json").filter(this)
    return features, issues, metrics
