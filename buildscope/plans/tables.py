"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A session in one process may leave it unset and then has a folder of its own.
    """
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    named = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(app)
    if not named:
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = _own_dirs[app] = tempfile.mkdtemp(prefix="buildscope-")
    return f"{named.rstrip('/')}/buildscope-{app}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Removes the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, makes the content stable under task retries, and gives the
    planner the measured size of the table. The shuffle files of the write are
    removed; the table itself stays until ``release``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
