"""Declared schemas of the tables the engine reads and writes.

Every table carries ``model_id`` first: one table holds the rows of all models.
"""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

ELEMENTS = _struct(
    model_id=_S, global_id=_S, ifc_type=_S, name=_S, description=_S, object_type=_S, predefined_type=_S
)

GEOMETRY_COLUMNS = [
    "centroid_x", "centroid_y", "centroid_z",
    "dim_x", "dim_y", "dim_z",
    "bbox_volume",
    "aspect_ratio_xy", "aspect_ratio_yz", "aspect_ratio_xz",
]

FEATURES = T.StructType(
    ELEMENTS.fields
    + [T.StructField("has_geometry", _B, True)]
    + [T.StructField(c, _D, True) for c in GEOMETRY_COLUMNS]
)

MESHES = _struct(model_id=_S, global_id=_S, entity_id=_L, verts=T.ArrayType(_D))

MODEL_METADATA = _struct(
    model_id=_S, schema=_S, description=_S, implementation_level=_S, name=_S, time_stamp=_S, author=_S,
    organization=_S, preprocessor_version=_S, originating_system=_S, authorization=_S,
)

ISSUES = _struct(
    model_id=_S, global_id=_S, ifc_type=_S, issue_type=_S, severity=_S, message=_S, element_name=_S
)

ANOMALIES = _struct(
    model_id=_S, global_id=_S, ifc_type=_S, is_anomaly=_B, anomaly_score=_D, anomaly_probability=_D
)

MODEL_RESULTS = _struct(
    model_name=_S, model_path=_S, status=_S, element_count=_L, total_issues=_L, critical_issues=_L,
    major_issues=_L, minor_issues=_L, quality_score=_D, issue_rate_per_1k=_D, metadata_completeness_pct=_D,
    anomaly_count=_L, anomaly_rate=_D, runtime_seconds=_D, processed_at=_S, error_message=_S,
)

# One row per (model, tree); a node is an index into the arrays.
FOREST_TREES = _struct(
    model_id=_S, tree=T.IntegerType(), sample_size=T.IntegerType(),
    feature=T.ArrayType(T.IntegerType()), threshold=T.ArrayType(_D),
    left=T.ArrayType(T.IntegerType()), right=T.ArrayType(T.IntegerType()),
    size=T.ArrayType(T.IntegerType()), depth=T.ArrayType(T.IntegerType()),
)

ISSUES_SUMMARY_COLUMNS = ["total_issues", "critical_count", "major_count", "minor_count"]
