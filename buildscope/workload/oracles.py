"""SQL that states the expected result of each registered query, for an independent engine."""

from __future__ import annotations

from buildscope.operators import forest
from buildscope.operators.preprocess import ML_FEATURES
from buildscope.schemas import FEATURES, GEOMETRY_COLUMNS
from buildscope.workload.catalog import CUSTOM_WEIGHTS, DRILLDOWN_MODEL
from buildscope.workload.inputs import BASE, BODY, BODY_NUMBER, ELEMENT, GEOMETRY, STEP_FILLER

ML = list(ML_FEATURES)
SIZES = ["dim_x", "dim_y", "dim_z"]

BASE_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in BASE.items()) + " FROM lineitem JOIN part ON l_partkey = p_partkey"
FEATURES_SQL = (
    f"WITH base AS ({BASE_SQL}) SELECT "
    + ", ".join(ELEMENT)
    + ", "
    + ", ".join(f"{sql} AS {name}" for name, sql in GEOMETRY.items())
    + " FROM base"
)


def issues_sql(min_dim=0.001, max_dim=10000.0, max_dist=100000.0, max_ratio=100.0) -> str:
    def rule(issue, severity, message, where, name="name"):
        return (
            f"SELECT model_id, global_id, ifc_type, '{issue}' AS issue_type, '{severity}' AS severity, "
            f"{message} AS message, CAST({name} AS VARCHAR) AS element_name FROM features WHERE {where}"
        )

    parts = [
        rule("missing_name", "major", "'Element has no name assigned'", "name IS NULL OR name = ''", "NULL"),
        rule("missing_object_type", "minor", "'Element has no ObjectType assigned'", "object_type IS NULL OR object_type = ''"),
        "SELECT f.model_id, f.global_id, ifc_type, 'duplicate_global_id', 'critical', "
        "'GlobalId appears ' || CAST(n AS VARCHAR) || ' times (must be unique)', name FROM features f JOIN "
        "(SELECT model_id, global_id, count(*) AS n FROM features GROUP BY model_id, global_id HAVING count(*) > 1) d "
        "ON f.model_id = d.model_id AND f.global_id = d.global_id",
    ]
    for d in SIZES:
        parts.append(rule("degenerate_geometry", "major", f"'Dimension {d} = ' || printf('%.6f', {d}) || ' (< {min_dim}m)'", f"has_geometry AND {d} < {min_dim}"))
        parts.append(rule("extreme_dimension", "critical", f"'Dimension {d} = ' || printf('%.2f', {d}) || 'm (> {max_dim}m, possible scale issue)'", f"has_geometry AND {d} > {max_dim}"))
    far = "sqrt(centroid_x * centroid_x + centroid_y * centroid_y + centroid_z * centroid_z)"
    parts.append(rule("coordinate_anomaly", "minor", f"'Element ' || printf('%.2f', {far}) || 'm from origin (> {max_dist}m)'", f"has_geometry AND {far} > {max_dist}"))
    for r in ("aspect_ratio_xy", "aspect_ratio_yz", "aspect_ratio_xz"):
        parts.append(rule("extreme_aspect_ratio", "minor", f"'{r} = ' || printf('%.2f', {r}) || ' (extreme, possibly incorrect)'", f"has_geometry AND ({r} > {max_ratio} OR {r} < CAST(1 AS DOUBLE) / {max_ratio})"))
    return " UNION ALL ".join(parts)


ISSUES_SQL = issues_sql()
TOTALS_SQL = """SELECT model_id, count(*) AS total_elements,
 avg(CAST(CASE WHEN name IS NULL OR name = '' THEN 0 ELSE 1 END AS DOUBLE)) * 100 AS name_pct,
 avg(CAST(CASE WHEN object_type IS NULL OR object_type = '' THEN 0 ELSE 1 END AS DOUBLE)) * 100 AS object_type_pct,
 avg(CAST(CASE WHEN has_geometry THEN 1 ELSE 0 END AS DOUBLE)) * 100 AS geometry_pct
 FROM features GROUP BY model_id"""


def summary_sql(weights: dict | None = None) -> str:
    weights = weights or {"critical": 3.0, "major": 2.0, "minor": 1.0}
    weight = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items()) + " ELSE 1.0 END"
    return f"""SELECT t.model_id, total_elements,
 CAST(greatest(0, least(100, 100 - coalesce(weighted, 0) / total_elements * 100)) AS DOUBLE) AS quality_score,
 coalesce(n, 0) AS total_issues, CAST(coalesce(n, 0) AS DOUBLE) / total_elements * 1000 AS issue_rate_per_1000,
 name_pct, object_type_pct, geometry_pct,
 coalesce(critical, 0) AS critical, coalesce(major, 0) AS major, coalesce(minor, 0) AS minor
 FROM ({TOTALS_SQL}) t LEFT JOIN (
  SELECT model_id, count(*) AS n, sum(CAST({weight} AS DOUBLE)) AS weighted,
  count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'major') AS major,
  count(*) FILTER (WHERE severity = 'minor') AS minor FROM issues GROUP BY model_id) i ON t.model_id = i.model_id"""


def results_sql(with_anomalies: bool = False, with_failures: bool = True) -> str:
    count = "anomaly_count" if with_anomalies else "CAST(NULL AS BIGINT) AS anomaly_count"
    rate = "CAST(anomaly_count AS DOUBLE) / total_elements" if with_anomalies else "CAST(NULL AS DOUBLE)"
    source = "summary"
    if with_anomalies:
        source = (
            "summary LEFT JOIN (SELECT model_id AS anomaly_model, count(*) FILTER (WHERE is_anomaly) AS anomaly_count "
            "FROM flagged GROUP BY model_id) ON model_id = anomaly_model"
        )
    sql = f"""SELECT model_id AS model_name, model_id || '.ifc' AS model_path, 'success' AS status,
 total_elements AS element_count, total_issues, critical AS critical_issues, major AS major_issues, minor AS minor_issues,
 quality_score, issue_rate_per_1000 AS issue_rate_per_1k,
 (name_pct + object_type_pct + geometry_pct) / 3 AS metadata_completeness_pct, {count}, {rate} AS anomaly_rate,
 total_elements * CAST(0.005 AS DOUBLE) AS runtime_seconds, CAST(NULL AS VARCHAR) AS error_message FROM {source}"""
    if with_failures:
        zero, none = "CAST(0 AS BIGINT)", "CAST(0 AS DOUBLE)"
        sql += f""" UNION ALL SELECT 'broken_' || CAST(s_suppkey AS VARCHAR), 'broken_' || CAST(s_suppkey AS VARCHAR) || '.ifc',
 'failure', {zero}, {zero}, {zero}, {zero}, {zero}, {none}, {none}, {none}, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE),
 {none}, 'IFCLoadError: unreadable' FROM supplier WHERE s_suppkey % 25 = 7"""
    return sql


def selected_sql(columns: list[str], kept: str = "") -> str:
    return f"SELECT model_id, global_id, ifc_type, {kept}{', '.join(columns)} FROM features WHERE has_geometry"


def fills_sql(columns: list[str], value: str = "quantile_cont({c}, 0.5)") -> str:
    return "SELECT model_id, " + ", ".join(f"coalesce({value.format(c=c)}, 0) AS f_{c}" for c in columns) + " FROM selected GROUP BY model_id"


def filled_sql(columns: list[str], kept: str = "") -> str:
    return f"SELECT s.model_id, global_id, ifc_type, {kept}" + ", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in columns) + " FROM selected s JOIN fills f ON s.model_id = f.model_id"


def robust_sql(columns: list[str], source: str = "filled") -> str:
    made = []
    for c in columns:
        spread = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        made += [f"quantile_cont({c}, 0.5) AS m_{c}", f"CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS s_{c}"]
    return f"SELECT model_id, {', '.join(made)} FROM {source} GROUP BY model_id"


def prepared_sql(columns: list[str], source: str = "filled", factor: str = "", kept: str = "") -> str:
    return f"SELECT p.model_id, global_id, ifc_type, {kept}" + ", ".join(f"({c}{factor} - m_{c}) / s_{c} AS {c}" for c in columns) + f" FROM {source} p JOIN scaler USING (model_id)"


FLAGGED = {
    "selected": selected_sql(SIZES),
    "fills": fills_sql(SIZES),
    "filled": filled_sql(SIZES),
    "scaler": robust_sql(SIZES),
    "scored": "SELECT model_id, global_id, ifc_type, round(-(abs(dim_x) + abs(dim_y) + abs(dim_z)), 9) AS anomaly_score FROM ("
    + prepared_sql(SIZES)
    + ")",
    "limits": """SELECT q.model_id, low, high, CASE WHEN n > 1000 THEN q2 WHEN n > 500 THEN q3 ELSE q5 END AS score_limit
 FROM (SELECT model_id, min(anomaly_score) AS low, max(anomaly_score) AS high, quantile_cont(anomaly_score, 0.02) AS q2,
 quantile_cont(anomaly_score, 0.03) AS q3, quantile_cont(anomaly_score, 0.05) AS q5 FROM scored GROUP BY model_id) q
 JOIN (SELECT model_id, count(*) AS n FROM features GROUP BY model_id) c ON q.model_id = c.model_id WHERE n > 10""",
    "flagged": """SELECT s.model_id, global_id, ifc_type, anomaly_score, anomaly_score < score_limit AS is_anomaly,
 CASE WHEN high = low THEN CAST(0.5 AS DOUBLE) ELSE 1 - (anomaly_score - low) / (high - low) END AS anomaly_probability
 FROM scored s JOIN limits l ON s.model_id = l.model_id""",
}


def with_ctes(body: str, **ctes: str) -> str:
    parts = {"features": FEATURES_SQL, **ctes}
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + " " + body


def on_features(body: str) -> str:
    return with_ctes(body)


def on_issues(body: str) -> str:
    return with_ctes(body, issues=ISSUES_SQL)


def on_summary(body: str) -> str:
    return with_ctes(body, issues=ISSUES_SQL, summary=summary_sql())


def on_results(body: str, anomalies: bool = False, failures: bool = True) -> str:
    ctes = {"issues": ISSUES_SQL, "summary": summary_sql()}
    if anomalies:
        ctes |= FLAGGED
    return with_ctes(body, **ctes, results=results_sql(anomalies, failures))


def on_flagged(body: str) -> str:
    return with_ctes(body, **FLAGGED)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns)


def ranked(order: str, partition: str = "model_id") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS INTEGER)"


RESULT_ROWS = (
    "SELECT model_name, model_path, status, element_count, total_issues, critical_issues, major_issues, minor_issues, "
    + r6("quality_score", "issue_rate_per_1k", "metadata_completeness_pct")
    + ", anomaly_count, "
    + r6("anomaly_rate", "runtime_seconds")
    + ", error_message FROM results"
)
OK = "FROM results WHERE status = 'success'"


def _step_args() -> str:
    def quoted(c):
        return f"coalesce('''' || replace({c}, '''', '''''') || '''', '$')"

    filler = "CASE ifc_type " + " ".join(f"WHEN '{t}' THEN '{f},.' || predefined_type || '.'" for t, f in STEP_FILLER.items()) + " ELSE ',$' END"
    return f"{quoted('global_id')} || ',#2,' || {quoted('name')} || ',' || {quoted('description')} || ',' || {quoted('object_type')} || ',#5,#6' || {filler}"


def _sources() -> dict[str, str]:
    predefined = "CASE WHEN ifc_type <> 'IfcFlowSegment' THEN predefined_type END AS predefined_type"
    shown = f"model_id, global_id, ifc_type, name, description, object_type, {predefined}"
    header = """SELECT 'model_' || CAST(s_suppkey AS VARCHAR) AS model_id,
 CASE WHEN s_suppkey % 3 = 0 THEN 'IFC2X3' ELSE 'IFC4' END AS schema, 'ViewDefinition [CoordinationView]' AS description,
 '2;1' AS implementation_level, CAST(s_suppkey AS VARCHAR) || '.ifc' AS name, '2024-01-01T00:00:00' AS time_stamp,
 CASE WHEN s_suppkey % 4 <> 0 THEN 'O''' || s_name END AS author, n_name AS organization, 'writer 1.0' AS preprocessor_version,
 'system ' || CAST(s_nationkey AS VARCHAR) AS originating_system, '' AS "authorization"
 FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
    return {
        "step_scan": on_features(f"SELECT model_id, entity_id, upper(ifc_type) AS entity_type, {_step_args()} AS args FROM features"),
        "step_elements": on_features(f"SELECT {shown} FROM features"),
        "step_elements_first_100": on_features(
            f"SELECT entity_id, {shown} FROM (SELECT *, {ranked('entity_id, global_id')} AS r FROM features) WHERE r <= 100"
        ),
        "model_metadata": header,
        "validate_models": on_features(
            """SELECT path, error IS NULL AS is_valid, error, error IS NULL AND path LIKE '%.IFCZIP' AS unsupported FROM (
 SELECT path, CASE WHEN k = 2 THEN 'File does not exist: ' || path WHEN k = 3 THEN 'Path is not a file: ' || path
 WHEN k = 4 THEN 'File extension must be .ifc or .ifczip, got: .txt'
 WHEN k <> 5 AND (header_path IS NULL OR entity_path IS NULL) THEN 'Failed to parse IFC file: no header or no entity' END AS error
 FROM (SELECT s_suppkey % 10 AS k, 'model_' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 10 WHEN 4 THEN '.txt' WHEN 5 THEN '.IFCZIP' ELSE '.ifc' END AS path FROM supplier)
 LEFT JOIN (SELECT 'model_' || CAST(s_suppkey AS VARCHAR) || '.ifc' AS header_path FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON path = header_path
 LEFT JOIN (SELECT DISTINCT model_id || '.ifc' AS entity_path FROM features) ON path = entity_path)"""
        ),
        "model_listing": on_features(
            """SELECT DISTINCT CASE WHEN entity_id // 10000000 % 8 <= 3 THEN 'a/' ELSE 'b/' END || model_id AS model_id, TRUE AS filled FROM features
 UNION ALL SELECT 'empty/supplier_' || CAST(s_suppkey AS VARCHAR), TRUE FROM supplier WHERE s_suppkey % 20 = 3"""
        ),
        "elements_csv": on_features(f"SELECT * REPLACE (nullif(name, '') AS name, nullif(object_type, '') AS object_type) FROM (SELECT {', '.join(ELEMENT)} FROM features)"),
        "features_roundtrip": on_features(f"SELECT {', '.join(FEATURES.fieldNames())} FROM features"),
        "summary_report": on_features(
            f"""SELECT h.model_id, schema, originating_system, total_elements, unique_types, ifc_type, type_count FROM ({header}) h
 JOIN (SELECT model_id, count(*) AS total_elements, count(DISTINCT ifc_type) AS unique_types FROM features GROUP BY model_id) t ON h.model_id = t.model_id
 JOIN (SELECT model_id, ifc_type, count(*) AS type_count FROM features GROUP BY model_id, ifc_type) c ON h.model_id = c.model_id"""
        ),
    }


def _box(embedding: str) -> str:
    """Every float of the list, three times over, as vertices."""
    made = []
    whole = f"list_concat({embedding}, list_concat({embedding}, {embedding}))"
    for end in ("min", "max"):
        for i, axis in enumerate("xyz"):
            values = f"[CAST({whole}[i] AS DOUBLE) FOR i IN range({i + 1}, 3 * len({embedding}) + 1, 3)]"
            made.append(f"list_{end}({values}) AS bbox_{end}_{axis}")
    return ", ".join(made)


BOX = [f"bbox_{end}_{axis}" for end in ("min", "max") for axis in "xyz"]
BOX_FEATURES = ", ".join(
    [f"(bbox_min_{a} + bbox_max_{a}) / 2 AS centroid_{a}" for a in "xyz"]
    + [f"bbox_max_{a} - bbox_min_{a} AS dim_{a}" for a in "xyz"]
)


def _ratios() -> str:
    def ratio(name, part, by):
        return f"CASE WHEN {by} > 1e-10 THEN {part} / ({by} + 1e-10) END AS aspect_ratio_{name}"

    return ", ".join(
        ["dim_x * dim_y * dim_z AS bbox_volume", ratio("xy", "dim_x", "dim_y"), ratio("yz", "dim_y", "dim_z"), ratio("xz", "dim_x", "dim_z")]
    )


def _mesh_features(source: str, kept: str) -> str:
    return f"SELECT *, {_ratios()} FROM (SELECT {kept}, {', '.join(BOX)}, {BOX_FEATURES} FROM ({source}))"


def _geometry() -> dict[str, str]:
    ids = "CAST(label AS VARCHAR) AS model_id, CAST(vec_id AS VARCHAR) AS global_id"
    boxes = f"SELECT {ids}, {_box('embedding')} FROM embeddings"
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {b}" for b in BOX)
    shared = (
        "SELECT CAST(label AS VARCHAR) AS model_id, CAST(vec_id // 3 AS VARCHAR) AS global_id, vec_id AS entity_id, "
        f"vec_id % 11 <> 0 AS has_geometry, {', '.join(f'CASE WHEN usable THEN {b} END AS {b}' for b in BOX)} FROM "
        f"(SELECT *, vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS usable, {_box('embedding')} FROM embeddings)"
    )
    shared_features = _mesh_features(shared, "model_id, global_id, entity_id, has_geometry")
    triples = {
        "centroid": [f"centroid_{a}" for a in "xyz"],
        "bbox_min": BOX[:3],
        "bbox_max": BOX[3:],
        "dimensions": SIZES,
        "aspect_ratios": [f"aspect_ratio_{r}" for r in ("xy", "yz", "xz")],
    }
    parts = ", ".join(f"{c} AS {t}_{i}" for t, columns in triples.items() for i, c in enumerate(columns))
    return {
        "mesh_bbox": boxes,
        "mesh_bbox_ragged": f"SELECT {ids}, TRUE AS has_geometry, {none} FROM embeddings",
        "mesh_bbox_long": boxes,
        "mesh_features": f"SELECT model_id, global_id, TRUE AS has_geometry, {', '.join(GEOMETRY_COLUMNS)} FROM ({_mesh_features(boxes, 'model_id, global_id')})",
        "geometry_summary": f"SELECT model_id, global_id, entity_id, has_geometry, bbox_volume, {parts} FROM ({shared_features})",
        "geometry_features": f"""WITH meshes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, global_id ORDER BY entity_id DESC) AS r
 FROM ({shared_features})) WHERE r = 1)
 SELECT e.model_id, e.global_id, e.name, coalesce(has_geometry, FALSE) AS has_geometry, {', '.join(GEOMETRY_COLUMNS)} FROM
 (SELECT CAST(label AS VARCHAR) AS model_id, CASE WHEN vec_id % 7 = 0 THEN 'none-' ELSE '' END || CAST(vec_id // 3 AS VARCHAR) AS global_id,
 'element ' || CAST(vec_id AS VARCHAR) AS name FROM embeddings) e
 LEFT JOIN meshes m ON e.model_id = m.model_id AND e.global_id = m.global_id""",
    }


def _profiles() -> dict[str, str]:
    counted = "SELECT model_id, ifc_type, count(*) AS count FROM features GROUP BY model_id, ifc_type"

    def top(n):
        return on_features(
            f"SELECT model_id, ifc_type, count FROM (SELECT *, {ranked('count DESC, ifc_type')} AS r FROM ({counted})) WHERE r <= {n}"
        )

    complete = " AND ".join(f"{c} IS NOT NULL" for c in ("centroid_x", "dim_x", "dim_y", "dim_z", "bbox_volume"))
    ready = f"SELECT model_id, {', '.join(GEOMETRY_COLUMNS)} FROM features WHERE has_geometry AND " + " AND ".join(
        f"{c} IS NOT NULL" for c in GEOMETRY_COLUMNS
    )
    stats = " UNION ALL ".join(
        f"""SELECT model_id, '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
 round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM ready GROUP BY model_id"""
        for c in GEOMETRY_COLUMNS
    )
    ties = "global_id, name NULLS FIRST, ifc_type, dim_x, dim_y, dim_z"
    shown = "model_id, bbox_volume, global_id, name, ifc_type, dim_x, dim_y, dim_z"
    solid = "FROM features WHERE has_geometry AND bbox_volume IS NOT NULL"
    sample = "global_id, ifc_type, name NULLS FIRST, dim_x NULLS FIRST, dim_y NULLS FIRST, dim_z NULLS FIRST"
    return {
        "element_summary": on_features(counted),
        "element_summary_top10": top(10),
        "element_summary_top3": top(3),
        "attribute_presence": on_features(
            """SELECT model_id, count(*) AS total_elements, count(name) AS with_name, count(object_type) AS with_object_type,
 round(CAST(count(name) AS DOUBLE) / count(*) * 100, 6) AS name_pct,
 round(CAST(count(object_type) AS DOUBLE) / count(*) * 100, 6) AS object_type_pct FROM features GROUP BY model_id"""
        ),
        "geometry_coverage": on_features(
            f"""SELECT model_id, n AS total_elements, g AS elements_with_geometry, c AS complete_features, n - g AS elements_without_geometry,
 round(CAST(g AS DOUBLE) / n * 100, 6) AS coverage_percentage, round(CAST(c AS DOUBLE) / n * 100, 6) AS complete_percentage FROM
 (SELECT model_id, count(*) AS n, count(*) FILTER (WHERE has_geometry) AS g, count(*) FILTER (WHERE {complete}) AS c FROM features GROUP BY model_id)"""
        ),
        "ml_ready_features": on_features(ready),
        "feature_stats": with_ctes(stats, ready=ready),
        "volume_extremes": on_features(
            f"""SELECT model_id, 'largest' AS extreme, bbox_volume, global_id, name, ifc_type, dim_x, dim_y, dim_z FROM
 (SELECT {shown}, {ranked(f'bbox_volume DESC, {ties}')} AS r {solid}) WHERE r = 1
 UNION ALL SELECT model_id, 'smallest', bbox_volume, global_id, name, ifc_type, dim_x, dim_y, dim_z FROM
 (SELECT {shown}, {ranked(f'bbox_volume, {ties}')} AS r {solid}) WHERE r = 1"""
        ),
        "unusual_ratios": on_features(
            "SELECT model_id, count(*) FILTER (WHERE has_geometry AND (aspect_ratio_xy > 10 OR aspect_ratio_xy < CAST(0.1 AS DOUBLE))) AS unusual_count FROM features GROUP BY model_id"
        ),
        "geometry_sample": on_features(
            f"""SELECT * FROM (SELECT model_id, {ranked(sample)} AS sample_rank, global_id, ifc_type, name, dim_x, dim_y, dim_z, bbox_volume
 FROM features WHERE has_geometry) WHERE sample_rank <= 5"""
        ),
    }


def _checks() -> dict[str, str]:
    names = {
        "check_missing_name": "missing_name",
        "check_missing_object_type": "missing_object_type",
        "check_duplicate_global_ids": "duplicate_global_id",
        "check_degenerate_geometry": "degenerate_geometry",
        "check_extreme_dimensions": "extreme_dimension",
        "check_coordinate_anomalies": "coordinate_anomaly",
        "check_extreme_aspect_ratios": "extreme_aspect_ratio",
    }

    def listed(column):
        return f"""(SELECT model_id, string_agg({column} || ':' || CAST(n AS VARCHAR), ',' ORDER BY {column}) AS t
 FROM (SELECT model_id, {column}, count(*) AS n FROM issues GROUP BY model_id, {column}) GROUP BY model_id)"""

    return {
        **{query: on_issues(f"SELECT * FROM issues WHERE issue_type = '{issue}'") for query, issue in names.items()},
        "run_all_checks": on_issues("SELECT * FROM issues"),
        "run_all_checks_custom_limits": with_ctes("SELECT * FROM issues", issues=issues_sql(1.0, 45.0, 90000.0, 50.0)),
        "issues_summary": on_summary(
            f"""SELECT s.model_id, total_issues, critical AS critical_count, major AS major_count, minor AS minor_count,
 coalesce(a.t, '') AS by_severity, coalesce(b.t, '') AS by_type FROM summary s LEFT JOIN {listed('severity')} a ON s.model_id = a.model_id
 LEFT JOIN {listed('issue_type')} b ON s.model_id = b.model_id"""
        ),
        "severity_samples": on_issues(
            f"""SELECT * FROM (SELECT model_id, severity, {ranked('global_id, issue_type, message, ifc_type, element_name NULLS FIRST', 'model_id, severity')} AS sample_rank,
 global_id, issue_type, message, ifc_type, element_name FROM issues WHERE severity IN ('critical', 'major')) WHERE sample_rank <= 5"""
        ),
        "model_health": on_issues(
            """SELECT model_id, n AS total_elements, b AS elements_with_issues, n - b AS clean_elements,
 round(CAST(b AS DOUBLE) / n * 100, 6) AS issue_pct, round(CAST(n - b AS DOUBLE) / n * 100, 6) AS clean_pct FROM
 (SELECT t.model_id, n, coalesce(b, 0) AS b FROM (SELECT model_id, count(*) AS n FROM features GROUP BY model_id) t
 LEFT JOIN (SELECT model_id, count(DISTINCT global_id) AS b FROM issues GROUP BY model_id) i ON t.model_id = i.model_id)"""
        ),
        "score_tiers": on_summary(
            """SELECT model_id, round(quality_score, 6) AS quality_score,
 CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 70 THEN 'good' WHEN quality_score >= 50 THEN 'moderate' ELSE 'poor' END AS tier,
 CASE WHEN quality_score >= 90 THEN 'excellent' WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 70 THEN 'moderate' ELSE 'poor' END AS published_tier
 FROM summary"""
        ),
    }


def _metrics() -> dict[str, str]:
    def by(column):
        return f"SELECT model_id, {column}, count(*) AS count FROM issues GROUP BY model_id, {column}"

    def top(column, n):
        return f"SELECT * FROM (SELECT *, {ranked(f'count DESC, {column}')} AS rank FROM ({by(column)})) WHERE rank <= {n}"

    shares = f"""SELECT model_id, issue_type, count, CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY model_id) AS pct,
 CAST(sum(count) OVER (PARTITION BY model_id ORDER BY count DESC, issue_type ROWS UNBOUNDED PRECEDING) AS DOUBLE)
 / sum(count) OVER (PARTITION BY model_id) AS cum_pct, {ranked('count DESC, issue_type')} AS rank FROM ({by('issue_type')})"""
    kpis = ("total_elements", "quality_score", "total_issues", "issue_rate_per_1000", "name_pct", "object_type_pct", "geometry_pct", "critical", "major", "minor")
    score = "SELECT model_id, total_elements, total_issues, round(quality_score, 6) AS quality_score FROM summary"

    def listed(column, n):
        return f"(SELECT model_id, string_agg({column} || ':' || CAST(count AS VARCHAR), ',' ORDER BY rank) AS t FROM ({top(column, n)}) GROUP BY model_id)"

    pcts = r6("quality_score", "issue_rate_per_1000", "name_pct", "object_type_pct", "geometry_pct")
    head = f"""(SELECT model_id, string_agg(printf('%s:%d:%.12f:%.12f', issue_type, count, pct, cum_pct), ',' ORDER BY rank) AS t
 FROM ({shares}) WHERE rank <= 5 GROUP BY model_id)"""
    document = on_summary(
        f"""SELECT s.model_id, total_elements, total_issues, critical, major, minor, {pcts}, coalesce(a.t, '') AS top_ifc_types,
 coalesce(b.t, '') AS top_issue_types, coalesce(c.t, '') AS pareto FROM summary s LEFT JOIN {listed('ifc_type', 5)} a ON s.model_id = a.model_id
 LEFT JOIN {listed('issue_type', 5)} b ON s.model_id = b.model_id LEFT JOIN {head} c ON s.model_id = c.model_id"""
    )
    return {
        "severity_breakdown": on_summary("SELECT model_id, critical, major, minor FROM summary"),
        "issue_rate": on_summary(
            "SELECT model_id, total_elements, total_issues, round(issue_rate_per_1000, 6) AS issue_rate_per_1000 FROM summary"
        ),
        "metadata_completeness": on_features(
            f"SELECT model_id, total_elements, {r6('name_pct', 'object_type_pct', 'geometry_pct')} FROM ({TOTALS_SQL})"
        ),
        "top_offenders_ifc_type": on_issues(top("ifc_type", 3)),
        "top_offenders_issue_type": on_issues(top("issue_type", 3)),
        "quality_score": on_summary(score),
        "quality_score_custom_weights": with_ctes(score, issues=ISSUES_SQL, summary=summary_sql(CUSTOM_WEIGHTS)),
        "kpi_long": on_summary(
            " UNION ALL ".join(f"SELECT model_id, '{k}' AS metric, round(CAST({k} AS DOUBLE), 6) AS value FROM summary" for k in kpis)
        ),
        "severity_frame": on_summary(
            " UNION ALL ".join(f"SELECT model_id, '{s}' AS severity, {s} AS count FROM summary" for s in ("critical", "major", "minor"))
        ),
        "issues_by_ifc_type": on_issues(by("ifc_type")),
        "issues_by_type": on_issues(by("issue_type")),
        "pareto": on_issues(shares),
        "pareto_top_n": on_issues(f"SELECT * FROM ({shares}) WHERE rank <= 3"),
        "metrics_document": document,
        "metrics_json": document,
    }


def _from_step() -> str:
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in GEOMETRY_COLUMNS)
    ctes = {
        "given": FEATURES_SQL,
        "features": f"""SELECT CASE WHEN entity_id // 10000000 % 8 <= 3 THEN 'a/' ELSE 'b/' END || model_id AS model_id, entity_id, global_id, ifc_type, name,
 description, object_type, predefined_type, false AS has_geometry, {none} FROM given""",
        "issues": ISSUES_SQL,
        "summary": summary_sql(),
        "results": f"""SELECT * REPLACE (regexp_replace(model_path, '[.]ifc$', '') AS model_path) FROM ({results_sql(with_failures=False)})""",
    }
    columns = RESULT_ROWS.replace(r6("anomaly_rate", "runtime_seconds"), r6("anomaly_rate")).replace(" FROM results", "")
    bare = """SELECT 'empty/supplier_' || CAST(s_suppkey AS VARCHAR), 'empty/supplier_' || CAST(s_suppkey AS VARCHAR), 'failure', 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL,
 'NoElements: no product in the file' FROM supplier WHERE s_suppkey % 20 = 3"""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + f" {columns} FROM results UNION ALL {bare}"


def _boxes() -> str:
    """The box of each body from its corners: turned by (0.6, 0.8) on even lines, raised by its storey, moved by its site."""
    named = ", ".join(f"{sql} AS {name}" for name, sql in {n: BASE[n] for n in ("model_id", "entity_id", "global_id")}.items())
    sized = ", ".join(f"{sql} AS {name}" for name, sql in BODY.items())
    corner = "list_value({a}0, {a}1, {a}0, CASE WHEN line IN (1, 4) THEN {a}0 ELSE {a}1 END)"
    xs, ys = corner.format(a="a"), "list_value(b0, b0, b1, CASE WHEN line IN (1, 4) THEN b0 ELSE b1 END)"
    out, dims = [], []
    for axis in "xyz":
        low, high = f"list_min({axis}s) * metres", f"list_max({axis}s) * metres"
        out += [f"round({low}, 8) AS bbox_min_{axis}", f"round({high}, 8) AS bbox_max_{axis}"]
        dims += [f"round(({low} + {high}) / 2, 8) AS centroid_{axis}", f"round({high} - {low}, 8) AS dim_{axis}"]
    return f"""WITH rows AS (SELECT {named}, CAST(l_linenumber AS INTEGER) AS line, l_quantity, {sized} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 7),
 sides AS (SELECT *, CASE WHEN line = 3 THEN -dx / 2 ELSE 0.0::DOUBLE END AS a0, CASE WHEN line = 3 THEN dx / 2 ELSE dx END AS a1,
 CASE WHEN line = 3 THEN -dy / 2 ELSE 0.0::DOUBLE END AS b0, CASE WHEN line = 3 THEN dy / 2 WHEN line = 5 THEN dx ELSE dy END AS b1,
 CASE WHEN line = 5 THEN dx ELSE dz END AS c1, CASE WHEN line % 2 = 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS c, CASE WHEN line % 2 = 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS s,
 CASE length(model_id) % 3 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.3048::DOUBLE END AS metres FROM rows),
 corners AS (SELECT *, list_zip({xs}, {ys}) AS corner FROM sides),
 turned AS (SELECT *, list_transform(corner, lambda p: c * (cx + p[1]) - s * (cy + p[2]) + 100.0 * length(model_id)) AS xs,
 list_transform(corner, lambda p: s * (cx + p[1]) + c * (cy + p[2])) AS ys, list_value(cz + 3 * line, cz + c1 + 3 * line) AS zs FROM corners)
 SELECT model_id, CAST({BODY_NUMBER} AS BIGINT) AS entity_id, global_id, true AS has_geometry, {", ".join(out + dims)} FROM turned"""


def _portfolio() -> dict[str, str]:
    kpis = {
        "avg_quality_score": "avg(quality_score)", "median_quality_score": "median(quality_score)",
        "min_quality_score": "min(quality_score)", "max_quality_score": "max(quality_score)",
        "std_quality_score": "stddev_samp(quality_score)", "avg_issue_rate_per_1k": "avg(issue_rate_per_1k)",
        "median_issue_rate_per_1k": "median(issue_rate_per_1k)", "p95_issue_rate_per_1k": "quantile_cont(issue_rate_per_1k, 0.95)",
        "avg_elements_per_model": "avg(element_count)", "avg_metadata_completeness": "avg(metadata_completeness_pct)",
        "total_runtime_seconds": "sum(runtime_seconds)", "avg_runtime_seconds": "avg(runtime_seconds)",
        "p95_runtime_seconds": "quantile_cont(runtime_seconds, 0.95)",
    }
    sums = {
        "total_issues": "total_issues", "total_critical_issues": "critical_issues", "total_major_issues": "major_issues",
        "total_minor_issues": "minor_issues", "total_elements": "element_count",
    }
    ok = " FILTER (WHERE status = 'success')"
    kpi_list = ", ".join(
        [f"round({sql}{ok}, 6) AS {name}" for name, sql in kpis.items()]
        + [f"CAST(sum({sql}){ok} AS BIGINT) AS {name}" for name, sql in sums.items()]
    )

    counts = f"""count(*) AS total_models, count(*){ok} AS success_models, count(*) FILTER (WHERE status <> 'success') AS failed_models,
 round(CAST(count(*){ok} AS DOUBLE) / count(*), 6) AS success_rate"""
    rates = """round(avg(anomaly_rate), 6) AS avg_anomaly_rate, round(median(anomaly_rate), 6) AS median_anomaly_rate,
 round(quantile_cont(anomaly_rate, 0.95), 6) AS p95_anomaly_rate, round(max(anomaly_rate), 6) AS max_anomaly_rate"""

    def top(column):
        return f"SELECT model_name, {column} {OK} ORDER BY {column} DESC, model_name LIMIT 5"

    def listed(column):
        return f"(SELECT string_agg(model_name || ':' || CAST({column} AS VARCHAR), ',' ORDER BY {column} DESC, model_name) FROM ({top(column)}))"

    best = f"(SELECT model_name {OK} ORDER BY quality_score DESC, model_name LIMIT 1)"
    worst = f"(SELECT model_name {OK} ORDER BY quality_score, model_name LIMIT 1)"
    return {
        "model_results": on_results(RESULT_ROWS, failures=False),
        "model_results_with_failures": on_results(RESULT_ROWS),
        "portfolio_from_step": _from_step(),
        "boxes_from_step": _boxes(),
        "anomaly_rate_known": on_features(
            f"""SELECT model_id, count(*) > 10 AND bool_or(has_geometry)
 AND NOT (model_id = '{DRILLDOWN_MODEL}' AND bool_or(has_geometry AND entity_id % 20 = 3)) AS known FROM features GROUP BY model_id"""
        ),
        "adaptive_contamination": on_features(
            """SELECT model_id, count(*) AS element_count, CAST(CASE WHEN count(*) > 1000 THEN 0.02 WHEN count(*) > 500 THEN 0.03
 WHEN count(*) > 10 THEN 0.05 END AS DOUBLE) AS contamination FROM features GROUP BY model_id"""
        ),
        "portfolio_kpis": on_results(
            f"SELECT {counts}, {kpi_list} FROM results"
        ),
        "best_worst_model": on_results(f"SELECT {best} AS best_model, {worst} AS worst_model"),
        "portfolio_anomaly_kpis": on_results(
            f"SELECT count(*) AS models_with_ml, CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, {rates} {OK} AND anomaly_rate IS NOT NULL",
            anomalies=True,
        ),
        "top_models_critical": on_results(top("critical_issues")),
        "top_models_issues": on_results(top("total_issues")),
        "below_threshold": on_results(
            f"""SELECT CAST(80 AS DOUBLE) AS quality_threshold, count(*) FILTER (WHERE quality_score < 80) AS models_below_threshold,
 round(CAST(count(*) FILTER (WHERE quality_score < 80) AS DOUBLE) / count(*) * 100, 6) AS pct_below_threshold {OK}"""
        ),
        "portfolio_metrics": on_results(
            f"""SELECT {counts}, {kpi_list}, {best} AS best_model, {worst} AS worst_model,
 CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, {rates},
 CAST(80 AS DOUBLE) AS quality_threshold, count(*) FILTER (WHERE status = 'success' AND quality_score < 80) AS models_below_threshold,
 round(CAST(count(*) FILTER (WHERE status = 'success' AND quality_score < 80) AS DOUBLE) / greatest(count(*){ok}, 1) * 100, 6) AS pct_below_threshold,
 {listed('critical_issues')} AS top_models_by_critical, {listed('total_issues')} AS top_models_by_issues FROM results""",
            anomalies=True,
        ),
    }


def _views() -> dict[str, str]:
    calm = ", ".join(
        f"'{n}'" for n in ("missing_name", "missing_object_type", "degenerate_geometry", "coordinate_anomaly", "extreme_aspect_ratio")
    )
    shares = """SELECT issue_type, count, CAST(count AS DOUBLE) / sum(count) OVER () AS pct,
 CAST(sum(count) OVER (ORDER BY count DESC, issue_type ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(count) OVER () AS cum_pct,
 CAST(row_number() OVER (ORDER BY count DESC, issue_type) AS INTEGER) AS rank
 FROM (SELECT issue_type, count(*) AS count FROM issues GROUP BY issue_type)"""
    rate = "issue_rate_per_1k"
    return {
        "quality_ranking": on_results(f"SELECT model_name, round(quality_score, 6) AS quality_score {OK}"),
        "critical_or_total_top": on_results(
            f"""SELECT model_name, critical_issues AS issue_count, 'critical_issues' AS ranked_by {OK} AND critical_issues > 0
 ORDER BY critical_issues DESC, model_name LIMIT 10"""
        ),
        "total_top_without_critical": on_issues(
            f"""SELECT model_id AS model_name, count(*) AS issue_count, 'total_issues' AS ranked_by FROM issues WHERE issue_type IN ({calm})
 GROUP BY model_id ORDER BY count(*) DESC, model_id LIMIT 10"""
        ),
        "issue_rate_histogram": on_results(
            f"""SELECT b AS bin, round(low + b * width, 6) AS bin_start, round(low + (b + 1) * width, 6) AS bin_end, coalesce(n, 0) AS model_count
 FROM (SELECT unnest(range(20)) AS b) CROSS JOIN (SELECT min({rate}) AS low, (max({rate}) - min({rate})) / 20 AS width {OK})
 LEFT JOIN (SELECT CAST(least(19, floor(({rate} - low) / width)) AS BIGINT) AS k, count(*) AS n
 FROM results CROSS JOIN (SELECT min({rate}) AS low, (max({rate}) - min({rate})) / 20 AS width {OK}) WHERE status = 'success' GROUP BY 1) ON b = k"""
        ),
        "issue_rate_percentiles": on_results(
            f"SELECT round(median({rate}), 6) AS p50, round(quantile_cont({rate}, 0.95), 6) AS p95 {OK}"
        ),
        "anomaly_rate_top": on_results(
            f"""SELECT model_name, round(anomaly_rate, 6) AS anomaly_rate, round(anomaly_rate * 100, 6) AS anomaly_pct {OK} AND anomaly_count > 0
 ORDER BY results.anomaly_rate DESC, model_name LIMIT 10""",
            anomalies=True,
        ),
        "portfolio_pareto": on_issues(shares),
        "issues_sink_pareto": on_issues(shares),
        "top_offender_models": on_results(
            f"""SELECT model_name, round(quality_score, 6) AS quality_score, critical_issues, total_issues, round({rate}, 6) AS {rate}, element_count {OK}
 ORDER BY total_issues DESC, model_name LIMIT 10"""
        ),
        "failed_models": on_results("SELECT model_name, error_message FROM results WHERE status = 'failure'"),
        "model_drilldown": on_results(
            f"""SELECT model_id, total_elements, total_issues, critical, major, minor, {r6('quality_score', 'issue_rate_per_1000', 'name_pct', 'object_type_pct', 'geometry_pct')},
 (SELECT count(*) FROM flagged WHERE model_id = '{DRILLDOWN_MODEL}' AND is_anomaly) AS anomaly_count,
 round(CAST((SELECT count(*) FROM flagged WHERE model_id = '{DRILLDOWN_MODEL}' AND is_anomaly) AS DOUBLE) / total_elements * 100, 6) AS anomaly_rate_pct
 FROM summary WHERE model_id = '{DRILLDOWN_MODEL}'""",
            anomalies=True,
        ),
        "stored_drilldown": on_summary(
            f"""SELECT model_id, total_elements, total_issues, critical, major, minor,
 {r6('quality_score', 'issue_rate_per_1000', 'name_pct', 'object_type_pct', 'geometry_pct')} FROM summary WHERE model_id = '{DRILLDOWN_MODEL}'"""
        ),
        "top_issues": on_issues(
            f"""SELECT * FROM (SELECT model_id, {ranked("CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, global_id, issue_type, message, ifc_type, element_name NULLS FIRST")} AS rank,
 severity, issue_type, ifc_type, global_id, element_name, message FROM issues) WHERE rank <= 20"""
        ),
        "top_anomalies": on_flagged(
            f"""SELECT model_id, rank, ifc_type, global_id, round(anomaly_score, 6) AS anomaly_score, round_even(anomaly_probability * 100, 1) AS anomaly_probability_pct
 FROM (SELECT *, {ranked('anomaly_score, global_id, ifc_type')} AS rank FROM flagged WHERE is_anomaly) WHERE rank <= 20"""
        ),
        "quality_gate": on_summary(
            "SELECT model_id, round(quality_score, 6) AS quality_score, CASE WHEN quality_score >= 80 THEN 'PASS' ELSE 'FAIL' END AS gate FROM summary"
        ),
    }


def _outliers() -> dict[str, str]:
    selected = {"selected": selected_sql(ML)}
    plain = "SELECT model_id, global_id, " + ", ".join(ML) + " FROM "
    shown = "SELECT model_id, global_id, " + r6(*ML) + " FROM "
    zeros = {**selected, "filled": "SELECT model_id, global_id, ifc_type, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ML) + " FROM selected"}
    standard = "SELECT model_id, " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in ML
    ) + " FROM filled GROUP BY model_id"
    derived = """dim_x * dim_y * dim_z AS volume, 2 * (dim_x * dim_y + dim_y * dim_z + dim_z * dim_x) AS surface_area,
 sqrt(centroid_x * centroid_x + centroid_y * centroid_y + centroid_z * centroid_z) AS distance_from_origin,
 greatest(dim_x, dim_y, dim_z) AS max_dimension, least(dim_x, dim_y, dim_z) AS min_dimension,
 greatest(aspect_ratio_xy, aspect_ratio_yz, aspect_ratio_xz) AS aspect_ratio_max,
 least(aspect_ratio_xy, aspect_ratio_yz, aspect_ratio_xz) AS aspect_ratio_min"""
    wild = ", ".join("CASE WHEN dim_x > 10000 THEN NULL ELSE dim_x END AS dim_x" if c == "dim_x" else c for c in ML)
    imputed = {"fills": fills_sql(ML), "filled": filled_sql(ML)}
    return {
        "ml_select": with_ctes(f"SELECT model_id, global_id, {wild} FROM selected", **selected),
        "impute_median": with_ctes(shown + "filled", **selected, **imputed),
        "impute_mean": with_ctes(shown + "filled", **selected, fills=fills_sql(ML, "avg({c})"), filled=filled_sql(ML)),
        "impute_constant": with_ctes(
            "SELECT model_id, global_id, " + ", ".join(f"coalesce({c}, 999) AS {c}" for c in ML) + " FROM selected", **selected
        ),
        "scale_robust": with_ctes(shown + f"({prepared_sql(ML)})", **zeros, scaler=robust_sql(ML)),
        "scale_standard": with_ctes(shown + f"({prepared_sql(ML)})", **zeros, scaler=standard),
        "scale_pretrained": with_ctes(shown + f"({prepared_sql(ML, factor=' * 2')})", **zeros, scaler=robust_sql(ML)),
        "preprocess_features": with_ctes(
            "SELECT model_id, global_id, ifc_type, " + r6(*ML) + f" FROM ({prepared_sql(ML)})",
            **selected, **imputed, scaler=robust_sql(ML),
        ),
        "derived_features": with_ctes(f"SELECT model_id, global_id, {derived} FROM selected", **selected),
        "anomaly_flag": on_flagged("SELECT model_id, global_id, ifc_type, round(anomaly_score, 6) + 0 AS anomaly_score, is_anomaly FROM flagged"),
        "anomaly_probability": on_flagged(f"SELECT model_id, global_id, ifc_type, {r6('anomaly_score', 'anomaly_probability')} FROM flagged"),
        "anomalies_over_threshold": on_flagged(
            f"SELECT model_id, global_id, ifc_type, is_anomaly, {r6('anomaly_score', 'anomaly_probability')} FROM flagged WHERE flagged.anomaly_probability >= 0.5"
        ),
        "anomaly_top10": on_flagged(
            f"""SELECT model_id, global_id, ifc_type, is_anomaly, {r6('anomaly_score', 'anomaly_probability')}, rank FROM
 (SELECT *, {ranked('anomaly_probability DESC, global_id, ifc_type')} AS rank FROM flagged) WHERE rank <= 10"""
        ),
        "anomaly_by_type": on_flagged(
            f"""SELECT a.model_id, a.ifc_type, anomaly_count, rank, type_count, round(CAST(anomaly_count AS DOUBLE) / type_count * 100, 6) AS pct_of_type FROM
 (SELECT *, {ranked('anomaly_count DESC, ifc_type')} AS rank FROM (SELECT model_id, ifc_type, count(*) AS anomaly_count FROM flagged WHERE is_anomaly GROUP BY model_id, ifc_type)) a
 JOIN (SELECT model_id, ifc_type, count(*) AS type_count FROM features GROUP BY model_id, ifc_type) t ON a.model_id = t.model_id AND a.ifc_type = t.ifc_type WHERE rank <= 5"""
        ),
        "anomaly_confidence": on_flagged(
            """SELECT model_id, count(*) AS anomaly_count, round(avg(anomaly_probability), 6) AS mean_probability, round(max(anomaly_probability), 6) AS max_probability,
 round(min(anomaly_probability), 6) AS min_probability, count(*) FILTER (WHERE anomaly_probability >= 0.8) AS high_confidence,
 count(*) FILTER (WHERE anomaly_probability >= 0.6 AND anomaly_probability < 0.8) AS medium_confidence,
 count(*) FILTER (WHERE anomaly_probability < 0.6) AS low_confidence FROM flagged WHERE is_anomaly GROUP BY model_id"""
        ),
    }


TREES, MOST, SEED = 100, forest.MAX_SAMPLES, 42


def _forest() -> dict[str, str]:
    """The trees grown level by level over all models at once, and every row sent down all of them."""
    values = f"[{', '.join(ML)}]"
    ends = {end: "[" + ", ".join(f"{end}({c})" for c in ML) + "]" for end in ("min", "max")}

    def word(at: int, digits: int = 8) -> str:
        return f"CAST('0x' || substr(digest, {at}, {digits}) AS BIGINT)"

    def path(size: str) -> str:
        return f"""CASE WHEN {size} <= 1 THEN CAST(0 AS DOUBLE) WHEN {size} = 2 THEN CAST(1 AS DOUBLE)
 ELSE 2 * (ln({size} - 1) + CAST({forest.EULER_GAMMA} AS DOUBLE)) - 2 * CAST({size} - 1 AS DOUBLE) / {size} END"""

    kept = "entity_id, "
    whole = {
        "selected": selected_sql(ML, kept),
        "fills": fills_sql(ML),
        "filled": filled_sql(ML, kept),
        "scaler": robust_sql(ML),
        "prepared": f"SELECT row_number() OVER (ORDER BY model_id, entity_id, {', '.join(ML)}) AS number, * FROM ({prepared_sql(ML, kept=kept)})",
        "sizes": f"""SELECT model_id, n AS sample_size, CAST(ceil(log2(greatest(2, n))) AS INTEGER) AS deepest
 FROM (SELECT model_id, CAST(least({MOST}, count(*)) AS INTEGER) AS n FROM prepared GROUP BY model_id)""",
        "trees": f"""SELECT tree, {word(1)} % {forest.PRIME} AS a, {word(9)} % {forest.PRIME} AS b, {word(17)} % {forest.PRIME} AS c
 FROM (SELECT CAST(range AS INTEGER) AS tree, md5('{SEED}:' || CAST(range AS VARCHAR)) AS digest FROM range({TREES}))""",
        "points": f"""SELECT number, model_id, {word(1)} % {forest.PRIME} AS x, {word(9)} % {forest.PRIME} AS y
 FROM (SELECT number, model_id, md5('{SEED}:' || model_id || ':' || CAST(entity_id AS VARCHAR)) AS digest FROM prepared)""",
        "sampled": f"""SELECT number, tree FROM (SELECT number, tree,
 row_number() OVER (PARTITION BY model_id, tree ORDER BY (a * x + b * y + c) % {forest.PRIME}, number) AS r FROM points CROSS JOIN trees) WHERE r <= {MOST}""",
        "level_0": f"SELECT model_id, tree, CAST(1 AS BIGINT) AS place, {', '.join(ML)} FROM sampled JOIN prepared USING (number)",
    }
    levels = (MOST - 1).bit_length()
    for depth in range(levels + 1):
        whole[f"nodes_{depth}"] = f"""SELECT model_id, tree, place, size, feature, CASE WHEN feature < 0 THEN CAST(0 AS DOUBLE)
 WHEN low + share * (high - low) >= high THEN low ELSE low + share * (high - low) END AS threshold FROM (
 SELECT *, lows[feature + 1] AS low, highs[feature + 1] AS high FROM (
 SELECT *, CAST({word(9, 13)} AS DOUBLE) / {1 << 52} AS share,
 CASE WHEN size > 1 AND len(varying) > 0 AND {depth} < deepest THEN varying[CAST(({word(1)} * len(varying)) >> 32 AS INTEGER) + 1] ELSE -1 END AS feature FROM (
 SELECT *, md5('{SEED}:' || model_id || ':' || CAST(tree AS VARCHAR) || ':' || CAST(place AS VARCHAR)) AS digest,
 list_filter(range({len(ML)}), lambda i: highs[i + 1] > lows[i + 1]) AS varying FROM (
 SELECT model_id, tree, place, CAST(count(*) AS INTEGER) AS size, {ends['min']} AS lows, {ends['max']} AS highs
 FROM level_{depth} GROUP BY model_id, tree, place) JOIN sizes USING (model_id))))"""
        whole[f"level_{depth + 1}"] = f"""SELECT model_id, tree, 2 * place + CASE WHEN {values}[feature + 1] > threshold THEN 1 ELSE 0 END AS place, {', '.join(ML)}
 FROM level_{depth} JOIN nodes_{depth} USING (model_id, tree, place) WHERE feature >= 0"""
    del whole[f"level_{levels + 1}"]
    whole["nodes"] = " UNION ALL ".join(f"SELECT *, {depth} AS depth FROM nodes_{depth}" for depth in range(levels + 1))
    walk = f"SELECT number, model_id, tree, CAST(1 AS BIGINT) AS place, {values} AS x FROM prepared CROSS JOIN trees"
    for _ in range(levels):
        walk = f"""SELECT number, model_id, tree, x, CASE WHEN feature < 0 THEN place WHEN x[feature + 1] > threshold THEN 2 * place + 1 ELSE 2 * place END AS place
 FROM ({walk}) JOIN nodes USING (model_id, tree, place)"""
    scored = {
        "paths": f"SELECT number, avg(depth + {path('size')}) AS length FROM ({walk}) JOIN nodes USING (model_id, tree, place) GROUP BY number",
        "scored": f"""SELECT p.*, round(CASE WHEN sample_size > 1 THEN -pow(CAST(2 AS DOUBLE), -length / ({path('sample_size')})) ELSE CAST(-0.5 AS DOUBLE) END, {forest.SCORE_DIGITS})
 AS anomaly_score FROM prepared p JOIN paths USING (number) JOIN sizes USING (model_id)""",
        "limits": FLAGGED["limits"],
        "flagged": f"""SELECT s.model_id, global_id, ifc_type, {', '.join(ML)}, anomaly_score, anomaly_score < score_limit AS is_anomaly,
 CASE WHEN high = low THEN CAST(0.5 AS DOUBLE) ELSE 1 - (anomaly_score - low) / (high - low) END AS anomaly_probability
 FROM scored s JOIN limits l ON s.model_id = l.model_id""",
    }

    def of(body: str, **ctes: str) -> str:
        return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in {"features": FEATURES_SQL, **ctes}.items()) + " " + body

    numbered = "SELECT *, CAST(row_number() OVER (PARTITION BY model_id, tree ORDER BY place) - 1 AS INTEGER) AS node FROM nodes"
    shown = f"SELECT model_id, global_id, ifc_type, is_anomaly, anomaly_score, {r6('anomaly_probability')} FROM flagged"
    tenth = """SELECT model_id, min(anomaly_score) AS low, max(anomaly_score) AS high, quantile_cont(anomaly_score, 0.1) AS score_limit
 FROM scored GROUP BY model_id"""
    return {
        "forest_nodes": of(
            """SELECT n.model_id, n.tree, sample_size, n.node, CAST(n.feature AS INTEGER) AS feature, round(n.threshold, 6) + 0 AS threshold,
 CAST(coalesce(l.node, -1) AS INTEGER) AS "left", CAST(coalesce(l.node + 1, -1) AS INTEGER) AS "right", n.size, n.depth
 FROM numbered n JOIN sizes USING (model_id) LEFT JOIN numbered l ON l.model_id = n.model_id AND l.tree = n.tree AND l.place = 2 * n.place""",
            **whole, numbered=numbered,
        ),
        "forest_scores": of(
            f"SELECT model_id, global_id, ifc_type, is_anomaly, anomaly_score, {r6(*ML, 'anomaly_probability')} FROM flagged", **whole, **scored
        ),
        "detect_anomalies": of(shown, **whole, **{**scored, "limits": tenth}),
        "forest_roundtrip": of(shown, **whole, **scored),
    }


def all_sql() -> dict[str, str]:
    return {
        **_sources(), **_geometry(), **_profiles(), **_checks(), **_metrics(), **_portfolio(), **_views(), **_outliers(), **_forest(),
    }
