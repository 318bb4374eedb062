"""Hand-made inputs."""

ELEMENT_SCHEMA = "model_id string, global_id string, ifc_type string, name string, object_type string"
GEOMETRY_NAMES = (
    "dim_x", "dim_y", "dim_z", "centroid_x", "centroid_y", "centroid_z",
    "aspect_ratio_xy", "aspect_ratio_yz", "aspect_ratio_xz",
)
FEATURE_SCHEMA = ELEMENT_SCHEMA + ", has_geometry boolean, " + ", ".join(f"{g} double" for g in GEOMETRY_NAMES)

ELEMENTS = [
    ("m", "id1", "IfcWall", "Wall 1", "LoadBearing"),
    ("m", "id2", "IfcDoor", None, "Single"),
    ("m", "id3", "IfcWindow", "", None),
    ("m", "id4", "IfcBeam", "Beam 1", ""),
]

GEOMETRY = [
    ("m", "id1", "IfcWall", "Wall", "W", True, 5.0, 3.0, 0.3, 10.0, 20.0, 1.5, 1.67, 10.0, 16.67),
    ("m", "id2", "IfcDoor", "Door", "D", True, 1.0, 2.0, 2.5, 5.0, 15.0, 1.2, 0.5, 0.8, 0.4),
    ("m", "id3", "IfcWindow", "Window", "N", True, 0.0005, 1.5, 1.2, 8.0, 18.0, 1.0, 0.0003, 1.25, 0.0004),
    ("m", "id4", "IfcBeam", "Beam", "B", True, 15000.0, 2.0, 0.5, 120000.0, 5.0, 2.0, 7500.0, 4.0, 30000.0),
    ("m", "id5", "IfcSlab", "Slab", "S", True, 10.0, 10.0, 0.3, 15.0, 25.0, 1.8, 1.0, 33.33, 33.33),
]

WALLS = [
    ("m", "id1", "IfcWall", "Wall 1", "W", True, 5.0, 3.0, 0.3, 10.0, 20.0, 1.5, 1.67, 10.0, 16.67),
    ("m", "id2", "IfcWall", "Wall 2", "W", True, 5.1, 3.1, 0.31, 10.5, 20.2, 1.6, 1.65, 10.0, 16.5),
    ("m", "id3", "IfcWall", "Wall 3", "W", True, 4.9, 2.9, 0.29, 9.5, 19.8, 1.4, 1.69, 10.0, 16.8),
    ("m", "id4", "IfcWall", "Wall 4", "W", True, 5.2, 3.2, 0.32, 10.2, 20.1, 1.55, 1.63, 10.0, 16.3),
    ("m", "id5", "IfcWall", "ANOMALY", "W", True, 100.0, 0.01, 50.0, 10.0, 20.0, 1.5, 10000.0, 0.0002, 2.0),
]


def elements(spark, rows=ELEMENTS):
    return spark.createDataFrame(rows, ELEMENT_SCHEMA)


def features(spark, rows=GEOMETRY):
    return spark.createDataFrame(rows, FEATURE_SCHEMA)
