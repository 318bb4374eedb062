"""Building-model tables derived from the given order and embedding tables.

Every line item becomes an element of the model of its supplier. The column texts are
shared with the SQL oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildscope.functions.columns import missing_to_null
from buildscope.operators import portfolio
from buildscope.plans.tables import materialize

BASE = {
    "model_id": """'model_' || CAST(CASE WHEN l_suppkey % 10 IN (0, 1) THEN l_suppkey - l_suppkey % 10 ELSE l_suppkey END AS VARCHAR(20))
   || CASE WHEN l_suppkey % 10 = 9 AND l_linenumber <= 3 THEN '_b' WHEN l_suppkey % 10 = 8 AND l_orderkey % 101 = 0 THEN '_tiny' ELSE '' END""",
    "entity_id": "(l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey",
    "global_id": "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20))",
    "ifc_type": """CASE p_type WHEN 'ECONOMY' THEN 'IfcWall' WHEN 'MEDIUM' THEN 'IfcDoor' WHEN 'STANDARD' THEN 'IfcWindow'
   WHEN 'SMALL' THEN 'IfcFlowSegment' WHEN 'LARGE' THEN 'IfcSlab' ELSE 'IfcSpace' END""",
    "name": "CASE WHEN l_orderkey % (37 + (l_suppkey % 4) * 30) = 0 THEN NULL WHEN l_orderkey % (37 + (l_suppkey % 4) * 30) = 1 THEN '' ELSE p_name END",
    "description": "p_brand",
    "object_type": "CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 29 = 1 THEN '' ELSE p_brand END",
    "predefined_type": "l_returnflag",
    "has_geometry": "l_linenumber <> 7",
    "dx": "CASE WHEN l_orderkey % 997 = 0 THEN l_quantity * 1000.0 WHEN l_orderkey % 991 = 0 THEN 0.0005 ELSE l_quantity END",
    "dy": "CAST(p_size AS DOUBLE) * 0.1",
    "dz": "CASE WHEN l_tax = 0 AND l_orderkey % 5 = 0 THEN 0.0 ELSE l_tax * 10.0 + 0.5 END",
    "cx": "l_extendedprice * (CASE WHEN l_suppkey % 10 = 3 THEN 2.0 ELSE 1.0 END)",
    "cy": "p_retailprice",
    "cz": "l_discount * 100.0",
}
ELEMENT = ["model_id", "entity_id", "global_id", "ifc_type", "name", "description", "object_type", "predefined_type"]
GEOMETRY = {
    "has_geometry": "has_geometry",
    "centroid_x": "CASE WHEN has_geometry THEN CAST(cx AS DOUBLE) END",
    "centroid_y": "CASE WHEN has_geometry THEN CAST(cy AS DOUBLE) END",
    "centroid_z": "CASE WHEN has_geometry THEN CAST(cz AS DOUBLE) END",
    "dim_x": "CASE WHEN has_geometry THEN CAST(dx AS DOUBLE) END",
    "dim_y": "CASE WHEN has_geometry THEN dy END",
    "dim_z": "CASE WHEN has_geometry THEN CAST(dz AS DOUBLE) END",
    "bbox_volume": "CASE WHEN has_geometry THEN CAST(dx AS DOUBLE) * dy * CAST(dz AS DOUBLE) END",
    "aspect_ratio_xy": "CASE WHEN has_geometry AND dy > 1e-10 THEN CAST(dx AS DOUBLE) / (dy + 1e-10) END",
    "aspect_ratio_yz": "CASE WHEN has_geometry AND CAST(dz AS DOUBLE) > 1e-10 THEN dy / (CAST(dz AS DOUBLE) + 1e-10) END",
    "aspect_ratio_xz": "CASE WHEN has_geometry AND CAST(dz AS DOUBLE) > 1e-10 THEN CAST(dx AS DOUBLE) / (CAST(dz AS DOUBLE) + 1e-10) END",
}

# Number of arguments before the predefined type, by element type; the others carry none.
STEP_FILLER = {"IfcWall": ",$", "IfcSlab": ",$", "IfcDoor": ",$,2.1,0.9", "IfcWindow": ",$,1.2,1.5", "IfcSpace": ",$,.ELEMENT."}

RUNTIME_PER_ELEMENT = 0.005


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.join(parts, items["l_partkey"] == parts["p_partkey"])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with geometry features. ``element_key`` is a hash of the source row."""
    rows = base_rows(spark, sf_dir)
    source = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    named = rows.select(
        *[F.expr(sql).alias(name) for name, sql in BASE.items()], F.xxhash64(*source).alias("element_key")
    )
    shaped = named.select(*ELEMENT, "element_key", *[F.expr(sql).alias(name) for name, sql in GEOMETRY.items()])
    return missing_to_null(shaped)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_rows(spark, sf_dir).select(*[F.expr(BASE[name]).alias(name) for name in ELEMENT])


def _thrice(column: str):
    """A list of any length as vertices: three times over it can be cut into triples."""
    return F.concat(column, column, column)


def meshes(spark: SparkSession, sf_dir: str, ragged: bool = False) -> DataFrame:
    """Embeddings read as vertex lists, whole: 64 floats three times over are 64 vertices.

    ``ragged`` lists are taken once and do not divide by three.
    """
    verts = F.col("embedding") if ragged else _thrice("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("model_id"),
        F.col("vec_id").cast("string").alias("global_id"),
        F.col("vec_id").alias("entity_id"),
        verts.cast("array<double>").alias("verts"),
    )


def shared_id_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three meshes per global id; every eleventh has no vertices, every thirteenth a ragged list."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("model_id"),
        F.floor(vec / 3).cast("string").alias("global_id"),
        vec.alias("entity_id"),
        F.when(vec % 11 != 0, F.when(vec % 13 == 0, F.col("embedding")).otherwise(_thrice("embedding")))
        .cast("array<double>")
        .alias("verts"),
    )


def mesh_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that look their mesh up by id; every seventh id does not exist."""
    vec = F.col("vec_id")
    found = F.floor(vec / 3).cast("string")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("model_id"),
        F.when(vec % 7 == 0, F.concat(F.lit("none-"), found)).otherwise(found).alias("global_id"),
        F.concat(F.lit("element "), vec.cast("string")).alias("name"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same meshes as one row per vertex."""
    flat = meshes(spark, sf_dir).select("model_id", "global_id", F.posexplode("verts").alias("at", "value"))
    vertex = F.floor(F.col("at") / 3)
    pick = [F.max(F.when(F.col("at") % 3 == i, F.col("value"))).alias(axis) for i, axis in enumerate("xyz")]
    return flat.groupBy("model_id", "global_id", vertex.alias("vertex")).agg(*pick)


def step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of STEP text per element."""

    def quoted(column: str):
        escaped = F.replace(F.col(column), F.lit("'"), F.lit("''"))
        return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("$"))

    kind = F.col("ifc_type")
    filler = F.lit("")
    for name, text in STEP_FILLER.items():
        filler = F.when(kind == name, F.concat(F.lit(text + ",."), F.col("predefined_type"), F.lit("."))).otherwise(filler)
    plain = F.when(kind == "IfcFlowSegment", F.lit(",$")).otherwise(F.lit(""))
    return elements(spark, sf_dir).select(
        "model_id",
        F.concat(F.col("model_id"), F.lit(".ifc")).alias("path"),
        F.concat(
            F.lit("#"), F.col("entity_id").cast("string"), F.lit("="), F.upper(kind), F.lit("("), quoted("global_id"),
            F.lit(",#2,"), quoted("name"), F.lit(","), quoted("description"), F.lit(","), quoted("object_type"),
            F.lit(",#5,#6"), plain, filler, F.lit(")"),
        ).alias("record"),
    )


def header_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header records of one model per supplier; every fourth has no author."""
    rows = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    key = F.col("s_suppkey").cast("string")
    author = F.when(F.col("s_suppkey") % 4 == 0, F.lit("()")).otherwise(F.concat(F.lit("('O''"), F.col("s_name"), F.lit("','second')")))
    name = F.concat(
        F.lit("FILE_NAME('"), key, F.lit(".ifc','2024-01-01T00:00:00',"), author, F.lit(",('"), F.col("n_name"),
        F.lit("'),'writer 1.0','system "), F.col("s_nationkey").cast("string"), F.lit("','')"),
    )
    records = F.array(
        F.lit("ISO-10303-21"),
        F.lit("HEADER;\nFILE_DESCRIPTION(('ViewDefinition [CoordinationView]','extra'),'2;1')"),
        name,
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("FILE_SCHEMA(('IFC2X3'))")).otherwise(F.lit("FILE_SCHEMA(('IFC4'))")),
        F.lit("ENDSEC"),
    )
    model = F.concat(F.lit("model_"), key)
    return rows.select(
        model.alias("model_id"), F.concat(model, F.lit(".ifc")).alias("path"), F.explode(records).alias("record")
    )


def model_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of one candidate model per supplier: some missing, some folders, some with other suffixes."""
    key = F.col("s_suppkey")
    model = F.concat(F.lit("model_"), key.cast("string"))
    suffix = (
        F.when(key % 10 == 4, ".txt").when(key % 10 == 5, ".IFCZIP").otherwise(".ifc")
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(model, suffix).alias("path"),
        (key % 10 != 2).alias("exists"),
        (key % 10 != 3).alias("is_file"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("broken_"), F.col("s_suppkey").cast("string"))
    return (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_suppkey") % 25 == 7)
        .select(
            broken.alias("model_name"),
            F.concat(broken, F.lit(".ifc")).alias("model_path"),
            F.lit("IFCLoadError: unreadable").alias("error_message"),
        )
    )


def results(spark: SparkSession, sf_dir: str, anomalies: DataFrame | None = None) -> DataFrame:
    """The written portfolio table of the models that could be read."""
    runtime = F.col("element_count") * RUNTIME_PER_ELEMENT
    return materialize(portfolio.model_results(features(spark, sf_dir), anomalies, runtime), "results")


def all_results(spark: SparkSession, sf_dir: str, anomalies: DataFrame | None = None) -> DataFrame:
    return portfolio.with_failures(results(spark, sf_dir, anomalies), failures(spark, sf_dir))


def step_file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements as the text of model files: (path, place, record).

    Line items up to the third are in folder ``a`` and the others in ``b``, so files share their names. By model, lines end in LF, in CR
    LF, or in either; some records follow a comment; every fifth model is an archive. The suppliers of every twentieth key have a
    file without products in the folder ``empty``.
    """
    rows = step_records(spark, sf_dir)
    place = F.regexp_extract("record", r"^#(\d+)", 1).cast("long")
    folder = F.when(F.floor(place / 10000000) % 8 <= 3, "a/").otherwise("b/")
    draw = F.pmod(F.xxhash64("model_id"), F.lit(30))
    suffix = F.when(draw % 5 == 0, ".ifczip").otherwise(".ifc")
    end = F.when((draw % 3 == 1) | ((draw % 3 == 2) & (place % 2 == 0)), ";\r\n").otherwise(";\n")
    comment = F.when(place % 97 == 0, F.lit("/* it's #1=IFCWALL(x); */ ")).otherwise("")
    body = rows.select(F.concat(folder, "model_id", suffix).alias("path"), place.alias("place"), F.concat(comment, "record", end).alias("record"))
    start = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCORGANIZATION($,'o',$,$,$);\n"
    bare = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 20 == 3).select(F.concat(F.lit("empty/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".ifc")).alias("path"))
    paths = body.select("path").distinct().unionByName(bare)
    heads = paths.select("path", F.lit(-1).cast("long").alias("place"), F.lit(start).alias("record"))
    tails = paths.select("path", F.lit(2**62).alias("place"), F.lit("ENDSEC;\nEND-ISO-10303-21;\n").alias("record"))
    return body.unionByName(heads).unionByName(tails)


# Sizes and place of the bodies written for line items; the texts are shared with the SQL.
BODY = {
    "dx": "CAST(l_quantity AS DOUBLE)",
    "dy": "CAST(p_size AS DOUBLE) * CAST(0.1 AS DOUBLE)",
    "dz": "CAST(l_tax AS DOUBLE) * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)",
    "cx": "CAST(l_extendedprice AS DOUBLE)",
    "cy": "CAST(p_retailprice AS DOUBLE)",
    "cz": "CAST(l_discount AS DOUBLE) * CAST(100 AS DOUBLE)",
}
# A file has one instance of a number; the quantity tells apart line items that share the others. 64 numbers belong to an element.
BODY_NUMBER = "(entity_id * 64 + CAST(l_quantity AS BIGINT)) * 64"
CUBE = "((0.,0.,0.),(1.,0.,0.),(1.,1.,0.),(0.,1.,0.),(0.,0.,1.),(1.,0.,1.),(1.,1.,1.),(0.,1.,1.),(9000.,9000.,9000.))"


def body_file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements with bodies as the text of one file per model: (path, place, record).

    An element stands on its own placement, that of its storey (one per line number, every second one turned) and that of the site. By
    line number a body is a faceted solid, a triangulated face set, an extruded rectangle, an extruded outline, a mapped polygonal face
    set with a scale, a polygonal face set whose list has a point that no face uses, or missing. Models are in millimetres, metres or feet.
    """
    rows = base_rows(spark, sf_dir).select(
        *[F.expr(BASE[n]).alias(n) for n in ("model_id", "entity_id", "global_id", "ifc_type")],
        F.col("l_linenumber").cast("int").alias("line"), "l_quantity", *[F.expr(sql).alias(name) for name, sql in BODY.items()],
    )
    # The rows are few bytes, but become much text, so they are dealt to as many tasks as there are partitions.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = F.expr(BODY_NUMBER)

    def number(k: int):
        return (base + k).cast("string")

    def text(template: str):
        """``{k}`` is a reference to the element's own instance k, ``<name>`` the number of a column."""
        parts = []
        for piece in re.split(r"(\{\d+\}|<[^>]+>)", template):
            if piece.startswith("{"):
                parts.append(F.concat(F.lit("#"), number(int(piece[1:-1]))))
            elif piece.startswith("<"):
                parts.append(F.expr(piece[1:-1]).cast("string"))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    box = "(" + ",".join(f"({x},{y},{z})" for z in ("0.", "<dz>") for x, y in (("0.", "0."), ("<dx>", "0."), ("<dx>", "<dy>"), ("0.", "<dy>"))) + ",(9000.,9000.,9000.))"
    faces = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    solid = ["{7}=IFCFACETEDBREP({8})", "{8}=IFCCLOSEDSHELL(({9},{10},{11},{12}))"]
    for i, corners in enumerate(faces):
        loop = ",".join(f"{{{21 + c}}}" for c in corners)
        solid += [f"{{{9 + i}}}=IFCFACE(({{{13 + i}}}))", f"{{{13 + i}}}=IFCFACEOUTERBOUND({{{17 + i}}},.T.)", f"{{{17 + i}}}=IFCPOLYLOOP(({loop}))"]
    solid += [f"{{{21 + i}}}=IFCCARTESIANPOINT(({p}))" for i, p in enumerate(("0.,0.,0.", "<dx>,0.,0.", "0.,<dy>,0.", "0.,0.,<dz>"))]
    up = "{10}=IFCDIRECTION((0.,0.,1.))"
    bodies = {
        1: solid,
        2: ["{7}=IFCTRIANGULATEDFACESET({8},$,.T.,((1,2,3),(1,3,4),(5,6,7),(5,7,8)),$)", f"{{8}}=IFCCARTESIANPOINTLIST3D({box})"],
        3: [
            "{7}=IFCEXTRUDEDAREASOLID({8},{9},{10},<dz>)", "{8}=IFCRECTANGLEPROFILEDEF(.AREA.,$,{11},<dx>,<dy>)", "{9}=IFCAXIS2PLACEMENT3D({12},$,$)", up,
            "{11}=IFCAXIS2PLACEMENT2D({13},$)", "{12}=IFCCARTESIANPOINT((0.,0.,0.))", "{13}=IFCCARTESIANPOINT((0.,0.))",
        ],
        4: [
            "{7}=IFCEXTRUDEDAREASOLID({8},$,{10},<dz>)", "{8}=IFCARBITRARYCLOSEDPROFILEDEF(.AREA.,'outline #1',{9})", "{9}=IFCPOLYLINE(({11},{12},{13},{11}))", up,
            "{11}=IFCCARTESIANPOINT((0.,0.))", "{12}=IFCCARTESIANPOINT((<dx>,0.))", "{13}=IFCCARTESIANPOINT((0.,<dy>))",
        ],
        5: ["{7}=IFCMAPPEDITEM(#40,{8})", "{8}=IFCCARTESIANTRANSFORMATIONOPERATOR3D($,$,{9},<dx>,$)", "{9}=IFCCARTESIANPOINT((0.,0.,0.))"],
        6: ["{7}=IFCPOLYGONALFACESET({8},.T.,({9},{10}),$)", f"{{8}}=IFCCARTESIANPOINTLIST3D({box})", "{9}=IFCINDEXEDPOLYGONALFACE((1,2,3,4))", "{10}=IFCINDEXEDPOLYGONALFACE((5,6,7,8))"],
        7: [],
    }
    own = ["{1}=IFCLOCALPLACEMENT(#<100 + 4 * line>,{2})", "{2}=IFCAXIS2PLACEMENT3D({3},$,$)", "{3}=IFCCARTESIANPOINT((<cx>,<cy>,<cz>))"]
    shown = ["{5}=IFCPRODUCTDEFINITIONSHAPE($,$,({6}))", "{6}=IFCSHAPEREPRESENTATION($,'Body','any',({7}))"]
    records = None
    for line, body in bodies.items():
        product = "{0}=<upper(ifc_type)>('<global_id>',$,$,$,$,{1}," + ("{5})" if body else "$)")
        listed = F.array(*[text(t) for t in [product, *own, *(shown if body else []), *body]])
        records = F.when(F.col("line") == line, listed) if records is None else records.when(F.col("line") == line, listed)
    path = F.concat("model_id", F.lit(".ifc")).alias("path")
    elements_ = rows.select(path, base.alias("place"), F.explode(records).alias("record"))
    size = F.length("model_id")
    metres = F.array(F.lit("#6=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.)"))
    thousandth = F.array(F.lit("#6=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.)"))
    feet = F.array(F.lit("#6=IFCCONVERSIONBASEDUNIT($,.LENGTHUNIT.,'FOOT',#8)"), F.lit("#8=IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(0.3048),#9)"), F.lit("#9=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.)"))
    fixed = [
        "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''),'2;1');\nFILE_NAME('','',(''),(''),'','','');\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCLOCALPLACEMENT($,#2)",
        "#2=IFCAXIS2PLACEMENT3D(#3,$,$)", "#4=IFCDIRECTION((3.,4.,0.))", "#5=IFCUNITASSIGNMENT((#6,#7))", "#7=IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.)",
        "#40=IFCREPRESENTATIONMAP(#41,#42)", "#41=IFCAXIS2PLACEMENT3D(#43,$,$)", "#43=IFCCARTESIANPOINT((0.,0.,0.))", "#42=IFCSHAPEREPRESENTATION($,'Body','any',(#44))",
        "#44=IFCPOLYGONALFACESET(#45,$,(#46,#47),$)", f"#45=IFCCARTESIANPOINTLIST3D({CUBE})", "#46=IFCINDEXEDPOLYGONALFACE((1,2,3,4))", "#47=IFCINDEXEDPOLYGONALFACE((5,6,7,8))",
    ]
    for line in range(1, 8):
        turned = "#4" if line % 2 == 0 else "$"
        at = 100 + 4 * line
        fixed += [f"#{at}=IFCLOCALPLACEMENT(#1,#{at + 1})", f"#{at + 1}=IFCAXIS2PLACEMENT3D(#{at + 2},$,{turned})", f"#{at + 2}=IFCCARTESIANPOINT((0.,0.,{3.0 * line}))"]
    site = F.concat(F.lit("#3=IFCCARTESIANPOINT(("), (size * 100.0).cast("string"), F.lit(",0.,0.))"))
    unit = F.when(size % 3 == 0, thousandth).when(size % 3 == 1, metres).otherwise(feet)
    head = F.concat(F.array(*[F.lit(t) for t in fixed]), F.array(site), unit)
    models = rows.select("model_id").distinct()
    heads = models.select(path, F.posexplode(head).alias("at", "record")).select("path", (F.col("at") - 1000).cast("long").alias("place"), "record")
    tails = models.select(path, F.lit(2**62).alias("place"), F.lit("ENDSEC;\nEND-ISO-10303-21").alias("record"))
    whole = elements_.unionByName(heads).unionByName(tails)
    return whole.withColumn("record", F.concat("record", F.lit(";\n")))
