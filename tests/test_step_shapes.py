"""Bodies from STEP text against frames composed by numpy."""

import numpy as np
import pytest

from buildscope.operators.geometry import attach_features
from buildscope.plans.pipeline import analyse_directory
from buildscope.sources import step, step_shapes, tables

CORNERS = np.array([[0, 0, 0], [2, 0, 0], [0, 3, 0], [0, 0, 4.0]])
FACES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]


class Model:
    """Writes instances and remembers where they are."""

    def __init__(self, name):
        self.name, self.lines, self.at = name, [], 0

    def add(self, text):
        self.at += 1
        self.lines.append(f"#{self.at}={text}")
        return f"#{self.at}"

    def triple(self, kind, v):
        return "$" if v is None else self.add(f"{kind}(({','.join(repr(float(x)) for x in v)}))")

    def frame(self, o, z=None, x=None):
        return self.add(f"IFCAXIS2PLACEMENT3D({self.triple('IFCCARTESIANPOINT', o)},{self.triple('IFCDIRECTION', z)},{self.triple('IFCDIRECTION', x)})")

    def placement(self, parent, *frame):
        return self.add(f"IFCLOCALPLACEMENT({parent},{self.frame(*frame)})")

    def product(self, name, placement, *items, identifier="Body"):
        if not items:
            return self.add(f"IFCWALL('{name}',$,'a (b), #7',$,$,{placement},$,$,.X.)")
        body = self.add(f"IFCSHAPEREPRESENTATION($,'{identifier}','any',({','.join(items)}))")
        shape = self.add(f"IFCPRODUCTDEFINITIONSHAPE($,'it''s #1',({body}))")
        return self.add(f"IFCWALL('{name}',$,'a (b), #7',$,$,{placement},{shape},$,.X.)")

    def solid(self, corners):
        points = [self.triple("IFCCARTESIANPOINT", c) for c in corners]
        faces = []
        for face in FACES:
            loop = self.add(f"IFCPOLYLOOP(({','.join(points[i] for i in face)}))")
            faces.append(self.add(f"IFCFACE(({self.add(f'IFCFACEOUTERBOUND({loop},.T.)')}))"))
        return self.add(f"IFCFACETEDBREP({self.add(f'IFCCLOSEDSHELL(({chr(44).join(faces)}))')})")

    def points(self, corners):
        return self.add("IFCCARTESIANPOINTLIST3D((" + ",".join("(" + ",".join(repr(float(x)) for x in c) + ")" for c in corners) + "))")

    def rows(self):
        return [(self.name, line) for line in self.lines]


def matrix(o, z=None, x=None):
    z = np.array([0, 0, 1.0] if z is None else z, float)
    z /= np.linalg.norm(z)
    x = np.array(([0, 1.0, 0] if np.allclose(z, [1, 0, 0]) else [1.0, 0, 0]) if x is None else x, float)
    x = x - (x @ z) * z
    x /= np.linalg.norm(x)
    out = np.eye(4)
    out[:3, 0], out[:3, 1], out[:3, 2], out[:3, 3] = x, np.cross(z, x), z, o
    return out


def box(frame, corners, scale=1.0):
    world = (frame @ np.c_[np.array(corners, float), np.ones(len(corners))].T).T[:, :3] * scale
    return [*world.min(axis=0), *world.max(axis=0)]


def build():
    """Two models, and the box that each product must have; None: no geometry."""
    m, want = Model("m"), {}
    chain = [((1, 2, 3), (0, 1, 1), (1, 0.2, 0)), ((4, 0, -1), (1, 0, 0)), ((0, 5, 0), None, (3, 4, 0))]
    above, world = "$", np.eye(4)
    for frame in chain:
        above, world = m.placement(above, *frame), world @ matrix(*frame)
    m.product("solid", above, m.solid(CORNERS))
    want["solid"] = box(world, CORNERS)
    far = np.vstack([CORNERS, [[900, 900, 900]]])
    listed = m.points(far)
    normals = "((0.,0.,1.),(1.,0.,0.))"
    m.product("triangles", above, m.add(f"IFCTRIANGULATEDFACESET({listed},{normals},.T.,((1,2,3),(1,2,4)),$)"))
    want["triangles"] = box(world, CORNERS)
    m.product("through", "$", m.add(f"IFCTRIANGULATEDFACESET({listed},$,$,((1,2,3)),(4,1,2,5))"))
    want["through"] = box(np.eye(4), CORNERS[[3, 0, 1]])
    faces = [m.add("IFCINDEXEDPOLYGONALFACE((1,2,3))"), m.add("IFCINDEXEDPOLYGONALFACEWITHVOIDS((1,2,4),((1,3,4)))")]
    polygons = m.add(f"IFCPOLYGONALFACESET({listed},.T.,({','.join(faces)}),$)")
    m.product("polygons", above, polygons)
    want["polygons"] = box(world, CORNERS)
    # A source within a source, mirrored and unevenly scaled.
    inner = m.add(f"IFCSHAPEREPRESENTATION($,'Body','any',({polygons}))")
    first = m.add(f"IFCREPRESENTATIONMAP({m.frame((1, 1, 1), (0, 1, 0))},{inner})")
    o, yes = m.triple("IFCCARTESIANPOINT", (7, 8, 9)), m.triple("IFCDIRECTION", (0, -1, 0))
    mirror = m.add(f"IFCCARTESIANTRANSFORMATIONOPERATOR3D($,{yes},{o},2.,$)")
    outer = m.add(f"IFCSHAPEREPRESENTATION($,'Body','any',({m.add(f'IFCMAPPEDITEM({first},{mirror})')}))")
    second = m.add(f"IFCREPRESENTATIONMAP({m.frame((0, 0, 0))},{outer})")
    uneven = m.add(f"IFCCARTESIANTRANSFORMATIONOPERATOR3DNONUNIFORM($,$,{o},1.,$,3.,$)")
    m.product("mapped", above, m.add(f"IFCMAPPEDITEM({second},{uneven})"))
    to_first, to_second = np.diag([2.0, -2, 2, 1]), np.diag([1.0, 3, 1, 1])
    to_first[:3, 3] = to_second[:3, 3] = (7, 8, 9)
    want["mapped"] = box(world @ to_second @ to_first @ matrix((1, 1, 1), (0, 1, 0)), CORNERS)
    up = m.triple("IFCDIRECTION", (0, 1, 1))
    flat = m.add(f"IFCAXIS2PLACEMENT2D({m.triple('IFCCARTESIANPOINT', (5, 6))},{m.triple('IFCDIRECTION', (0, 1))})")
    rectangle = m.add(f"IFCRECTANGLEPROFILEDEF(.AREA.,$,{flat},4.,2.)")
    m.product("rectangle", above, m.add(f"IFCEXTRUDEDAREASOLID({rectangle},{m.frame((1, 0, 0), (0, 0, -1))},{up},10.)"))
    ends = [np.array([5 - v, 6 + u, 0]) + t * np.array([0, 1, 1]) / np.sqrt(2) for u in (-2, 2) for v in (-1, 1) for t in (0, 10)]
    want["rectangle"] = box(world @ matrix((1, 0, 0), (0, 0, -1)), ends)
    line = m.add(f"IFCPOLYLINE(({','.join(m.triple('IFCCARTESIANPOINT', p) for p in ((0, 0), (3, 1), (2, 5), (0, 0)))}))")
    outline = m.add(f"IFCARBITRARYCLOSEDPROFILEDEF(.AREA.,$,{line})")
    m.product("outline", "$", m.add(f"IFCEXTRUDEDAREASOLID({outline},$,{up},1.)"))
    want["outline"] = box(np.eye(4), [np.array([x, y, 0]) + t * np.array([0, 1, 1]) / np.sqrt(2) for x, y in ((0, 0), (3, 1), (2, 5)) for t in (0, 1)])
    deep = "$"
    for _ in range(41):
        deep = m.placement(deep, (1, 0, 0))
    m.product("deep", deep, m.solid(CORNERS))
    want["deep"] = box(matrix((41, 0, 0)), CORNERS)
    m.product("two items", "$", m.solid(CORNERS), m.add("IFCSPHERE($,1.)"), m.solid(CORNERS + 5))
    want["two items"] = box(np.eye(4), np.vstack([CORNERS, CORNERS + 5]))
    m.product("none", above)
    m.product("axis", above, polygons, identifier="Axis")
    m.product("sphere", above, m.add("IFCSPHERE($,1.)"))
    m.product("nothing", above, "#999999")
    m.product("lost", "#999998", polygons)
    m.product("no direction", m.placement("$", (0, 0, 0), (0, 0, 0)), polygons)
    m.product("parallel", m.placement("$", (0, 0, 0), (0, 0, 1), (0, 0, 2)), polygons)
    m.product("ragged", "$", m.add(f"IFCTRIANGULATEDFACESET({m.add('IFCCARTESIANPOINTLIST3D(((1.,2.),(3.,4.)))')},$,$,((1,2,3)),$)"))
    a, b = m.at + 1, m.at + 2
    m.at += 2
    at = m.frame((0, 0, 0))
    m.lines += [f"#{a}=IFCLOCALPLACEMENT(#{b},{at})", f"#{b}=IFCLOCALPLACEMENT(#{a},{at})"]
    m.product("cycle", f"#{a}", polygons)
    feet = Model("feet")
    feet.add("IFCUNITASSIGNMENT((#3,#2))")
    feet.add("IFCCONVERSIONBASEDUNIT(#9,.LENGTHUNIT.,'FOOT',#4)")
    feet.add("IFCSIUNIT(*,.AREAUNIT.,$,.SQUARE_METRE.)")
    feet.add("IFCMEASUREWITHUNIT(IFCLENGTHMEASURE(304.8),#5)")
    feet.add("IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.)")
    feet.product("feet", feet.placement("$", (10, 0, 0)), feet.solid(CORNERS))
    want["feet"] = box(matrix((10, 0, 0)), CORNERS, 0.3048)
    return m, feet, want


@pytest.fixture(scope="module")
def found(spark):
    m, feet, want = build()
    records = spark.createDataFrame(m.rows() + feet.rows(), "model_id string, record string").repartition(3)
    entities = step.parse_entities(records)
    boxes, unread = step_shapes.read_shapes(entities)
    return entities, boxes, unread, want


def test_boxes(found):
    _, boxes, _, want = found
    got = {r.global_id: [r[c] for c in step_shapes.BOX] for r in boxes.collect()}
    assert sorted(got) == sorted(want)
    for name, expected in want.items():
        assert got[name] == pytest.approx(expected, abs=1e-9), name


def test_unread_items(found):
    counts = {(r.model_id, r.entity_type): r["items"] for r in found[2].collect()}
    assert counts == {("m", "IFCSPHERE"): 2, ("m", None): 1, ("m", "IFCTRIANGULATEDFACESET"): 1}


def test_elements_with_boxes(found):
    entities, boxes, _, want = found
    rows = attach_features(step.extract_elements(entities), boxes).collect()
    assert {r.global_id for r in rows if r.has_geometry} == set(want) and len(rows) == len(want) + 9
    assert all((r.dim_x is not None) == r.has_geometry for r in rows)


def test_workflow_and_models_without_bodies(spark, tmp_path):
    m = Model("one")
    m.product("a", m.placement("$", (1, 1, 1)), m.solid(CORNERS))
    m.product("b", "$")
    head = "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.ifc").write_text(head + ";\n".join(m.lines) + ";\nENDSEC;\nEND-ISO-10303-21;\n")
    (tmp_path / "in" / "bare.ifc").write_text(head + "#1=IFCDOOR('d',$,$,$,$,$,$,$,$,$,$,$);\nENDSEC;\nEND-ISO-10303-21;\n")
    analyse_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    features = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert sorted((r.global_id, r.has_geometry, r.bbox_volume) for r in features.collect()) == [("a", True, 24.0), ("b", False, None), ("d", False, None)]
    assert spark.read.parquet(str(tmp_path / "out" / "unread_items")).count() == 0
    results, _ = tables.load_portfolio_data(spark, str(tmp_path / "out"))
    assert results.count() == 2
