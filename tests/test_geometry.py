from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyweave import CUBE, HEXAGON, PENTAGON, SQUARE, TRIANGLE, BlockLibrary, polygon, polyhedron
from polyweave.blocks import UNIT_SHAPES, graph_symmetries, qrot
from polyweave.functions import contact, rotation as rot
from polyweave.functions.shapes import cube_column, polygon_column

R3 = sqrt(3.0)
# offset of a triangle glued by site j to site i, and the added rotation in half-turns
OFFSETS = [(1, 1, 0, -1 / R3, 1), (1, 2, 0, -1 / R3, 1 + 2 / 3), (1, 3, 0, -1 / R3, 1 - 2 / 3),
           (2, 2, -0.5, 0.5 / R3, 1), (2, 3, -0.5, 0.5 / R3, 1 + 2 / 3), (2, 1, -0.5, 0.5 / R3, 1 - 2 / 3),
           (3, 3, 0.5, 0.5 / R3, 1), (3, 1, 0.5, 0.5 / R3, 1 + 2 / 3), (3, 2, 0.5, 0.5 / R3, 1 - 2 / 3)]


@pytest.fixture(scope="module")
def cases(spark):
    rows = spark.createDataFrame([(i, j, *map(float, v)) for i, j, *v in OFFSETS], "i int, j int, dx double, dy double, turn double")
    return rows.withColumn("g", polygon_column(F.lit(3), F.lit(1.0)))


def test_attachment_offsets(cases):
    at = lambda f, k: F.element_at(F.col(f"g.{f}"), F.col(k))
    dx, turn = contact.attachment(at("sites", "i"), at("turns", "i"), at("sites", "j"), at("refs", "j"), 2)
    for r in cases.select("dx", "dy", "turn", dx.alias("p"), turn.alias("t")).collect():
        assert (r.p.x, r.p.y, r.t) == pytest.approx((r.dx, r.dy, r.turn))


def test_face_pairs_invert_offsets(cases):
    hits = contact.face_pairs(rot.point(F.col("dx"), F.col("dy")), F.lit(0.0), F.col("turn"),
                              F.col("g.sites"), F.col("g.sites"), 2)
    for r in cases.select("i", "j", hits.alias("h")).collect():
        assert [(p.i, p.j) for p in r.h] == [(r.i, r.j)]


@pytest.mark.parametrize("shape", UNIT_SHAPES, ids=lambda s: s.name)
def test_reference_rotation_maps_sites_to_the_first(shape):
    turned = [qrot(x, q) for x, q in zip(shape.sites, shape.refs)]
    assert np.allclose(turned, shape.sites[0])
    assert len(graph_symmetries(shape.n_vertices, shape.edges)) == (24 if shape.dim == 3 else shape.n_sites)


def test_radii():
    expected = {3: (0.2887, 0.5774), 4: (0.5, 0.7071), 5: (0.6882, 0.8507), 6: (0.8660, 1.0)}
    for n, (low, high) in expected.items():
        assert (polygon(n).r_min, polygon(n).r_max) == pytest.approx((low, high), abs=1e-4)
    assert (CUBE.r_min, CUBE.r_max) == pytest.approx((1, R3))
    with pytest.raises(ValueError):
        polyhedron("octahedron")


def test_shape_columns_agree_with_shapes(spark):
    row = spark.range(1).select(polygon_column(F.lit(5), F.lit(2.0)).alias("p"), cube_column(F.lit(1.5)).alias("c")).first()
    five = polygon(5, 2.0)
    assert np.allclose([(s.x, s.y) for s in row.p.sites], np.array(five.sites)[:, :2])
    assert np.allclose([(s.x, s.y) for s in row.p.corners], np.array(five.corners)[:, :2])
    assert row.p.r_max == pytest.approx(five.r_max) and row.c.r_max == pytest.approx(1.5 * R3)
    assert np.allclose([(s.x, s.y, s.z) for s in row.c.sites], 1.5 * np.array(CUBE.sites))


def test_quaternions(spark):
    p, q = rot.quat(1, 2, 3, 4), rot.quat(0.5, -1, 2, 0.25)
    row = spark.range(1).select(
        rot.quat_mul(p, q).alias("m"), rot.quat_norm(p).alias("n"), rot.quat_div(p, 2).alias("d"),
        rot.quat_eq(p, rot.quat(-1, -2, -3, -4)).alias("e"), rot.quat_approx(p, p).alias("a"),
        rot.rotate3(rot.point(F.lit(1), F.lit(0), F.lit(0)), rot.quat_normalized(rot.quat(1, 0, 0, 1))).alias("r")).first()
    assert tuple(row.m) == pytest.approx((-4.5, -7.25, -1.0, 9.25))
    assert row.n == pytest.approx(sqrt(30)) and tuple(row.d) == (0.5, 1, 1.5, 2)
    assert not row.e and row.a and tuple(row.r) == pytest.approx((0, 1, 0))


def test_grab_in_space(spark):
    xs = F.array(rot.point(0.0, 0.0, 0.0), rot.point(1.0, 2.0, 3.0))
    quarter = rot.quat(sqrt(0.5), 0, 0, sqrt(0.5))
    nx, nq = rot.grab(xs, F.array(rot.quat(1, 0, 0, 0), quarter), 2, 3)
    row = spark.range(1).select(nx.alias("x"), nq.alias("q")).first()
    assert tuple(row.x[1]) == pytest.approx((0, 0, 0)) and tuple(row.q[1]) == pytest.approx((1, 0, 0, 0))
    assert tuple(row.x[0]) == pytest.approx((-2, 1, -3))


def test_library_checks():
    with pytest.raises(ValueError):
        BlockLibrary([TRIANGLE, CUBE])
    with pytest.raises(ValueError):
        BlockLibrary([SQUARE], [1, 1, 1])
    mixed = BlockLibrary([TRIANGLE, SQUARE, PENTAGON, HEXAGON])
    assert mixed.offsets == [0, 3, 7, 12] and mixed.n_labels == 18 and mixed.distinct_sites
    assert not BlockLibrary([CUBE], [1] * 24).distinct_sites
