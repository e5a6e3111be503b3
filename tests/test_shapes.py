"""Shapes of the user's own: from corners, from a table, as columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyweave import CUBE, SQUARE, AssemblySystem, BlockLibrary, box, polyenum, polygen, polygon_of, shapes_from_table
from polyweave.blocks import CUBE_SITES, UNIT_SHAPES, block_symmetries, box_of, graph_symmetries, qmul
from polyweave.functions.shapes import corners_column
from polyweave.functions import rotation as rot

RECTANGLE = [(0, 0), (0, 2), (3, 2), (3, 0)]
TABLE = "shape string, corner int, x double, y double, z double, note string"
BOX = [("brick", i, float(i & 1) * 4, float(i >> 1 & 1), float(i >> 2) * 2, None) for i in range(8)]


@pytest.mark.parametrize("shape", UNIT_SHAPES, ids=lambda s: s.name)
def test_every_graph_symmetry_of_a_regular_block_is_a_rotation(shape):
    assert block_symmetries(shape) == graph_symmetries(shape.n_vertices, shape.edges)


@pytest.mark.parametrize("corners, order", [(RECTANGLE, 2), (RECTANGLE[::-1], 2), ([(0, 0), (0, 4), (4, 4), (4, 0)], 4),
                                            ([(0, 0), (1, 3), (5, 3), (4, 0)], 2), ([(0, 0), (3, 0), (1, 2)], 1)])
def test_rotation_group_of_polygons(spark, corners, order):
    shape = polygon_of(corners)
    assert len(block_symmetries(shape)) == order
    g = spark.range(1).select(corners_column(F.array(*[rot.point(F.lit(float(x)), F.lit(float(y))) for x, y in corners])).alias("g")).first()["g"]
    assert g["rotations"] == order and (g["r_min"], g["r_max"]) == pytest.approx((shape.r_min, shape.r_max))
    assert [(p.x, p.y, 0) for p in g["sites"]] == pytest.approx(np.array(shape.sites), abs=1e-9)
    for own, turn in ((shape.refs, g["refs"]), (shape.turns, g["turns"])):
        for q, t in zip(own, turn):  # a quaternion and its negative are one rotation
            assert abs(q[0] * np.cos(np.pi * t / 2) + q[3] * np.sin(np.pi * t / 2)) == pytest.approx(1)


def test_rotation_group_of_boxes():
    assert [len(block_symmetries(b)) for b in (box(1, 2, 3), box(1, 1, 3), box(2, 2, 2))] == [4, 8, 24]


def test_opposite_faces_of_a_box_join_by_its_own_half_turns():
    for i, s in enumerate(CUBE_SITES):
        for j, t in enumerate(CUBE_SITES):
            if abs(np.dot(s, t)) == 1:
                assert np.abs(qmul(CUBE.turns[i], CUBE.refs[j])).max() == pytest.approx(1)


@pytest.mark.parametrize("corners", [[(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 0), (0, 1), (1, 1)], [(0, 0), (0, 2), (1, 1), (2, 2), (2, 0)],
                                     [(0, 0), (0, 0), (1, 0), (1, 1)], [(0, 0), (1, 0), (float("nan"), 1)]])
def test_corners_that_are_no_convex_polygon(corners):
    with pytest.raises(ValueError):
        polygon_of(corners)


def test_corners_that_are_no_box():
    corners = [r[2:5] for r in BOX]
    assert box_of(corners).r_min == 0.5
    for wrong in (corners[:7], corners[:7] + corners[:1], [(x + y, y, z) for x, y, z in corners], [(x, y, 0.0) for x, y, _ in corners]):
        with pytest.raises(ValueError):
            box_of(wrong)


def test_shapes_from_a_parquet_table(spark, tmp_path):
    rows = BOX + [("tile", 10 * k, float(x), float(y), None, "n") for k, (x, y) in enumerate(RECTANGLE)]
    spark.createDataFrame(rows, TABLE).repartition(5).write.parquet(str(tmp_path / "shapes"))
    found = shapes_from_table(spark.read.parquet(str(tmp_path / "shapes")))
    assert list(found) == ["brick", "tile"] and found["tile"] == polygon_of(RECTANGLE, "tile") and found["brick"] == box(2, 0.5, 1, "brick")
    assert shapes_from_table(spark.createDataFrame([], TABLE)) == {}
    for wrong in ([*rows, rows[0]], [*rows, (None, 1, 0.0, 0.0, None, None)], [*rows, ("brick", 9, 1.0, 1.0, None, None)], [*rows, ("dot", 1, 1.0, None, None, None)]):
        with pytest.raises(ValueError):
            shapes_from_table(spark.createDataFrame(wrong, TABLE))


def sizes(structures):
    return [r["count"] for r in structures.groupBy("n").count().orderBy("n").collect()]


def test_rectangles_of_one_orientation_are_fixed_polyominoes(spark):
    """Only left to right and top to bottom: every block keeps its orientation, as do blocks of any other parallelogram."""
    bonds = [[1, 1, 1, 3], [1, 2, 1, 4]]
    for corners in (RECTANGLE, [(0, 0), (1, 3), (5, 3), (4, 0)]):
        system = AssemblySystem(spark, bonds, polygon_of(corners))
        assert sizes(polygen(system, max_size=4)) == [1, 2, 6, 19]
    assert polyenum(AssemblySystem(spark, bonds, polygon_of(RECTANGLE)), max_size=4).n_structures == 28


def test_a_square_from_its_corners_is_the_square(spark):
    bonds = [[1, 1, 1, 1], [1, 2, 2, 3], [2, 1, 2, 4]]
    mine = polygon_of([(0, 0), (0, 1), (1, 1), (1, 0)])
    assert sizes(polygen(AssemblySystem(spark, bonds, mine), max_size=4)) == sizes(polygen(AssemblySystem(spark, bonds, SQUARE), max_size=4))


def test_alike_faces_of_a_rectangle_are_told_apart_by_its_rotations(spark):
    """With one face label for all four sites a square block looks the same after a quarter turn, a rectangle does not."""
    tables = lambda shape: BlockLibrary.uniform(shape, 1, [1, 1, 1, 1]).label_classes()
    assert tables(SQUARE) == [1, 1, 1, 1] and tables(polygon_of(RECTANGLE)) == [1, 2, 1, 2]


def test_parts_are_dealt_over_all_cores(spark):
    from polyweave.suite.shapes import slanted_parts
    assert slanted_parts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
