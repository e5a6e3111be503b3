"""Blocks of the user's own shape: geometry per row, and structures of shapes read from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..blocks import BlockLibrary
from ..functions import rotation as rot
from ..functions.shapes import corners_column
from ..oracle import boxes, source
from ..plans.enumerate import counts_by_size, polyenum, polygen
from ..sources import tables
from ..sources.shapes import shapes_from_table
from ..sources.systems import SystemCatalog
from .geometry import sql_tidy, tidy
from .structures import COUNTS, SEARCHED

#: a parallelogram per part, every other one with its corners listed anticlockwise
SLANTED = {"w": "CAST(p_size % 3 + 1 AS DOUBLE)", "h": "CAST(p_partkey % 4 + 1 AS DOUBLE)",
           "k": "CAST(CAST(floor(p_retailprice) AS BIGINT) % 2 AS DOUBLE)", "back": "p_size % 2 = 0"}


def slanted_parts(spark, folder):
    """Sites, rotations, radii and rotation group of one parallelogram per part."""
    df = tables.widen(tables.read(spark, folder, "part")).selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in SLANTED.items()])
    w, h, k, zero = F.col("w"), F.col("h"), F.col("k"), F.lit(0.0)
    first, left, top, right = rot.point(zero, zero), rot.point(k, 2 * h), rot.point(2 * w + k, 2 * h), rot.point(2 * w, zero)
    corners = F.when(F.col("back"), F.array(first, right, top, left)).otherwise(F.array(first, left, top, right))
    df = df.select("p_partkey", corners_column(corners).alias("g"))
    rows = df.select("p_partkey", "g.r_min", "g.r_max", "g.rotations", F.posexplode(F.arrays_zip("g.sites", "g.refs", "g.turns")).alias("pos", "s"))
    half = lambda c, f: tidy(f(F.col(c) * F.pi()))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("site"), tidy(F.col("s.sites.x")).alias("x"), tidy(F.col("s.sites.y")).alias("y"),
                       half("s.refs", F.cos).alias("ref_cos"), half("s.refs", F.sin).alias("ref_sin"), half("s.turns", F.cos).alias("turn_cos"),
                       half("s.turns", F.sin).alias("turn_sin"), tidy(F.col("r_min")).alias("r_min"), tidy(F.col("r_max")).alias("r_max"), "rotations")


# the outward normal (nx, ny) turned by the reference rotation is (0, -1); the turn puts a block's (0, -1) on its back
SLANTED_SQL = f"""SELECT p_partkey, site, {sql_tidy('x')} AS x, {sql_tidy('y')} AS y, {sql_tidy('-ny')} AS ref_cos, {sql_tidy('-nx')} AS ref_sin,
{sql_tidy('ny')} AS turn_cos, {sql_tidy('-nx')} AS turn_sin, {sql_tidy('least(h, 2 * w * h / l)')} AS r_min,
{sql_tidy('sqrt((w + k / 2) * (w + k / 2) + h * h)')} AS r_max, CASE WHEN k = 0 AND w = h THEN 4 ELSE 2 END AS rotations
FROM (SELECT *, [-w, k / 2, w, -k / 2][face] AS x, [0, h, 0, -h][face] AS y, [-2 * h, 0, 2 * h, 0][face] / [l, 1, l, 1][face] AS nx,
[k, 1, -k, -1][face] / [l, 1, l, 1][face] AS ny FROM (
SELECT *, sqrt(k * k + 4 * h * h) AS l, CASE WHEN back THEN 5 - site ELSE site END AS face FROM (
SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in SLANTED.items())} FROM part), range(1, 5) t(site)))"""


#: axis of each site: of a rectangle whose corners are listed from the left side on, of a box
RECTANGLE_AXES, BOX_AXES = [1, 2, 1, 2], [1, 3, 2, 3, 2, 1]


def part_shapes(spark, folder) -> dict:
    """A rectangle and a box with the average measures of all parts, by way of a table of their corners."""
    sides = tables.read(spark, folder, "part").agg((F.avg("p_size") / 25).alias("a"), (F.avg("p_retailprice") / 1000 + 2).alias("b"))
    flat = F.expr("array((0, 0), (0, 1), (1, 1), (1, 0))")
    solid = F.expr("array((0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1))")
    table = lambda name, corners, z: sides.select("a", "b", F.lit(name).alias("shape"), F.posexplode(corners).alias("corner", "p")).select(
        "shape", "corner", (F.col("a") * F.col("p.col1")).alias("x"), (F.col("b") * F.col("p.col2")).alias("y"), z.alias("z"))
    return shapes_from_table(table("rectangle", flat, F.lit(None).cast("double")).unionByName(
        table("box", solid, (F.col("a") + F.col("b")) * F.col("p.col3"))))


def axis_systems(spark, folder, shape: str, axes: list[int], name: str, bond: dict) -> SystemCatalog:
    """A bond row lets two species touch across the axis of ``site_i``; opposite faces are alike."""
    library = BlockLibrary.uniform(part_shapes(spark, folder)[shape], 2, axes)
    rows = tables.bonds(spark, folder, name, {k: bond[k] for k in ("sys", "species_i", "site_i", "species_j")})
    axis = F.element_at(F.array(*map(F.lit, axes)), F.col("site_i"))
    faces = F.filter(F.sequence(F.lit(1), F.lit(len(axes))), lambda s: F.element_at(F.array(*map(F.lit, axes)), s) == axis)
    rows = rows.withColumn("site_i", F.explode(faces))
    return SystemCatalog.from_bonds(library, rows.withColumn("site_j", F.col("site_i")))


def rectangles(spark, folder):
    return axis_systems(spark, folder, "rectangle", RECTANGLE_AXES, "conversations", tables.TALK_BOND)


def cuboids(spark, folder):
    return axis_systems(spark, folder, "box", BOX_AXES, "events", tables.DAY_BOND)


def polygen_rectangles(spark, folder):
    """Number of structures of rectangles of each size and system."""
    return counts_by_size(polygen(rectangles(spark, folder), max_size=4))


def polyenum_boxes(spark, folder):
    """Number of structures of boxes and their largest size for each system, by reverse search."""
    found = polyenum(cuboids(spark, folder), max_size=3).structures
    return found.groupBy("sys").agg(F.count(F.lit(1)).alias("n_strs"), F.max("n").alias("largest"))


QUERIES = {
    "slanted_parts": (slanted_parts, SLANTED_SQL),
    "polygen_rectangles": (polygen_rectangles, f"WITH RECURSIVE {boxes(source('talk'), RECTANGLE_AXES, 4)}\n{COUNTS}"),
    "polyenum_boxes": (polyenum_boxes, f"WITH RECURSIVE {boxes(source('day'), BOX_AXES, 3)}\n{SEARCHED}"),
}
