"""User-defined shapes read from a table of corners.

One row per corner: ``shape`` (name), ``corner`` (its place in the order around a polygon), ``x``, ``y`` and, for boxes,
``z``.  A shape whose ``z`` are all null is a convex polygon, one with eight corners in space an axis-aligned box.  Sites,
rotations, radii and the template graph follow from the corners, the rotation group from all of these
(:func:`~polyweave.blocks.block_symmetries`).  Such a table defines blocks; more corners than ``MAX_CORNERS`` are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..blocks import MAX_LABELS, Shape, box_of, polygon_of

MAX_CORNERS = 4 * MAX_LABELS


def shapes_from_table(corners: DataFrame) -> dict[str, Shape]:
    """Shapes by name, in the order of their names; other columns of the table are not read.

    Raises ValueError for null names, repeated or null corner numbers, missing coordinates, corners some of which have
    a ``z``, and corners that are not those of a convex polygon or a box.  An empty table has no shapes.
    """
    z = F.col("z").cast("double") if "z" in corners.columns else F.lit(None).cast("double")
    rows = corners.select(F.col("shape").cast("string").alias("shape"), F.col("corner").cast("long").alias("corner"),
                          *[F.col(c).cast("double").alias(c) for c in "xy"], z.alias("z"))
    given = rows.limit(MAX_CORNERS + 1).collect()
    if len(given) > MAX_CORNERS:
        raise ValueError(f"more than {MAX_CORNERS} corners, which no library of blocks can hold")
    by_name: dict = {}
    for r in given:
        if r["shape"] is None or r["corner"] is None or r["x"] is None or r["y"] is None:
            raise ValueError("shape, corner, x and y of every row are needed")
        if r["corner"] in by_name.setdefault(r["shape"], {}):
            raise ValueError(f"shape {r['shape']} has two corners {r['corner']}")
        by_name[r["shape"]][r["corner"]] = (r["x"], r["y"], r["z"])
    out = {}
    for name, points in sorted(by_name.items()):
        points = [points[k] for k in sorted(points)]
        flat = {p[2] is None for p in points}
        if len(flat) > 1:
            raise ValueError(f"only some corners of shape {name} have a z")
        out[name] = polygon_of(points, name) if flat.pop() else box_of(points, name)
    return out
