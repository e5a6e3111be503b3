"""Block shapes as struct columns, for shapes whose parameters are data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..blocks import CUBE, CUBE_SITES, SAME_LENGTH
from .rotation import angle, let, point, quat


def polygon_column(n: Column, side: Column) -> Column:
    """Regular polygon: ``struct<sites, refs, turns, corners, r_min, r_max>``, angles in half-turns."""
    r_in = side / (2 * F.tan(F.pi() / n))
    r_out = side / (2 * F.sin(F.pi() / n))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(2.0) * i / n)

    def at(r, half_turns):
        return point(r * F.cos(F.pi() * half_turns), r * F.sin(F.pi() * half_turns))
    return F.struct(
        F.transform(steps, lambda s: at(r_in, -s - 0.5)).alias("sites"),
        F.transform(steps, lambda s: angle(s)).alias("refs"),
        F.transform(steps, lambda s: angle(1 - s)).alias("turns"),
        F.transform(steps, lambda s: at(r_out, s + F.lit(1.0) / n)).alias("corners"),
        r_in.alias("r_min"), r_out.alias("r_max"))


def corners_column(corners: Column) -> Column:
    """Convex polygon given by an array of corners, in either sense of rotation: the struct of :func:`polygon_column`
    with ``rotations``, the number of turns that leave the polygon as it is.

    The centroid becomes the centre, site i is the middle of the edge from corner i to the next.  Null for a null array
    and for corners without area.
    """
    every = lambda c: F.sequence(F.lit(0), F.size(c) - 1)
    at = lambda c, i: F.element_at(c, F.pmod(i, F.size(c)) + 1)
    norm = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])

    def edges(c):
        def edge(i):
            a, b = at(c, i), at(c, i + 1)
            cross = a["x"] * b["y"] - b["x"] * a["y"]
            return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), cross.alias("cross"),
                            (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
        return F.transform(every(c), edge)

    def moments(e):
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("area", "x", "y")])
        return F.aggregate(e, zero, lambda m, s: F.struct((m["area"] + s["cross"]).alias("area"),
                           (m["x"] + s["x"] * s["cross"]).alias("x"), (m["y"] + s["y"] * s["cross"]).alias("y")))

    def centred(v):
        m = v["m"]
        cx, cy, sense = m["x"] * 2 / (3 * m["area"]), m["y"] * 2 / (3 * m["area"]), F.signum(m["area"])
        return F.struct(
            F.transform(v["e"], lambda s: F.struct(
                (s["x"] - cx).alias("x"), (s["y"] - cy).alias("y"), F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"]).alias("length"),
                (F.atan2(s["dy"], s["dx"]) / F.pi() - sense / 2).alias("outer"))).alias("e"),
            F.transform(v["c"], lambda p: point(p["x"] - cx, p["y"] - cy)).alias("c"))

    def shape(v):
        e, c = v["e"], v["c"]
        same = lambda a, b: F.abs(a - b) <= SAME_LENGTH * F.greatest(a, b)
        fits = lambda k: F.forall(every(c), lambda i: same(norm(at(c, i)), norm(at(c, i + k))) & same(at(e, i)["length"], at(e, i + k)["length"]))
        inner = lambda s: s["x"] * F.cos(F.pi() * s["outer"]) + s["y"] * F.sin(F.pi() * s["outer"])
        return F.struct(
            F.transform(e, lambda s: point(s["x"], s["y"])).alias("sites"),
            F.transform(e, lambda s: angle(-0.5 - s["outer"])).alias("refs"),
            F.transform(e, lambda s: angle(s["outer"] + 1.5)).alias("turns"),
            c.alias("corners"), F.array_min(F.transform(e, inner)).alias("r_min"), F.array_max(F.transform(c, norm)).alias("r_max"),
            F.size(F.filter(every(c), fits)).alias("rotations"))

    whole = let(corners, lambda c: let(edges(c), lambda e: let(
        F.struct(c.alias("c"), e.alias("e"), moments(e).alias("m")),
        lambda v: F.when(v["m"]["area"] != 0, let(centred(v), shape)))))
    return F.when(F.size(corners) >= 3, whole)


def cube_column(half_edge: Column) -> Column:
    """Cube of edge ``2 * half_edge``: the same struct with 3D points and quaternions."""
    scaled = lambda ps: F.array(*[point(*[half_edge * float(c) for c in p]) for p in ps])
    quats = lambda qs: F.array(*[quat(*q) for q in qs])
    return F.struct(
        scaled(CUBE_SITES).alias("sites"), quats(CUBE.refs).alias("refs"), quats(CUBE.turns).alias("turns"),
        scaled(CUBE.corners).alias("corners"), half_edge.cast("double").alias("r_min"),
        (half_edge * F.sqrt(F.lit(3.0))).alias("r_max"))
