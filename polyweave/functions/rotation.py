"""Rotations, points and rigid motions as Spark column expressions.

2D rotations are plain DOUBLE columns in half-turns (1.0 is 180 degrees), kept in
``[0, 2)``.  3D rotations are ``struct<w,x,y,z>`` unit quaternions.  Points are
``struct<x,y>`` or ``struct<x,y,z>``.  Everything here is JVM-side: no UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: default relative tolerance of approximate equality, sqrt of the double epsilon
RTOL = 2.0 ** -26


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once per row, however often it is mentioned.

    Plain columns are inlined at every mention, which multiplies work inside lambdas.
    """
    return F.transform(F.array(value), use)[0]


def point(x, y, z=None) -> Column:
    parts = [_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y")]
    if z is not None:
        parts.append(_col(z).cast("double").alias("z"))
    return F.struct(*parts)


def approx(a: Column, b: Column, rtol: float = RTOL) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * rtol


# ---------------------------------------------------------------- planar angles

def angle(theta) -> Column:
    return F.pmod(_col(theta).cast("double"), F.lit(2.0))


def angle_mul(a: Column, b: Column) -> Column:
    return angle(a + b)


def angle_inv(a: Column) -> Column:
    return angle(-a)


def angle_eq(a: Column, b: Column) -> Column:
    return angle(a) == angle(b)


def angle_approx(a: Column, b: Column, rtol: float = RTOL) -> Column:
    """Compares the normalised values; does not wrap around 2."""
    return approx(angle(a), angle(b), rtol)


# ------------------------------------------------------------------ quaternions

def quat(w, x, y, z) -> Column:
    return F.struct(*[_col(v).cast("double").alias(n) for v, n in zip((w, x, y, z), "wxyz")])


def quat_mul(p: Column, q: Column) -> Column:
    """Hamilton product ``p * q``."""
    a, b, c, d = (p[k] for k in "wxyz")
    w, x, y, z = (q[k] for k in "wxyz")
    return quat(a * w - b * x - c * y - d * z,
                a * x + b * w + c * z - d * y,
                a * y + c * w + d * x - b * z,
                a * z + d * w + b * y - c * x)


def quat_inv(q: Column) -> Column:
    return quat(q["w"], -q["x"], -q["y"], -q["z"])


def quat_norm(q: Column) -> Column:
    return F.sqrt(sum((q[k] * q[k] for k in "xyz"), q["w"] * q["w"]))


def quat_scale(alpha, q: Column) -> Column:
    return quat(*[_col(alpha) * q[k] for k in "wxyz"])


def quat_div(q: Column, alpha) -> Column:
    return quat_scale(F.lit(1.0) / _col(alpha), q)


def quat_normalized(q: Column) -> Column:
    return quat_div(q, quat_norm(q))


def quat_eq(p: Column, q: Column) -> Column:
    """Component-wise: a quaternion and its negative are different values."""
    return (p["w"] == q["w"]) & (p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["z"] == q["z"])


def quat_approx(p: Column, q: Column, rtol: float = RTOL) -> Column:
    out = approx(p["w"], q["w"], rtol)
    for k in "xyz":
        out = out & approx(p[k], q[k], rtol)
    return out


# --------------------------------------------------------------- acting on points

def rotate2(p: Column, theta: Column) -> Column:
    c, s = F.cos(theta * F.pi()), F.sin(theta * F.pi())
    return point(c * p["x"] - s * p["y"], s * p["x"] + c * p["y"])


def rotate3(p: Column, q: Column) -> Column:
    """Rotate a 3D point with two cross products (same value as q p q^-1 for unit q)."""
    tx = 2 * (q["y"] * p["z"] - q["z"] * p["y"])
    ty = 2 * (q["z"] * p["x"] - q["x"] * p["z"])
    tz = 2 * (q["x"] * p["y"] - q["y"] * p["x"])
    return point(p["x"] + q["w"] * tx + q["y"] * tz - q["z"] * ty,
                 p["y"] + q["w"] * ty + q["z"] * tx - q["x"] * tz,
                 p["z"] + q["w"] * tz + q["x"] * ty - q["y"] * tx)


class Plane:
    """2D rigid motions."""

    axes = "xy"
    identity = staticmethod(lambda: F.lit(0.0))
    rotate = staticmethod(rotate2)
    mul = staticmethod(angle_mul)
    inv = staticmethod(angle_inv)


class Space:
    """3D rigid motions."""

    axes = "xyz"
    identity = staticmethod(lambda: quat(1.0, 0.0, 0.0, 0.0))
    rotate = staticmethod(rotate3)
    mul = staticmethod(quat_mul)
    inv = staticmethod(quat_inv)


def motions(dim: int):
    return {2: Plane, 3: Space}[dim]


def add_points(p: Column, q: Column, axes: str) -> Column:
    return point(*[p[k] + q[k] for k in axes])


def sub_points(p: Column, q: Column, axes: str) -> Column:
    return point(*[p[k] - q[k] for k in axes])


def rotate_points(xs: Column, rot: Column, dim: int) -> Column:
    if dim == 3:
        return let(rot, lambda q: F.transform(xs, lambda p: rotate3(p, q)))
    unit = F.struct(F.cos(rot * F.pi()).alias("c"), F.sin(rot * F.pi()).alias("s"))
    return let(unit, lambda u: F.transform(xs, lambda p: point(u["c"] * p["x"] - u["s"] * p["y"],
                                                               u["s"] * p["x"] + u["c"] * p["y"])))


def rotate_rotations(psis: Column, rot: Column, dim: int) -> Column:
    """Pre-multiply every rotation of an array."""
    return F.transform(psis, lambda q: motions(dim).mul(rot, q))


def shift_points(xs: Column, delta: Column, dim: int) -> Column:
    return F.transform(xs, lambda p: add_points(p, delta, motions(dim).axes))


def grab(xs: Column, psis: Column, i, dim: int, to: Column | None = None, rot: Column | None = None):
    """Move a rigid group so that member ``i`` (1-based) sits at ``to`` with rotation ``rot``.

    Without ``to`` / ``rot`` the member ends at the origin / in reference orientation.
    Returns the pair of new array columns.
    """
    m = motions(dim)
    anchor, turn = F.element_at(xs, _col(i)), m.inv(F.element_at(psis, _col(i)))
    if rot is not None:
        turn = m.mul(rot, turn)

    def move(p):
        out = m.rotate(sub_points(p, anchor, m.axes), turn)
        return out if to is None else add_points(out, to, m.axes)

    return F.transform(xs, move), rotate_rotations(psis, turn, dim)


def cart2pol(x: Column, y: Column) -> Column:
    return F.struct(F.sqrt(x * x + y * y).alias("r"), (F.atan2(y, x) / F.pi()).alias("psi"))


def pol2cart(r: Column, psi: Column) -> Column:
    return point(r * F.cos(psi * F.pi()), r * F.sin(psi * F.pi()))
