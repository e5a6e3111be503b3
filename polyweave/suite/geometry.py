"""Scalar geometry evaluated on every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, rotation as rot
from ..functions.shapes import cube_column, polygon_column
from ..functions.vertices import bond_edges
from ..sources.tables import read, widen


def tidy(c, digits: int = 6):
    """Rounded, with negative zero folded into zero."""
    return F.round(c, digits) + F.lit(0.0)


def sql_tidy(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def items(spark, folder, **columns):
    return read(spark, folder, "lineitem").selectExpr(*KEYS, *[f"{e} AS {c}" for c, e in columns.items()])


# ------------------------------------------------------------------------ shapes

PART_POLYGON = {"p_partkey": "p_partkey", "n": "CAST(p_size % 4 + 3 AS INT)", "side": "p_retailprice / 1000"}


def part_polygons(spark, folder):
    return read(spark, folder, "part").selectExpr(*[f"{e} AS {c}" for c, e in PART_POLYGON.items()]) \
        .withColumn("g", polygon_column(F.col("n"), F.col("side")))


def polygon_geometry(spark, folder):
    """Sites, rotations and radii of one regular polygon per part."""
    z = F.explode(F.arrays_zip(F.col("g.sites"), F.col("g.refs"), F.col("g.turns"), F.col("g.corners"))).alias("s")
    rows = part_polygons(spark, folder).select("p_partkey", "n", "g.r_min", "g.r_max", z)
    return rows.select("p_partkey", "n", tidy(F.col("s.sites.x")).alias("x"), tidy(F.col("s.sites.y")).alias("y"),
                       tidy(F.col("s.refs")).alias("theta_ref"), tidy(F.col("s.turns")).alias("dtheta"),
                       tidy(F.col("s.corners.x")).alias("corner_x"), tidy(F.col("s.corners.y")).alias("corner_y"),
                       tidy(F.col("r_min")).alias("r_min"), tidy(F.col("r_max")).alias("r_max"))


POLYGON_SQL = f"""SELECT p_partkey, n,
{sql_tidy('r_in * cos(pi() * (-2.0 * i / n - 0.5))')} AS x, {sql_tidy('r_in * sin(pi() * (-2.0 * i / n - 0.5))')} AS y,
{sql_tidy('2.0 * i / n')} AS theta_ref, {sql_tidy('(3 - 2.0 * i / n) % 2')} AS dtheta,
{sql_tidy('r_out * cos(pi() * (2.0 * i + 1) / n)')} AS corner_x, {sql_tidy('r_out * sin(pi() * (2.0 * i + 1) / n)')} AS corner_y,
{sql_tidy('r_in')} AS r_min, {sql_tidy('r_out')} AS r_max
FROM (SELECT p_partkey, n, unnest(range(0, n)) AS i, side / (2 * tan(pi() / n)) AS r_in, side / (2 * sin(pi() / n)) AS r_out
      FROM (SELECT p_partkey, CAST(p_size % 4 + 3 AS INT) AS n, p_retailprice / 1000 AS side FROM part))"""


def shifted_sites(spark, folder):
    """Face centres of one regular polygon per part, all moved by one step."""
    delta = rot.point(F.col("p_size") / 4, F.col("p_retailprice") / 500)
    rows = part_polygons(spark, folder).join(read(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    rows = rows.select("p_partkey", F.posexplode(rot.shift_points(F.col("g.sites"), delta, 2)).alias("pos", "x"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("site"), tidy(F.col("x.x")).alias("x"), tidy(F.col("x.y")).alias("y"))


SHIFT_SQL = f"""SELECT p_partkey, i + 1 AS site, {sql_tidy('r_in * cos(pi() * (-2.0 * i / n - 0.5)) + p_size / 4.0')} AS x,
{sql_tidy('r_in * sin(pi() * (-2.0 * i / n - 0.5)) + p_retailprice / 500')} AS y
FROM (SELECT *, unnest(range(0, n)) AS i, p_retailprice / 1000 / (2 * tan(pi() / n)) AS r_in
      FROM (SELECT p_partkey, p_size, p_retailprice, CAST(p_size % 4 + 3 AS INT) AS n FROM part))"""


def cube_geometry(spark, folder):
    """Face centres of one cube per part, with the image of each under its reference rotation."""
    rows = read(spark, folder, "part").select("p_partkey", cube_column(F.col("p_retailprice") / 1000).alias("g"))
    rows = rows.select("p_partkey", "g.r_max", F.posexplode(F.arrays_zip("g.sites", "g.refs")).alias("pos", "s"))
    back = rot.rotate3(F.col("s.sites"), F.col("s.refs"))
    return rows.select("p_partkey", (F.col("pos") + 1).alias("site"),
                       *[tidy(F.col(f"s.sites.{k}")).alias(k) for k in "xyz"],
                       *[tidy(back[k]).alias(f"ref_{k}") for k in "xyz"], tidy(F.col("r_max")).alias("r_max"))


CUBE_SQL = f"""SELECT p_partkey, site, {sql_tidy('a * x')} AS x, {sql_tidy('a * y')} AS y, {sql_tidy('a * z')} AS z,
{sql_tidy('a')} AS ref_x, 0.0 AS ref_y, 0.0 AS ref_z, {sql_tidy('a * sqrt(3.0)')} AS r_max
FROM (SELECT p_partkey, p_retailprice / 1000 AS a FROM part), (VALUES (1, 1, 0, 0), (2, 0, 0, -1), (3, 0, 1, 0),
(4, 0, 0, 1), (5, 0, -1, 0), (6, -1, 0, 0)) v(site, x, y, z)"""


def geometry_summary(spark, folder):
    """Sites, graph vertices and dimension per kind of block, over all parts."""
    g = part_polygons(spark, folder).select("n", F.size("g.sites").alias("sites"))
    return g.groupBy("n").agg(F.count(F.lit(1)).alias("blocks"), F.first("sites").alias("n_sites"),
                              F.sum("sites").alias("vertices"), F.lit(2).alias("dim"))


# --------------------------------------------------------------------- rotations

QUAT = {"w": "l_quantity", "x": "l_linenumber - 3.5", "y": "l_partkey % 7 - 2.5", "z": "l_suppkey % 5 + 0.5"}
NORM = "sqrt(w * w + x * x + y * y + z * z)"


def rotate_sites(spark, folder):
    """A 2D point turned by an angle, a 3D point by a quaternion, per line item."""
    df = items(spark, folder, theta="l_discount * 13 + l_tax * 7", px="l_quantity / 8", py="l_linenumber / 4.0", **QUAT)
    two = rot.rotate2(rot.point(F.col("px"), F.col("py")), rot.angle(F.col("theta")))
    q = rot.quat_normalized(rot.quat(*[F.col(c) for c in "wxyz"]))
    df = df.select(*KEYS, two.alias("a"), q.alias("q"), rot.point(F.col("px"), F.col("py"), F.lit(1.0)).alias("p"))
    df = df.withColumn("b", rot.rotate3(F.col("p"), F.col("q")))
    return df.select(*KEYS, tidy(F.col("a.x")).alias("x2"), tidy(F.col("a.y")).alias("y2"),
                     *[tidy(F.col(f"b.{k}")).alias(f"{k}3") for k in "xyz"])


ROTATE_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey,
{sql_tidy('cos(pi() * theta) * px - sin(pi() * theta) * py')} AS x2, {sql_tidy('sin(pi() * theta) * px + cos(pi() * theta) * py')} AS y2,
{sql_tidy('(1 - 2 * (y * y + z * z)) * px + 2 * (x * y - w * z) * py + 2 * (x * z + w * y)')} AS x3,
{sql_tidy('2 * (x * y + w * z) * px + (1 - 2 * (x * x + z * z)) * py + 2 * (y * z - w * x)')} AS y3,
{sql_tidy('2 * (x * z - w * y) * px + 2 * (y * z + w * x) * py + 1 - 2 * (x * x + y * y)')} AS z3
FROM (SELECT *, w0 / m AS w, x0 / m AS x, y0 / m AS y, z0 / m AS z FROM (
SELECT *, sqrt(w0 * w0 + x0 * x0 + y0 * y0 + z0 * z0) AS m FROM (
SELECT *, l_discount * 13 + l_tax * 7 AS theta, l_quantity / 8 AS px, l_linenumber / 4.0 AS py,
{', '.join(f'CAST({e} AS DOUBLE) AS {c}0' for c, e in QUAT.items())} FROM lineitem)))"""


def site_positions(spark, folder):
    """World position of one site of a block placed at a data-given pose."""
    df = items(spark, folder, n="CAST(l_linenumber % 4 + 3 AS INT)", s="CAST(l_suppkey % 3 + 1 AS INT)",
               hx="l_quantity", hy="l_partkey % 10 / 4", theta="l_discount * 10 + l_tax * 5")
    df = df.withColumn("site", F.element_at(polygon_column(F.col("n"), F.lit(1.0))["sites"], F.col("s")))
    at = contact.site_position(rot.point(F.col("hx"), F.col("hy")), rot.angle(F.col("theta")), F.col("site"), 2)
    return df.withColumn("at", at).select(*KEYS, tidy(F.col("at.x")).alias("x"), tidy(F.col("at.y")).alias("y"))


SITE_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey,
{sql_tidy('hx + r * cos(pi() * (theta - 2.0 * (s - 1) / n - 0.5))')} AS x,
{sql_tidy('hy + r * sin(pi() * (theta - 2.0 * (s - 1) / n - 0.5))')} AS y
FROM (SELECT *, 1 / (2 * tan(pi() / n)) AS r FROM (SELECT *, l_linenumber % 4 + 3 AS n, l_suppkey % 3 + 1 AS s,
l_quantity AS hx, l_partkey % 10 / 4 AS hy, l_discount * 10 + l_tax * 5 AS theta FROM lineitem))"""


def grab_align(spark, folder):
    """Move three rigidly linked blocks so that the second one takes a given pose."""
    df = items(spark, folder, a="l_quantity / 4", b="l_linenumber / 2.0", t="l_discount * 10", u="l_tax * 10")
    p = lambda x, y: rot.point(x, y)
    xs = F.array(p(F.lit(0.0), F.lit(0.0)), p(F.col("a"), F.col("b")), p(F.col("b"), F.lit(1.0)))
    psis = F.array(rot.angle(0.0), rot.angle(F.col("t")), rot.angle(F.col("u")))
    df = df.select(*KEYS, "t", "u", xs.alias("xs"), psis.alias("psis"))
    nx, npsi = rot.grab(F.col("xs"), F.col("psis"), 2, 2, rot.point(F.lit(1.0), F.lit(2.0)), rot.angle(F.col("u")))
    df = df.select(*KEYS, nx.alias("nx"), npsi.alias("np"))
    return df.select(*KEYS, *[tidy(F.col("nx")[i][k]).alias(f"{k}{i + 1}") for i in range(3) for k in "xy"],
                     *[tidy(F.cos(F.col("np")[i] * F.pi())).alias(f"c{i + 1}") for i in range(3)])


def _grab(px, py):
    dx, dy, c, s = f"({px} - a)", f"({py} - b)", "cos(pi() * (u - t))", "sin(pi() * (u - t))"
    return f"1 + {c} * {dx} - {s} * {dy}", f"2 + {s} * {dx} + {c} * {dy}"


_g = [_grab(*p) for p in (("0", "0"), ("a", "b"), ("b", "1"))]
GRAB_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey,
{', '.join(f'{sql_tidy(e)} AS {k}{i + 1}' for i, g in enumerate(_g) for k, e in zip('xy', g))},
{', '.join(f"{sql_tidy(f'cos(pi() * ({e}))')} AS c{i + 1}" for i, e in enumerate(('u - t', 'u', '2 * u - t')))}
FROM (SELECT *, l_quantity / 4 AS a, l_linenumber / 2.0 AS b, l_discount * 10 AS t, l_tax * 10 AS u FROM lineitem)"""


def angle_algebra(spark, folder):
    df = items(spark, folder, a="l_quantity / 8 - 3", b="l_linenumber / 4.0 + l_partkey % 16 / 8")
    a, b = rot.angle(F.col("a")), rot.angle(F.col("b"))
    return df.select(*KEYS, tidy(rot.angle_mul(a, b)).alias("product"), tidy(rot.angle_inv(a)).alias("inverse"),
                     rot.angle_eq(a, b).alias("equal"), rot.angle_approx(a, b, 0.01).alias("close"))


MOD2 = lambda e: f"((({e}) % 2 + 2) % 2)"
ANGLE_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql_tidy(MOD2('a + b'))} AS product,
{sql_tidy(MOD2('-a'))} AS inverse, {MOD2('a')} = {MOD2('b')} AS equal,
abs({MOD2('a')} - {MOD2('b')}) <= greatest({MOD2('a')}, {MOD2('b')}) * 0.01 AS close
FROM (SELECT *, l_quantity / 8 - 3 AS a, l_linenumber / 4.0 + l_partkey % 16 / 8 AS b FROM lineitem)"""


def quaternion_algebra(spark, folder):
    df = items(spark, folder, **QUAT)
    p = rot.quat(*[F.col(c) for c in "wxyz"])
    q = rot.quat(F.col("z"), F.col("w"), F.lit(1.0), F.col("x"))
    df = df.select(*KEYS, p.alias("p"), q.alias("q"))
    df = df.withColumn("m", rot.quat_mul(F.col("p"), F.col("q"))).withColumn("u", rot.quat_normalized(F.col("p")))
    df = df.withColumn("i", rot.quat_mul(F.col("p"), rot.quat_inv(F.col("p"))))
    return df.select(*KEYS, *[tidy(F.col(f"m.{c}")).alias(f"m{c}") for c in "wxyz"],
                     tidy(rot.quat_norm(F.col("p"))).alias("norm"), tidy(F.col("u.w")).alias("uw"),
                     tidy(F.col("i.w")).alias("iw"), tidy(F.col("i.x")).alias("ix"),
                     rot.quat_eq(F.col("p"), F.col("q")).alias("equal"))


QUAT_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey,
{sql_tidy('w * z - x * w - y * 1 - z * x')} AS mw, {sql_tidy('w * w + x * z + y * x - z * 1')} AS mx,
{sql_tidy('w * 1 - x * x + y * z + z * w')} AS my, {sql_tidy('w * x + x * 1 - y * w + z * z')} AS mz,
{sql_tidy(NORM)} AS norm, {sql_tidy(f'w / {NORM}')} AS uw, {sql_tidy('w * w + x * x + y * y + z * z')} AS iw,
0.0 AS ix, (w = z AND x = w AND y = 1 AND z = x) AS equal
FROM (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in QUAT.items())} FROM lineitem)"""


def polar_roundtrip(spark, folder):
    df = items(spark, folder, x="l_quantity - 20.25", y="l_linenumber * 2 - 7.5")
    df = df.withColumn("p", rot.cart2pol(F.col("x"), F.col("y")))
    df = df.withColumn("c", rot.pol2cart(F.col("p.r"), F.col("p.psi")))
    return df.select(*KEYS, tidy(F.col("p.r")).alias("r"), tidy(F.col("p.psi")).alias("psi"),
                     tidy(F.col("c.x")).alias("x"), tidy(F.col("c.y")).alias("y"))


POLAR_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql_tidy('sqrt(x * x + y * y)')} AS r,
{sql_tidy('atan2(y, x) / pi()')} AS psi, {sql_tidy('x')} AS x, {sql_tidy('y')} AS y
FROM (SELECT *, l_quantity - 20.25 AS x, l_linenumber * 2 - 7.5 AS y FROM lineitem)"""


# ---------------------------------------------------------------- pairs of blocks

PAIR = {"n": "CAST(l_linenumber % 4 + 3 AS INT)", "i": "CAST(l_suppkey % 3 + 1 AS INT)",
        "j": "CAST(l_partkey % 3 + 1 AS INT)", "push": "CAST(l_quantity AS INT) % 4 * 0.3"}


def pairs(spark, folder):
    """Two equal polygons per line item: glued i to j, then pushed apart or together."""
    df = widen(items(spark, folder, **PAIR))
    # one-element generators pin the block and the pose; otherwise both are rebuilt at every use
    df = df.withColumn("g", F.explode(F.array(polygon_column(F.col("n"), F.lit(1.0)))))
    at = lambda field, k: F.element_at(F.col(f"g.{field}"), F.col(k))
    dx, dpsi = contact.attachment(at("sites", "i"), at("turns", "i"), at("sites", "j"), at("refs", "j"), 2)
    df = df.withColumn("v", F.explode(F.array(F.struct(dx.alias("dx0"), dpsi.alias("dpsi")))))
    df = df.select("*", "v.dx0", "v.dpsi").drop("v")
    scale = 1.3 - F.col("push")
    return df.withColumn("dx", rot.point(F.col("dx0.x") * scale, F.col("dx0.y") * scale))


GLUE_SQL = f"""(SELECT *, 2 * r * cos(pi() * u) AS gx, 2 * r * sin(pi() * u) AS gy, 1.3 - push AS scale,
1 / (2 * sin(pi() / n)) AS r_out, {MOD2('1 - 2.0 * (i - 1) / n + 2.0 * (j - 1) / n')} AS psi
FROM (SELECT *, 1 / (2 * tan(pi() / n)) AS r, -2.0 * (i - 1) / n - 0.5 AS u FROM (
SELECT *, {', '.join(f'{e} AS {c}' for c, e in PAIR.items())} FROM lineitem)))"""


def attachment_offset(spark, folder):
    df = pairs(spark, folder)
    return df.select(*KEYS, tidy(F.col("dx0.x")).alias("dx"), tidy(F.col("dx0.y")).alias("dy"),
                     tidy(F.cos(F.col("dpsi") * F.pi())).alias("c"), tidy(F.sin(F.col("dpsi") * F.pi())).alias("s"))


OFFSET_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, {sql_tidy('gx')} AS dx, {sql_tidy('gy')} AS dy,
{sql_tidy('cos(pi() * psi)')} AS c, {sql_tidy('sin(pi() * psi)')} AS s FROM {GLUE_SQL}"""


def face_pairs(spark, folder):
    """Sites that coincide, one row per pair."""
    df = pairs(spark, folder)
    hits = contact.face_pairs(F.col("dx"), F.lit(0.0), F.col("dpsi"), F.col("g.sites"), F.col("g.sites"), 2)
    return df.select(*KEYS, F.explode(hits).alias("f")).select(*KEYS, "f.i", "f.j")


FACES_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, a AS i, b AS j FROM (
SELECT *, unnest(range(1, n + 1)) AS b FROM (SELECT *, unnest(range(1, n + 1)) AS a FROM (
SELECT l_orderkey, l_linenumber, l_partkey, n, r, gx, gy, scale, psi FROM {GLUE_SQL})))
WHERE greatest(abs(r * cos(pi() * (-2.0 * (a - 1) / n - 0.5)) - r * cos(pi() * (psi - 2.0 * (b - 1) / n - 0.5)) - gx * scale),
               abs(r * sin(pi() * (-2.0 * (a - 1) / n - 0.5)) - r * sin(pi() * (psi - 2.0 * (b - 1) / n - 0.5)) - gy * scale)) < 0.01"""


def overlap_pairs(spark, folder):
    df = pairs(spark, folder)
    return df.select(*KEYS, contact.overlaps(F.col("dx"), F.col("g.r_min"), 2).alias("overlap"))


OVERLAP_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, 2 * r * scale < 2 * r - 0.1 AS overlap FROM {GLUE_SQL}"""


def contact_status(spark, folder):
    df = pairs(spark, folder)
    status = contact.contact_status(F.col("dx"), F.lit(0.0), F.col("dpsi"), F.col("g"), F.col("g"), 2)
    return df.withColumn("c", status).select(*KEYS, F.col("c.ok").alias("ok"), F.size("c.pairs").alias("faces"))


STATUS_SQL = f"""SELECT g.l_orderkey, g.l_linenumber, g.l_partkey, NOT (2 * r * scale <= 2 * r_out AND 2 * r * scale < 2 * r - 0.1) AS ok,
CASE WHEN 2 * r * scale > 2 * r_out OR 2 * r * scale < 2 * r - 0.1 OR abs(scale - 1) > 1e-9 THEN 0 ELSE 1 END AS faces
FROM {GLUE_SQL} g"""


def bond_edges_query(spark, folder):
    """Graph edges of a bond between sites with differing vertex counts."""
    df = items(spark, folder, ni="CAST(l_linenumber AS INT)", nj="CAST(l_suppkey % 8 + 1 AS INT)")
    return df.selectExpr(*KEYS, "ni", "nj", f"inline({bond_edges('ni', 'nj')})").withColumnsRenamed({"i": "v", "j": "u"})


EDGES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, ni, nj, v, u FROM (
SELECT *, CASE WHEN greatest(ni, nj) % least(ni, nj) <> 0 THEN 1 ELSE k * si + 1 END AS v,
CASE WHEN greatest(ni, nj) % least(ni, nj) <> 0 THEN 1 ELSE (least(ni, nj) - 1 - k) * sj + 1 END AS u
FROM (SELECT *, greatest(ni // nj, 1) AS si, greatest(nj // ni, 1) AS sj,
unnest(range(0, CASE WHEN greatest(ni, nj) % least(ni, nj) <> 0 THEN 1 ELSE least(ni, nj) END)) AS k
FROM (SELECT *, l_linenumber AS ni, CAST(l_suppkey % 8 + 1 AS INT) AS nj FROM lineitem)))"""


QUERIES = {
    "polygon_geometry": (polygon_geometry, POLYGON_SQL),
    "cube_geometry": (cube_geometry, CUBE_SQL),
    "geometry_summary": (geometry_summary, """SELECT n, count(*) AS blocks, n AS n_sites, sum(n) AS vertices, 2 AS dim
FROM (SELECT CAST(p_size % 4 + 3 AS INT) AS n FROM part) GROUP BY n"""),
    "rotate_sites": (rotate_sites, ROTATE_SQL),
    "site_positions": (site_positions, SITE_SQL),
    "shifted_sites": (shifted_sites, SHIFT_SQL),
    "grab_align": (grab_align, GRAB_SQL),
    "angle_algebra": (angle_algebra, ANGLE_SQL),
    "quaternion_algebra": (quaternion_algebra, QUAT_SQL),
    "polar_roundtrip": (polar_roundtrip, POLAR_SQL),
    "attachment_offset": (attachment_offset, OFFSET_SQL),
    "face_pairs": (face_pairs, FACES_SQL),
    "overlap_pairs": (overlap_pairs, OVERLAP_SQL),
    "contact_status": (contact_status, STATUS_SQL),
    "bond_edges": (bond_edges_query, EDGES_SQL),
}
