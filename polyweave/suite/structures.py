"""Growing, enumerating and describing the structures of many systems at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..blocks import CUBE, HEXAGON, SQUARE, TRIANGLE, BlockLibrary
from ..functions.vertices import (block_vertices, first_vertex, site_first_vertices, site_vertices, vertex_count,
                                  vertex_table)
from ..operators import composition as comp
from ..operators import growth
from ..oracle import Lattice, TurnedCubes, source
from ..plans.enumerate import counts_by_size, polyenum, polygen, with_empty
from ..sources import tables
from ..sources.systems import SystemCatalog, site_table
from .geometry import sql_tidy, tidy

ORDER, CUSTOMER, TALK, DAY = (Lattice(s) for s in ("triangle", "cube", "square", "hexagon"))


def alike_systems(spark, folder, table: str, columns: dict, shape, n_species: int) -> SystemCatalog:
    """Blocks with interchangeable faces: a bond row lets two species touch face to face."""
    library = BlockLibrary.uniform(shape, n_species, [1] * shape.n_sites)
    pairs = tables.bonds(spark, folder, table, {k: columns[k] for k in ("sys", "species_i", "species_j")})
    faces = pairs.withColumn("site_i", F.explode(F.sequence(F.lit(1), F.lit(shape.n_sites))))
    return SystemCatalog.from_bonds(library, faces.withColumn("site_j", F.col("site_i")))


def recursive(lattice: Lattice, name: str, size: int, tail: str) -> str:
    return f"WITH RECURSIVE {lattice.enumeration(source(name), size)}\n{tail}"


COUNTS = "SELECT sys, n, count(*) AS structures FROM forms GROUP BY sys, n"


# ------------------------------------------------------------- breadth-first generation

def generated(make, size):
    return lambda spark, folder: polygen(make(spark, folder), max_size=size, summary=counts_by_size)


def searched(make, size):
    """Structure count and largest size per system, by reverse search."""
    def query(spark, folder):
        return polyenum(make(spark, folder), max_size=size).run.by_system(
            lambda found: found.groupBy("sys").agg(F.count(F.lit(1)).alias("n_strs"), F.max("n").alias("largest")))
    return query


SEARCHED = "SELECT sys, count(*) AS n_strs, max(n) AS largest FROM forms GROUP BY sys"

polyomino = lambda s, f: alike_systems(s, f, "conversations", tables.TALK_BOND, SQUARE, 2)
polyiamond = lambda s, f: alike_systems(s, f, "lineitem", tables.ORDER_BOND, TRIANGLE, 3)
polycube = lambda s, f: alike_systems(s, f, "orders", tables.CUSTOMER_BOND, CUBE, 2)
ALIKE = {k: Lattice(k, alike=True) for k in ("square", "triangle", "cube")}


#: two faces of each triangle share a label; labels of hexagons with gaps and far from the sites' own
COARSE = {"coarse": [1, 1, 2], "renumbered": [907, 911, 40000, 17, 60000, 3]}
coarse = lambda s, f: SystemCatalog.from_bonds(BlockLibrary.uniform(TRIANGLE, 3, COARSE["coarse"]), tables.order_bonds(s, f))
strict = lambda s, f: SystemCatalog.from_bonds(BlockLibrary.uniform(TRIANGLE, 3, COARSE["coarse"]), tables.order_bonds(s, f), contact_rule="site")
renumbered = lambda s, f: SystemCatalog.from_bonds(BlockLibrary.uniform(HEXAGON, 2, COARSE["renumbered"]),
                                             tables.bonds(s, f, "events", tables.DAY_BOND))
COARSE_ORDER = Lattice("triangle", colors=COARSE["coarse"])


def turned_cubes(spark, folder):
    """One cube system per user and day of month, one bond of any two faces per event."""
    return SystemCatalog.from_bonds(BlockLibrary.uniform(CUBE, 2), tables.bonds(spark, folder, "events", tables.DAY_BOND))


def mixed_systems(spark, folder):
    """Triangles and squares together, one system per conversation."""
    bond = {**tables.TALK_BOND, "site_i": "CAST(length(text) % 3 + 1 AS INT)",
            "site_j": "CAST(CAST(floor(length(text) / 4) AS BIGINT) % 3 + 1 AS INT)"}
    return SystemCatalog.from_bonds(BlockLibrary([TRIANGLE, SQUARE]),
                                    tables.bonds(spark, folder, "conversations", bond))


# ---------------------------------------------------------------------------- callbacks

def polyenum_reduce(spark, folder):
    """Fold over all structures: total number of blocks of species 1."""
    out = polyenum(tables.day_systems(spark, folder), max_size=3,
                   reducer=lambda df: F.size(F.filter("species", lambda s: s == 1)), fold_by=())
    return out.reduced.select(F.col("value").cast("bigint").alias("species_one_blocks"))


def polyenum_fold_systems(spark, folder):
    """Fold over the structures of each system with a function of the caller's, here the exclusive or."""
    out = polyenum(tables.day_systems(spark, folder), max_size=3, fold_by=("sys",), fold_lists=True, reduce_op=lambda a, b: a ^ b,
                   reducer=lambda df: (F.col("n") * 8 + F.size(F.filter("species", lambda s: s == 1))).cast("bigint"))
    return out.reduced.withColumnRenamed("value", "folded")


def polyenum_collect(spark, folder):
    """Keep structures without species 2, return their sizes."""
    out = polyenum(tables.day_systems(spark, folder), max_size=3,
                   aggregator=lambda df: (~F.array_contains("species", F.lit(2).cast("smallint")), F.col("n")))
    return out.collected.groupBy("sys", F.col("value").alias("n")).agg(F.count(F.lit(1)).alias("structures"))


def polyenum_reject(spark, folder):
    """Drop, and do not grow, anything with two blocks of species 1."""
    twice = lambda df: F.when(F.size(F.filter("species", lambda s: s == 1)) > 1, 2).otherwise(0)
    return counts_by_size(polyenum(tables.talk_systems(spark, folder), max_size=4, rejector=twice).structures)


def polyenum_leaf(spark, folder):
    """Count, but do not grow, structures of the largest size that their system is given."""
    leaf = lambda df: F.when(F.col("n") == F.col("sys") % 3 + 1, 1).otherwise(0)
    return counts_by_size(polyenum(tables.talk_systems(spark, folder), max_size=4, rejector=leaf).structures)


def polyenum_stop(spark, folder):
    """Each system ends with the first size that has a structure with two blocks of species 1."""
    twice = lambda df: F.when(F.size(F.filter("species", lambda s: s == 1)) > 1, 3).otherwise(0)
    return counts_by_size(polyenum(tables.talk_systems(spark, folder), max_size=4, rejector=twice).structures)


def polygen_callback(spark, folder):
    """Map every structure to its number of open sites, then count."""
    return polygen(tables.day_systems(spark, folder), max_size=3, callback=lambda df: df.select(
        "sys", F.size(F.filter("partner", lambda p: p == 0)).alias("open_sites"))) \
        .groupBy("sys", "open_sites").agg(F.count(F.lit(1)).alias("structures"))


def polygen_max_strs(spark, folder):
    return polygen(tables.talk_systems(spark, folder), max_size=4, max_strs=1000).agg(
        F.count(F.lit(1)).alias("structures"))


def polygen_max_strs_systems(spark, folder):
    """Which systems the first 1,000 structures belong to, in order of size and system; blocks always stay."""
    return counts_by_size(polygen(tables.talk_systems(spark, folder), max_size=4, max_strs=1000))


def polygen_limit_each(spark, folder):
    """At most 25 structures of every system, of which the blocks always stay."""
    found = polygen(tables.day_systems(spark, folder), max_size=3, each_system=25)
    return found.groupBy("sys").agg(F.count(F.lit(1)).alias("structures"), F.max("n").alias("largest"))


def polyenum_limit_each(spark, folder):
    """The sizes of the first 40 structures of every system, by reverse search."""
    return polyenum(tables.order_systems(spark, folder), max_size=3, each_system=40).run.by_system(counts_by_size)


# ------------------------------------------------------------------------- growth steps

def open_bonds(spark, folder):
    """Open sites of the single blocks with every label that may bind there."""
    catalog = tables.order_systems(spark, folder)
    rows = growth.monomers(catalog).selectExpr(
        "sys", "species[0] AS species", f"inline({growth.open_bonds(catalog.library, 1)})")
    return rows.withColumnRenamed("label", "partner_label")


def attach_candidates(spark, folder):
    """Rules joined with the site table at both ends: where the partner block would sit."""
    catalog = tables.order_systems(spark, folder)
    sites = site_table(spark, catalog.library)
    host = sites.select(F.col("label").alias("label_i"), F.col("x").alias("xi"), F.col("turn"))
    guest = sites.select(F.col("label").alias("label_j"), F.col("species").alias("species_j"), F.col("x").alias("xj"), "ref")
    from ..functions.contact import attachment
    dx, dpsi = attachment(F.col("xi"), F.col("turn"), F.col("xj"), F.col("ref"), 3)
    rows = catalog.bond_rules().join(F.broadcast(host), "label_i").join(F.broadcast(guest), "label_j")
    rows = rows.select("sys", "label_i", "label_j", "species_j", dx.alias("dx"), dpsi.alias("q"))
    return rows.select("sys", "label_i", "label_j", "species_j", tidy(F.col("dx.x")).alias("dx"),
                       tidy(F.col("dx.y")).alias("dy"), tidy(2 * F.col("q.w") * F.col("q.w") - 1).alias("c"))


ATTACH_SQL = f"""SELECT sys, li AS label_i, lj AS label_j, sj AS species_j,
{sql_tidy('cos(pi() * (-2.0 * (ti - 1) / 3 - 0.5)) / sqrt(3.0)')} AS dx,
{sql_tidy('sin(pi() * (-2.0 * (ti - 1) / 3 - 0.5)) / sqrt(3.0)')} AS dy,
{sql_tidy('cos(pi() * (1 - 2.0 * (ti - 1) / 3 + 2.0 * (tj - 1) / 3))')} AS c FROM pairs"""


def find_bonds(spark, folder):
    """Attachments to two-block structures: all without overlap, closing ones, permitted ones."""
    catalog = tables.day_systems(spark, folder)
    pairs = polygen(catalog, max_size=2).where("n = 2")
    rows = growth.candidates(pairs, catalog.library, 2).select("sys", F.size("new.touch").alias("t"),
                                                               F.expr(growth.permitted(catalog)).alias("good"))
    return rows.groupBy("sys").agg(F.count(F.lit(1)).alias("candidates"),
                                   F.count(F.when(F.col("t") > 1, 1)).alias("closing"),
                                   F.count(F.when(F.col("good"), 1)).alias("permitted"))


def find_bonds_sql() -> str:
    h = DAY
    steps = [list(s) for s in h.steps]
    new = [*h.position("r.ti", "c"), h.orientation("r.ti", "r.tj", "c"), "r.sj"]
    d = ["f[1] - e[1]", "f[2] - e[2]"]
    here, there = h.face("e", d), h.face("f", ["e[1] - f[1]", "e[2] - f[2]"])
    fine = f"list_contains(codes, ((e[4] - 1) * 6 + {here}) * 100 + (f[4] - 1) * 6 + {there})"
    near = f"list_contains({steps}, [{', '.join(d)}])"
    return recursive(h, "day", 2, f"""
SELECT sys, count(*) AS candidates, count(*) FILTER (WHERE touch > 1) AS closing,
count(*) FILTER (WHERE good = touch) AS permitted FROM (
  SELECT sys, len([1 for e in cells if {near}]) AS touch, len([1 for e in cells if {near} AND {fine}]) AS good FROM (
    SELECT o.sys, o.cells, o.codes, [{', '.join(new)}] AS f
    FROM (SELECT forms.sys, cells, codes, unnest(cells) AS c FROM forms JOIN rules ON rules.sys = forms.sys WHERE n = 2) o
    JOIN pairs r ON r.sys = o.sys AND r.si = o.c[4])
  WHERE len([1 for e in cells if e[1] = f[1] AND e[2] = f[2]]) = 0) GROUP BY sys""")


def grow_step(spark, folder):
    """One growth step from the two-block structures: distinct children per system."""
    return polygen(tables.order_systems(spark, folder), max_size=3, summary=lambda found: found.where("n = 3").groupBy("sys").agg(
        F.count(F.lit(1)).alias("children")))


# ---------------------------------------------------------------- columns and encoders

def polyform_columns(spark, folder):
    """Blocks, graph vertices and open sites, summed per system and size."""
    catalog = tables.customer_systems(spark, folder)
    rows = polygen(catalog, max_size=2).selectExpr(
        "sys", "n", f"{vertex_count(catalog.library)} AS v", "size(species) AS b", "size(filter(partner, p -> p = 0)) AS o")
    return rows.groupBy("sys", "n").agg(F.sum("b").alias("blocks"), F.sum("v").alias("vertices"),
                                        F.sum("o").alias("open_sites"))


def _alike(structures, *by):
    """Numbers of structures with the same blocks, whose graph vertices are numbered alike."""
    return structures.groupBy(*by, "n", "species").agg(F.count(F.lit(1)).alias("structures"))


def vertex_index(spark, folder):
    """First and last graph vertex of every (block, site), with the block's own range."""
    catalog = tables.customer_systems(spark, folder)
    lib = catalog.library
    rows = _alike(polygen(catalog, max_size=2)).selectExpr("*", "posexplode(species) AS (at, k)")
    rows = rows.selectExpr("*", "at + 1 AS particle", f"explode(sequence(1, {lib.stride})) AS site")
    vs, bs = site_vertices(lib, "particle", "site"), block_vertices(lib, "particle")
    rows = rows.selectExpr("n", "structures", "particle", "site", f"{first_vertex(lib, 'particle', 'site')} AS first",
                           f"array_max({vs}) AS last", f"array_min({bs}) AS block_first", f"array_max({bs}) AS block_last")
    return rows.groupBy("n", "particle", "site", "first", "last", "block_first", "block_last").agg(
        F.sum("structures").alias("structures"))


def vertex_inverse(spark, folder):
    """Graph vertices of cube structures mapped back to (block, site), and the first vertex of that site."""
    catalog = tables.customer_systems(spark, folder)
    lib = catalog.library
    rows = _alike(polygen(catalog, max_size=2)).selectExpr("*", f"posexplode({vertex_table(lib)}) AS (at, v)")
    rows = rows.selectExpr("n", "structures", "at + 1 AS vertex", "v.particle AS particle", "v.site AS site",
                           f"element_at({site_first_vertices(lib, 'v.particle')}, v.site) AS first")
    return rows.groupBy("n", "vertex", "particle", "site", "first").agg(F.sum("structures").alias("structures"))


INVERSE_SQL = """
SELECT n, vertex, (vertex - 1) // 24 + 1 AS particle, (vertex - 1) % 24 // 4 + 1 AS site, (vertex - 1) // 4 * 4 + 1 AS first, structures
FROM (SELECT n, count(*) AS structures FROM forms GROUP BY n), range(1, 49) r(vertex) WHERE vertex <= 24 * n"""


def polyenum_fold_least(spark, folder):
    """Least and largest value of a fold whose value on the empty structure is the least."""
    run = polyenum(tables.day_systems(spark, folder), max_size=3)
    rows = with_empty(run.structures).select((2 * F.col("n") + 5).alias("v"))
    return rows.agg(F.min("v").cast("bigint").alias("least"), F.max("v").cast("bigint").alias("largest"), F.count(F.lit(1)).alias("folded"))


def vertex_lookup(spark, folder):
    """Graph vertices mapped back to site labels; how often each label occurs per system."""
    catalog = tables.talk_systems(spark, folder)
    rows = _alike(polygen(catalog, max_size=3), "sys").selectExpr("sys", "n", "structures", f"inline({vertex_table(catalog.library)})")
    return rows.groupBy("sys", "n", "label").agg(F.sum("structures").alias("vertices"))


# ---------------------------------------------------------------------------- analytics

def composition_species(spark, folder):
    catalog = tables.talk_systems(spark, folder)
    rows = comp.composition(polygen(catalog, max_size=4), catalog.library)
    return rows.groupBy("sys", F.col("species_counts")[0].alias("ones"), F.col("species_counts")[1].alias("twos")).agg(
        F.count(F.lit(1)).alias("structures"))


SPECIES_SQL = """SELECT sys, ones, twos, count(*) AS structures FROM (
SELECT sys, len([1 for e in cells if e[4] = 1]) AS ones, len([1 for e in cells if e[4] = 2]) AS twos FROM forms)
GROUP BY sys, ones, twos"""


def composition_bonds(spark, folder):
    """Bonds of each allowed type over all structures of a system."""
    catalog = tables.talk_systems(spark, folder)
    rows = comp.composition(polygen(catalog, max_size=4), catalog.library)
    types = comp.ordered_types("allowed")
    rows = rows.selectExpr("sys", f"inline(transform({types}, (t, i) -> named_struct('t', t, 'c', bond_counts[i])))")
    return rows.groupBy("sys", F.col("t.i").alias("label_i"), F.col("t.j").alias("label_j")).agg(
        F.sum("c").alias("bonds"))


def bond_rows_sql() -> str:
    """CTE ``found(sys, id, n, i, j)``: one row per bond of every square structure."""
    t = TALK
    here, there = t.face("e", ["f[1] - e[1]", "f[2] - e[2]"]), t.face("f", ["e[1] - f[1]", "e[2] - f[2]"])
    a, b = f"(e[4] - 1) * 4 + {here}", f"(f[4] - 1) * 4 + {there}"
    near = f"list_contains({[list(s) for s in t.steps]}, [f[1] - e[1], f[2] - e[2]])"
    return f"""ids AS (SELECT *, row_number() OVER () AS id FROM forms),
found AS (SELECT sys, id, n, least({a}, {b}) AS i, greatest({a}, {b}) AS j FROM (
  SELECT sys, id, n, e, unnest(cells) AS f FROM (SELECT sys, id, n, cells, unnest(cells) AS e FROM ids))
  WHERE e < f AND {near})"""


def compositions(spark, folder):
    """Full composition vectors and how many structures share each."""
    catalog = tables.talk_systems(spark, folder)
    rows = comp.compositions(polygen(catalog, max_size=3), catalog.library)
    return rows.groupBy("sys", F.array_join(F.transform("composition", lambda c: c.cast("string")), ",").alias("composition")
                        ).agg(F.count(F.lit(1)).alias("structures"))


COMPOSITIONS_TAIL = """,
types AS (SELECT sys, i, j FROM (SELECT DISTINCT sys, li AS i, lj AS j FROM pairs) WHERE i <= j),
vectors AS (SELECT ids.sys, ids.id, any_value(cells) AS cells, string_agg(k, ',' ORDER BY tj, ti) AS bonds FROM (
  SELECT x.sys, x.id, t.i AS ti, t.j AS tj, CAST(count(f.id) AS VARCHAR) AS k
  FROM ids x JOIN types t ON t.sys = x.sys LEFT JOIN found f ON f.id = x.id AND f.i = t.i AND f.j = t.j
  GROUP BY x.sys, x.id, t.i, t.j) y JOIN ids ON ids.id = y.id GROUP BY ids.sys, ids.id)
SELECT sys, concat(len([1 for e in cells if e[4] = 1]), ',', len([1 for e in cells if e[4] = 2]), ',', bonds) AS composition,
count(*) AS structures FROM vectors GROUP BY 1, 2"""


def canonical_key(spark, folder):
    """Exact keys of all structures: rows, distinct keys and distinct 64-bit hashes per size."""
    catalog = tables.talk_systems(spark, folder)
    rows = comp.with_key(polygen(catalog, max_size=4), catalog.library)
    return rows.groupBy("sys", "n").agg(F.count(F.lit(1)).alias("structures"), F.countDistinct("key").alias("keys"),
                                        F.countDistinct("rhash").alias("hashes"))


def isomorphic_pairs(spark, folder):
    """Level-by-level and reverse-search results matched by isomorphism."""
    catalog = tables.talk_systems(spark, folder)
    left = polygen(catalog, max_size=4).select("sys", "n", "species", "partner")
    right = polyenum(catalog, max_size=4).structures.select("sys", "n", "species", "partner")
    return comp.isomorphic(catalog.library, left, right).groupBy("sys", F.col("left.n").alias("n")).agg(
        F.count(F.lit(1)).alias("structures"))


def symmetry_number(spark, folder):
    catalog = tables.day_systems(spark, folder)
    rows = comp.with_symmetry(polygen(catalog, max_size=3), catalog.library)
    return rows.groupBy("sys", "n", "sigma").agg(F.count(F.lit(1)).alias("structures"))


def _contained(few: str, many: str) -> str:
    """No value stands more often in array ``few`` than in ``many``."""
    return f"forall({few}, v -> size(filter({few}, x -> x = v)) <= size(filter({many}, x -> x = v)))"


def canonical_parent(spark, folder):
    """Every structure's canonical parent is one of the structures, one block smaller, of its blocks and bonds."""
    catalog = tables.talk_systems(spark, folder)
    found = polygen(catalog, max_size=4).select("sys", "n", "species", "partner")

    def label(slot):
        return f"(species[({slot} - 1) div 4] * 4 + ({slot} - 1) % 4)"

    # each bond as the labels of its two faces, the lesser first
    bonds = (f"transform(filter(sequence(1, size(partner)), i -> partner[i - 1] > i), "
             f"i -> least({label('i')}, {label('partner[i - 1]')}) * 1000 + greatest({label('i')}, {label('partner[i - 1]')}))")
    children = found.where("n > 1").selectExpr("*", "species AS blocks", f"{bonds} AS bonds")
    up = comp.parents(children, catalog.library).selectExpr("*", f"{bonds} AS kept")
    parts = up.where(f"{_contained('species', 'blocks')} AND {_contained('kept', 'bonds')} AND size(kept) < size(bonds)")
    return parts.join(found, ["sys", "n", "species", "partner"]).groupBy("sys", "n").agg(
        F.count(F.lit(1)).alias("children"))


def removable_particles(spark, folder):
    """Structures by number of blocks whose removal leaves one piece."""
    catalog = tables.talk_systems(spark, folder)
    rows = comp.removable_counts(polygen(catalog, max_size=4), catalog.library)
    return rows.groupBy("sys", "n", "removable").agg(F.count(F.lit(1)).alias("structures"))


def removable_sql() -> str:
    near = f"list_contains({[list(s) for s in TALK.steps]}, [e[1] - g[1], e[2] - g[2]])"
    grow = lambda r: f"[e for e in rest if list_contains({r}, e) OR len([1 for g in {r} if {near}]) > 0]"
    return recursive(TALK, "talk", 4, f"""
SELECT sys, n, removable, count(*) AS structures FROM (
  SELECT sys, n, id, count(*) FILTER (WHERE len(r3) = len(rest)) AS removable FROM (
    SELECT *, {grow('r2')} AS r3 FROM (SELECT *, {grow('r1')} AS r2 FROM (SELECT *, {grow('r0')} AS r1 FROM (
      SELECT *, rest[1:1] AS r0 FROM (SELECT sys, n, id, [e for e in cells if e <> gone] AS rest FROM (
        SELECT sys, n, cells, row_number() OVER () AS id, unnest(cells) AS gone FROM (
          SELECT * FROM forms)))))))
  GROUP BY sys, n, id) GROUP BY sys, n, removable""".replace(
        "row_number() OVER () AS id, unnest(cells) AS gone FROM (\n          SELECT * FROM forms)",
        "id, unnest(cells) AS gone FROM (\n          SELECT *, row_number() OVER () AS id FROM forms)"))


def positions_query(spark, folder):
    """Squared centre distances within a structure: squared radius of gyration, per size."""
    catalog = tables.talk_systems(spark, folder)
    rows = comp.positions(polygen(catalog, max_size=4), catalog.library)
    mean = lambda c: f"aggregate(pose.{c}, 0D, (s, v) -> s + v) / n"
    spread = lambda c: f"aggregate(pose.{c}, 0D, (s, v) -> s + v * v) / n - {mean(c)} * {mean(c)}"
    rows = rows.selectExpr("sys", "n", f"{spread('x')} + {spread('y')} AS g")
    return rows.groupBy("sys", "n").agg(tidy(F.sum("g"), 4).alias("gyration"))


GYRATION_SQL = """SELECT sys, n, round(sum(list_sum([e[1] * e[1] + e[2] * e[2] for e in cells]) / n
- pow(list_sum([e[1] for e in cells]) / n, 2) - pow(list_sum([e[2] for e in cells]) / n, 2)), 4) + 0.0 AS gyration
FROM forms GROUP BY sys, n"""

FILTERED = "SELECT sys, n, count(*) AS structures FROM forms WHERE {} GROUP BY sys, n"
CONTACTS = "list_sum([len([1 for f in cells if list_contains({}, [e[1] - f[1], e[2] - f[2]])]) for e in cells])"
QUERIES = {
    "polygen_triangles": (generated(tables.order_systems, 3), recursive(ORDER, "order", 3, COUNTS)),
    "polygen_triangles_4": (generated(tables.order_systems, 4), recursive(ORDER, "order", 4, COUNTS)),
    "polygen_squares": (generated(tables.talk_systems, 5), recursive(TALK, "talk", 5, COUNTS)),
    "polygen_hexagons": (generated(tables.day_systems, 3), recursive(DAY, "day", 3, COUNTS)),
    "polygen_cubes": (generated(tables.customer_systems, 3), recursive(CUSTOMER, "customer", 3, COUNTS)),
    "polygen_polyomino": (generated(polyomino, 4), recursive(ALIKE["square"], "talk", 4, COUNTS)),
    "polygen_polyiamond": (generated(polyiamond, 4), recursive(ALIKE["triangle"], "order", 4, COUNTS)),
    "polygen_polycube": (generated(polycube, 3), recursive(ALIKE["cube"], "customer", 3, COUNTS)),
    "polygen_coarse_labels": (generated(coarse, 4), recursive(COARSE_ORDER, "order", 4, COUNTS)),
    "polyenum_coarse_labels": (searched(coarse, 4), recursive(COARSE_ORDER, "order", 4, SEARCHED)),
    "polygen_site_rule": (generated(strict, 4), recursive(ORDER, "order", 4, COUNTS)),
    "polyenum_site_rule": (searched(strict, 4), recursive(ORDER, "order", 4, SEARCHED)),
    "polygen_renumbered": (generated(renumbered, 3), recursive(DAY, "day", 3, COUNTS)),
    "polyenum_renumbered": (searched(renumbered, 3), recursive(DAY, "day", 3, SEARCHED)),
    "polygen_mixed": (generated(mixed_systems, 4), None),
    "polyenum_triangles": (searched(tables.order_systems, 4), recursive(ORDER, "order", 4, SEARCHED)),
    "polyenum_squares": (searched(tables.talk_systems, 5), recursive(TALK, "talk", 5, SEARCHED)),
    "polyenum_hexagons": (searched(tables.day_systems, 3), recursive(DAY, "day", 3, SEARCHED)),
    "polyenum_cubes": (searched(tables.customer_systems, 3), recursive(CUSTOMER, "customer", 3, SEARCHED)),
    "polyenum_polyomino": (searched(polyomino, 4), recursive(ALIKE["square"], "talk", 4, SEARCHED)),
    "polyenum_mixed": (searched(mixed_systems, 4), None),
    "polyenum_reduce": (polyenum_reduce, recursive(DAY, "day", 3,
        "SELECT CAST(sum(len([1 for e in cells if e[4] = 1])) AS BIGINT) AS species_one_blocks FROM forms")),
    "polyenum_fold_systems": (polyenum_fold_systems, recursive(DAY, "day", 3,
        "SELECT sys, bit_xor(CAST(n * 8 + len([1 for e in cells if e[4] = 1]) AS BIGINT)) AS folded FROM forms GROUP BY sys")),
    "polyenum_collect": (polyenum_collect, recursive(DAY, "day", 3,
        FILTERED.format("len([1 for e in cells if e[4] = 2]) = 0"))),
    "polyenum_reject": (polyenum_reject, recursive(TALK, "talk", 4,
        FILTERED.format("len([1 for e in cells if e[4] = 1]) < 2"))),
    "polyenum_leaf": (polyenum_leaf, recursive(TALK, "talk", 4,
        "SELECT sys, n, count(*) AS structures FROM forms WHERE n <= sys % 3 + 1 GROUP BY sys, n")),
    "polyenum_stop": (polyenum_stop, recursive(TALK, "talk", 4, """
SELECT sys, n, count(*) AS structures
FROM (SELECT sys, n, min(CASE WHEN len([1 for e in cells if e[4] = 1]) > 1 THEN n END) OVER (PARTITION BY sys) AS last FROM forms)
WHERE n <= coalesce(last, n) GROUP BY sys, n""")),
    "polygen_max_strs_systems": (polygen_max_strs_systems, recursive(TALK, "talk", 4, """
SELECT sys, n, count(*) AS structures FROM (SELECT sys, n, row_number() OVER (ORDER BY n, sys) AS k FROM forms)
WHERE k <= 1000 OR n = 1 GROUP BY sys, n""")),
    "polygen_callback": (polygen_callback, recursive(DAY, "day", 3,
        f"SELECT sys, open_sites, count(*) AS structures FROM (SELECT sys, 6 * n - "
        f"{CONTACTS.format([list(s) for s in DAY.steps])} AS open_sites FROM forms) GROUP BY sys, open_sites")),
    "polygen_max_strs": (polygen_max_strs, recursive(TALK, "talk", 4,
        "SELECT greatest(count(*) FILTER (WHERE n = 1), least(count(*), 1000)) AS structures FROM forms")),
    "polygen_limit_each": (polygen_limit_each, recursive(DAY, "day", 3, """
SELECT sys, count(*) AS structures, max(n) AS largest FROM (SELECT sys, n, row_number() OVER (PARTITION BY sys ORDER BY n) AS k FROM forms)
WHERE k <= 25 OR n = 1 GROUP BY sys""")),
    "polyenum_limit_each": (polyenum_limit_each, recursive(ORDER, "order", 3, """
SELECT sys, n, count(*) AS structures FROM (SELECT sys, n, row_number() OVER (PARTITION BY sys ORDER BY n) AS k FROM forms)
WHERE k <= 40 GROUP BY sys, n""")),
    "polygen_turned_cubes": (generated(turned_cubes, 4), recursive(TurnedCubes(), "day", 4, COUNTS)),
    "polyenum_turned_cubes": (searched(turned_cubes, 3), recursive(TurnedCubes(), "day", 3, SEARCHED)),
    "open_bonds": (open_bonds, recursive(ORDER, "order", 1,
        "SELECT sys, si AS species, ti AS slot, lj AS partner_label FROM pairs")),
    "attach_candidates": (attach_candidates, recursive(ORDER, "order", 1, ATTACH_SQL)),
    "find_bonds": (find_bonds, find_bonds_sql()),
    "grow_step": (grow_step, recursive(ORDER, "order", 3,
        "SELECT sys, count(*) AS children FROM forms WHERE n = 3 GROUP BY sys")),
    "polyform_columns": (polyform_columns, recursive(CUSTOMER, "customer", 2,
        "SELECT sys, n, count(*) * n AS blocks, count(*) * n * 24 AS vertices, count(*) * (6 * n - 2 * (n - 1)) AS open_sites "
        "FROM forms GROUP BY sys, n")),
    "vertex_inverse": (vertex_inverse, recursive(CUSTOMER, "customer", 2, INVERSE_SQL)),
    "polyenum_fold_least": (polyenum_fold_least, recursive(DAY, "day", 3,
        "SELECT CAST(least(5, min(2 * n + 5)) AS BIGINT) AS least, CAST(max(2 * n + 5) AS BIGINT) AS largest, count(*) + 1 AS folded FROM forms")),
    "vertex_index": (vertex_index, recursive(CUSTOMER, "customer", 2, """
SELECT n, particle, site, (particle - 1) * 24 + site * 4 - 3 AS first, (particle - 1) * 24 + site * 4 AS last,
(particle - 1) * 24 + 1 AS block_first, particle * 24 AS block_last, structures
FROM (SELECT n, count(*) AS structures FROM forms GROUP BY n), range(1, 3) p(particle), range(1, 7) s(site)
WHERE particle <= n""")),
    "vertex_lookup": (vertex_lookup, recursive(TALK, "talk", 3, """
SELECT sys, n, (e[4] - 1) * 4 + site AS label, count(*) AS vertices
FROM (SELECT sys, n, unnest(cells) AS e FROM forms), range(1, 5) s(site) GROUP BY 1, 2, 3""")),
    "composition_species": (composition_species, recursive(TALK, "talk", 4, SPECIES_SQL)),
    "composition_bonds": (composition_bonds, recursive(TALK, "talk", 4, f""", {bond_rows_sql()}
SELECT t.sys, t.i AS label_i, t.j AS label_j, count(f.id) AS bonds
FROM (SELECT DISTINCT sys, li AS i, lj AS j FROM pairs WHERE li <= lj) t
LEFT JOIN found f ON f.sys = t.sys AND f.i = t.i AND f.j = t.j GROUP BY t.sys, t.i, t.j""")),
    "compositions": (compositions, recursive(TALK, "talk", 3, ", " + bond_rows_sql() + COMPOSITIONS_TAIL)),
    "canonical_key": (canonical_key, recursive(TALK, "talk", 4,
        "SELECT sys, n, count(*) AS structures, count(*) AS keys, count(*) AS hashes FROM forms GROUP BY sys, n")),
    "isomorphic_pairs": (isomorphic_pairs, recursive(TALK, "talk", 4, COUNTS)),
    "symmetry_number": (symmetry_number, recursive(DAY, "day", 3,
        f"SELECT sys, n, sigma, count(*) AS structures FROM (SELECT sys, n, {DAY.sigma()} AS sigma FROM forms) "
        "GROUP BY sys, n, sigma")),
    "canonical_parent": (canonical_parent, recursive(TALK, "talk", 4,
        "SELECT sys, n - 1 AS n, count(*) AS children FROM forms WHERE n > 1 GROUP BY sys, n")),
    "removable_particles": (removable_particles, removable_sql()),
    "structure_positions": (positions_query, recursive(TALK, "talk", 4, GYRATION_SQL)),
}
