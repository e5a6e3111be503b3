"""Sources, accessors and encoders of binding-rule systems, one system per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..blocks import HEXAGON, SQUARE, TRIANGLE, BlockLibrary
from ..oracle import source
from ..operators.growth import monomers
from ..sources.systems import SystemCatalog, label_of, partners_by_label, site_table
from ..sources.tables import order_bonds, order_systems, read

MIXED = BlockLibrary([TRIANGLE, SQUARE, HEXAGON])

ORDERS = f"""bonds AS ({source('order')}),
top AS (SELECT sys, max(greatest(species_i, species_j)) AS n_species FROM bonds GROUP BY sys),
ends AS (SELECT sys, (species_i - 1) * 3 + site_i AS i, (species_j - 1) * 3 + site_j AS j FROM bonds),
rules AS (SELECT sys, i, j FROM ends UNION SELECT sys, j, i FROM ends)"""


def assembly_system_sites(spark, folder):
    return order_systems(spark, folder).sites()


def n_species(spark, folder):
    return order_systems(spark, folder).rows.select("sys", "n_species")


def system_size(spark, folder):
    return order_systems(spark, folder).sizes()


def interaction_matrix(spark, folder):
    return order_systems(spark, folder).bond_rules()


def rule_symmetry_check(spark, folder):
    """Read the bonds as matrix entries and count those without a mirrored partner."""
    pair = F.struct(((F.col("species_i") - 1) * 3 + F.col("site_i")).alias("i"),
                    ((F.col("species_j") - 1) * 3 + F.col("site_j")).alias("j"))
    rows = order_bonds(spark, folder).groupBy("sys").agg(F.collect_set(pair).alias("p"))
    lonely = F.size(F.expr("filter(p, r -> NOT array_contains(p, named_struct('i', r.j, 'j', r.i)))"))
    return rows.select("sys", lonely.alias("unmatched"), (lonely == 0).alias("symmetric"))


def matrix_source(spark, folder):
    """Systems read as matrix entries, both directions of every bond; their rules again in long form."""
    library = BlockLibrary.uniform(TRIANGLE, 3)
    ends = order_bonds(spark, folder).select("sys", label_of(library, F.col("species_i"), F.col("site_i")).alias("label_i"),
                                             label_of(library, F.col("species_j"), F.col("site_j")).alias("label_j"))
    both = ends.unionByName(ends.select("sys", F.col("label_j").alias("label_i"), F.col("label_i").alias("label_j")))
    return SystemCatalog.from_pairs(library, both).bond_rules()


def site_to_label(spark, folder):
    """Labels of both bond ends in a library of differently shaped blocks."""
    bonds = order_bonds(spark, folder)
    return bonds.select("sys", label_of(MIXED, F.col("species_i"), F.col("site_i")).alias("label_i"),
                        label_of(MIXED, F.col("species_j"), F.col("site_j")).alias("label_j"))


def label_to_site(spark, folder):
    labels = read(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey",
                                                        "CAST(l_partkey % 13 + 1 AS SMALLINT) AS label")
    sites = site_table(spark, MIXED).select("label", "species", "site")
    return labels.join(F.broadcast(sites), "label").select("l_orderkey", "l_linenumber", "l_partkey", "label",
                                                           "species", "site")


def nth_match(spark, folder):
    """Second allowed partner of every site, and how many there are."""
    catalog = order_systems(spark, folder)
    rows = catalog.rows.select("sys", F.posexplode(partners_by_label(catalog.library, F.col("rules"))).alias("pos", "ps"))
    return rows.where("size(ps) > 0").selectExpr(
        "sys", "pos + 1 AS label", "try_element_at(ps, 2) AS second", "size(ps) AS matches")


def monomer_rows(spark, folder):
    return monomers(order_systems(spark, folder)).selectExpr(
        "sys", "species[0] AS species", "size(species) AS n", "size(filter(partner, p -> p = 0)) AS open_sites")


QUERIES = {
    "assembly_system_sites": (assembly_system_sites, f"""WITH {ORDERS}
SELECT sys, k AS species, s AS site, (k - 1) * 3 + s AS label, (k - 1) * 3 + s AS color
FROM (SELECT sys, unnest(range(1, n_species + 1)) AS k FROM top), range(1, 4) r(s)"""),
    "n_species": (n_species, f"WITH {ORDERS} SELECT sys, n_species FROM top"),
    "system_size": (system_size, f"""WITH {ORDERS}
SELECT top.sys, n_species, e.n AS n_edges FROM top
JOIN (SELECT sys, count(*) AS n FROM rules WHERE i <= j GROUP BY sys) e ON e.sys = top.sys"""),
    "interaction_matrix": (interaction_matrix,
                           f"WITH {ORDERS} SELECT sys, i AS label_i, j AS label_j FROM rules"),
    "matrix_source": (matrix_source,
                           f"WITH {ORDERS} SELECT sys, i AS label_i, j AS label_j FROM rules"),
    "rule_symmetry_check": (rule_symmetry_check, f"""WITH {ORDERS},
entries AS (SELECT DISTINCT sys, i, j FROM ends)
SELECT e.sys, count(*) FILTER (WHERE m.sys IS NULL) AS unmatched, count(*) = count(m.sys) AS symmetric
FROM entries e LEFT JOIN entries m ON m.sys = e.sys AND m.i = e.j AND m.j = e.i GROUP BY e.sys"""),
    "site_to_label": (site_to_label, f"""WITH {ORDERS}
SELECT sys, [0, 3, 7][species_i] + site_i AS label_i, [0, 3, 7][species_j] + site_j AS label_j FROM bonds"""),
    "label_to_site": (label_to_site, """SELECT l_orderkey, l_linenumber, l_partkey, label, species,
label - low AS site FROM (SELECT *, l_partkey % 13 + 1 AS label FROM lineitem) l
JOIN (VALUES (1, 0, 3), (2, 3, 7), (3, 7, 13)) v(species, low, high) ON label > low AND label <= high"""),
    "nth_match": (nth_match, f"""WITH {ORDERS}
SELECT sys, i AS label, max(CASE WHEN r = 2 THEN j END) AS second, count(*) AS matches
FROM (SELECT *, row_number() OVER (PARTITION BY sys, i ORDER BY j) AS r FROM rules) GROUP BY sys, i"""),
    "monomers": (monomer_rows, f"""WITH {ORDERS}
SELECT sys, unnest(range(1, n_species + 1)) AS species, 1 AS n, 3 AS open_sites FROM top"""),
}
