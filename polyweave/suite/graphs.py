"""Graphs of the per-order systems: anatomy, equivalence, reachability, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.paths import connected_rows, simple_paths_rows
from ..operators.system_graph import graph_rows
from ..plans.enumerate import spread
from ..sources.systems import SystemCatalog
from ..sources.tables import order_systems
from .systems import ORDERS

GRAPH = f"""{ORDERS},
bonded AS (SELECT r.sys, i, j, 3 * n_species + row_number() OVER (PARTITION BY r.sys ORDER BY i, j) AS b
           FROM rules r JOIN top ON top.sys = r.sys WHERE i <= j),
edges AS (
  SELECT sys, (k - 1) * 3 + s AS src, (k - 1) * 3 + s % 3 + 1 AS dst
  FROM (SELECT sys, unnest(range(1, n_species + 1)) AS k FROM top), range(1, 4) r(s)
  UNION SELECT sys, i, b FROM bonded UNION SELECT sys, b, i FROM bonded
  UNION SELECT sys, j, b FROM bonded UNION SELECT sys, b, j FROM bonded)"""


def system_graph(spark, folder):
    return order_systems(spark, folder).anatomy()


def system_hash(spark, folder):
    """Every system with the smallest one it is equivalent to."""
    keys = order_systems(spark, folder).stored().rhash()
    firsts = keys.groupBy("system_key").agg(F.min("sys").alias("first_sys"))
    return keys.join(firsts, "system_key").select("sys", "first_sys")


def _hash_sql() -> str:
    from itertools import permutations
    images = []
    for order in permutations((0, 1, 2)):
        for code in range(27):
            for flip in (0, 1):
                turn = (code % 3, code // 3 % 3, code // 9)
                site = [order[k] * 3 + ((2 - s if flip else s) + turn[k]) % 3 + 1 for k in range(3) for s in range(3)]
                images.append((order, site))
    rows = ", ".join(f"({max([order[k] for k in range(3)][:n]) + 1 == n}, {n}, {site})"
                     for order, site in images for n in (1, 2, 3))
    return f"""WITH {ORDERS},
images AS (SELECT DISTINCT n, m[1:3 * n] AS m FROM (VALUES {rows}) v(fits, n, m) WHERE fits),
lists AS (SELECT r.sys, n_species, list(struct_pack(i := i, j := j)) AS rs FROM rules r JOIN top ON top.sys = r.sys
          WHERE i <= j GROUP BY r.sys, n_species),
keyed AS (SELECT sys, n_species, min(list_sort([least(m[r.i], m[r.j]) * 10 + greatest(m[r.i], m[r.j]) for r in rs])) AS key
          FROM lists JOIN images ON n = n_species GROUP BY sys, n_species)
SELECT sys, min(sys) OVER (PARTITION BY n_species, key) AS first_sys FROM keyed"""


def _by_rules(spark, folder, answers):
    """``answers`` (of ``graph_rows``, by ``graph``) for the system of every order; systems with the same rules have one graph."""
    catalog = order_systems(spark, folder).stored()
    lists = SystemCatalog(catalog.library, catalog.rows.groupBy("n_species", "rules").agg(F.min("sys").alias("sys"))).stored()
    dealt = SystemCatalog(catalog.library, spread(lists.rows, lists.rows.count()))
    found = answers(graph_rows(dealt).withColumnRenamed("sys", "graph")).withColumnRenamed("graph", "sys")
    named = lists.rows.join(found, "sys").drop("sys")
    return catalog.rows.select("sys", "n_species", "rules").join(named, ["n_species", "rules"]).drop("n_species", "rules")


def reachability(spark, folder):
    """Can site 1 reach every bond of its system without entering species 2?"""
    bonds = F.transform(F.sequence(F.lit(1), F.col("n_bonds")), lambda k: 3 * F.col("n_species") + k)
    walls = F.when(F.col("n_species") >= 2, F.array(F.lit(4), F.lit(5), F.lit(6))).otherwise(F.array().cast("array<int>"))
    return _by_rules(spark, folder, lambda rows: connected_rows(rows.select(
        "graph", "n_edges", "edges", F.lit(1).alias("start"), bonds.alias("targets"), walls.alias("forbidden"))))


REACH_SQL = f"""WITH RECURSIVE {GRAPH},
seen AS (SELECT sys, 1 AS v FROM top UNION
  SELECT e.sys, e.dst FROM seen JOIN edges e ON e.sys = seen.sys AND e.src = seen.v
  JOIN top ON top.sys = e.sys WHERE NOT (n_species >= 2 AND e.dst BETWEEN 4 AND 6))
SELECT b.sys, count(*) = count(seen.v) AS connected FROM bonded b LEFT JOIN seen ON seen.sys = b.sys AND seen.v = b.b
GROUP BY b.sys"""


def simple_path_counts(spark, folder):
    """Simple paths from site 1 of the first block to site 1 of the last."""
    def counts(rows):
        found = simple_paths_rows(rows.select("graph", F.lit(1).alias("v"), (3 * F.col("n_species") - 2).alias("w"), "n_edges", "edges"))
        return found.groupBy("graph").agg(F.count(F.lit(1)).alias("paths"), F.sum(F.size("path")).alias("vertices"))

    return _by_rules(spark, folder, counts)


PATHS_SQL = f"""WITH RECURSIVE {GRAPH},
walk(sys, v, w, path) AS (SELECT sys, CAST(1 AS BIGINT), CAST(3 * n_species - 2 AS BIGINT), [CAST(1 AS BIGINT)] FROM top
  UNION ALL SELECT e.sys, e.dst, w, list_append(path, e.dst) FROM walk JOIN edges e ON e.sys = walk.sys AND e.src = walk.v
  WHERE walk.v <> w AND NOT list_contains(path, e.dst))
SELECT sys, count(*) AS paths, sum(len(path)) AS vertices FROM walk WHERE v = w GROUP BY sys"""

QUERIES = {
    "system_graph": (system_graph, f"WITH {GRAPH} SELECT sys, src, dst FROM edges"),
    "system_hash": (system_hash, _hash_sql()),
    "reachability": (reachability, REACH_SQL),
    "simple_paths": (simple_path_counts, PATHS_SQL),
}
