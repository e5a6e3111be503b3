"""Binding-rule systems as DataFrames.

A :class:`SystemCatalog` holds any number of systems over one block library, one row each::

    sys BIGINT, n_species INT, rules ARRAY<STRUCT<i SMALLINT, j SMALLINT>>

``rules`` is the symmetric closure of the allowed label pairs, sorted.  It is bounded by the
square of the library's label count whatever the number of bond rows that produced it, and it
is built with one map-side-combining aggregation, so a system that owns most of the input rows
is reduced before anything is shuffled.  :class:`AssemblySystem` is the one-system catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..blocks import BlockLibrary, Shape
from .literal import literal_table

PAIR = "struct<i:smallint,j:smallint>"
BOND_COLUMNS = ("species_i", "site_i", "species_j", "site_j")


def _array_literal(values, kind: str) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast(f"array<{kind}>")


def label_of(library: BlockLibrary, species: Column, site: Column) -> Column:
    """Site label of (species, site); fails on a site the library does not have."""
    sizes = _array_literal([s.n_sites for s in library.shapes], "int")
    offsets = _array_literal(library.offsets, "int")
    known = species.between(1, library.n_species)
    at = F.when(known, species).otherwise(1).cast("int")
    known = known & site.between(1, F.element_at(sizes, at))
    label = F.element_at(offsets, at) + site
    return F.when(known, label).otherwise(
        F.raise_error(F.format_string("no site %s on species %s", site.cast("string"), species.cast("string")))
    ).cast("smallint")


def swapped(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))).cast(f"array<{PAIR}>")


class SystemCatalog:
    """Systems over one library.  ``contact_rule`` says which touching faces are allowed: with
    ``"color"`` those whose face labels belong to the two ends of some rule, with ``"site"``
    only those whose sites do.  New blocks are always attached by the rules of sites."""

    def __init__(self, library: BlockLibrary, rows: DataFrame, contact_rule: str = "color"):
        if contact_rule not in ("color", "site"):
            raise ValueError("the contact rule is 'color' or 'site'")
        self.library, self.rows, self.contact_rule = library, rows, contact_rule

    # ---------------------------------------------------------------- constructors

    @classmethod
    def from_bonds(cls, library: BlockLibrary, bonds: DataFrame, n_species: int | None = None,
                   contact_rule: str = "color") -> "SystemCatalog":
        """One system per ``sys`` from rows ``(sys, species_i, site_i, species_j, site_j)``.

        Without ``n_species`` a system has all species up to the largest one it mentions.
        """
        ends = bonds.select(
            "sys", F.greatest("species_i", "species_j").cast("int").alias("top"),
            F.struct(label_of(library, F.col("species_i"), F.col("site_i")).alias("i"),
                     label_of(library, F.col("species_j"), F.col("site_j")).alias("j")).alias("pair"))
        top = F.max("top") if n_species is None else F.lit(n_species)
        rows = (ends.groupBy("sys").agg(top.cast("int").alias("n_species"), F.collect_set("pair").alias("p"))
                .select("sys", "n_species", F.array_sort(F.array_union("p", swapped(F.col("p")))).alias("rules")))
        return cls(library, rows, contact_rule)

    @classmethod
    def from_pairs(cls, library: BlockLibrary, pairs: DataFrame, n_species: int | None = None) -> "SystemCatalog":
        """Matrix source: rows ``(sys, label_i, label_j)`` list the true entries.

        The matrix of every system must be symmetric; a job that meets another one fails.
        """
        known = F.col("label_i").between(1, library.n_labels) & F.col("label_j").between(1, library.n_labels)
        entry = F.when(known, F.struct(F.col("label_i").cast("smallint").alias("i"),
                                       F.col("label_j").cast("smallint").alias("j"))) \
            .otherwise(F.raise_error(F.lit("matrix entry outside the library")))
        rules = F.array_sort("p")
        checked = F.when(is_symmetric(F.col("p")), rules).otherwise(
            F.raise_error(F.lit("interaction matrix is not symmetric")))
        rows = (pairs.groupBy("sys").agg(F.collect_set(entry).alias("p"))
                .select("sys", F.lit(n_species or library.n_species).alias("n_species"), checked.alias("rules")))
        return cls(library, rows)

    # --------------------------------------------------------------------- tables

    def bond_rules(self) -> DataFrame:
        """Interaction matrix in long form, both directions: ``(sys, label_i, label_j)``."""
        return self.rows.select("sys", F.explode("rules").alias("r")).select(
            "sys", F.col("r.i").alias("label_i"), F.col("r.j").alias("label_j"))

    def sizes(self) -> DataFrame:
        """``(sys, n_species, n_edges)``; a bond of a site with itself counts once."""
        return self.rows.select("sys", "n_species", F.size(bond_types(F.col("rules"))).alias("n_edges"))

    def sites(self) -> DataFrame:
        """All sites of all systems: ``(sys, species, site, label, color)``."""
        species = self.rows.select("sys", F.explode(F.sequence(F.lit(1), "n_species")).alias("species"))
        return species.join(F.broadcast(site_table(self.spark, self.library)), "species").select(
            "sys", "species", "site", "label", "color")

    def stored(self) -> "SystemCatalog":
        """The same systems, written to the shared folder once, for uses that read them often."""
        from ..plans.enumerate import checkpoint_folder
        path = checkpoint_folder(self.spark)
        self.rows.write.parquet(path)
        return SystemCatalog(self.library, self.spark.read.schema(self.rows.schema).parquet(path), self.contact_rule)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def rhash(self) -> DataFrame:
        """``(sys, system_key)``, equal exactly for equivalent systems."""
        from ..operators.system_graph import system_keys
        return system_keys(self)

    def anatomy(self) -> DataFrame:
        from ..operators.system_graph import system_graph
        return system_graph(self)


class AssemblySystem(SystemCatalog):
    """One system of building blocks and binding rules.

    ``bonds`` is a list of ``[species_i, site_i, species_j, site_j]`` rows or a DataFrame with
    those columns; ``geometry`` is one shape for every species or a list with one per species.
    """

    def __init__(self, spark: SparkSession, bonds, geometry, face_labels=None, contact_rule: str = "color"):
        table = bond_table(spark, bonds)
        if isinstance(geometry, Shape):
            top = table.agg(F.max(F.greatest("species_i", "species_j"))).first()[0]
            if top is None:
                raise ValueError("without bonds the blocks must be listed one per species")
            geometry = [geometry] * int(top)
        library = BlockLibrary(geometry, face_labels)
        catalog = SystemCatalog.from_bonds(library, table.withColumn("sys", F.lit(0).cast("bigint")), library.n_species)
        self._set(library, _at_least_one(spark, catalog.rows, library.n_species), contact_rule)

    def _set(self, library: BlockLibrary, rows: DataFrame, contact_rule: str) -> None:
        """Look-alike sites that the rules tell apart are told apart in structures as well."""
        if not library.distinct_sites:
            rules = rows.first()["rules"]  # of one system: at most the squared number of labels
            library = library.split_by_rules([(r["i"], r["j"]) for r in rules])
        SystemCatalog.__init__(self, library, rows, contact_rule)

    @classmethod
    def from_matrix(cls, spark: SparkSession, matrix, geometries, face_labels=None, contact_rule: str = "color") -> "AssemblySystem":
        library = BlockLibrary(geometries, face_labels)
        size = len(matrix)
        if size != library.n_labels or any(len(row) != size for row in matrix):
            raise ValueError(f"the matrix must be {library.n_labels} x {library.n_labels}")
        pairs = [(0, i + 1, j + 1) for i in range(size) for j in range(size) if matrix[i][j]]
        table = literal_table(spark, pairs, "sys bigint, label_i int, label_j int")
        out = cls.__new__(cls)
        rows = SystemCatalog.from_pairs(library, table, library.n_species).rows
        out._set(library, _at_least_one(spark, rows, library.n_species), contact_rule)
        return out

    def size(self) -> tuple[int, int]:
        row = self.sizes().first()
        return row["n_species"], row["n_edges"]

    def __repr__(self) -> str:
        n, k = self.size()
        return f"AssemblySystem{{{self.library.dim}}}[n={n}, k={k}]"


def _at_least_one(spark: SparkSession, rows: DataFrame, n_species: int) -> DataFrame:
    """A system without any rule still has its blocks."""
    empty = spark.range(1).select(F.col("id").alias("sys"), F.lit(n_species).alias("n_species"),
                                  F.array().cast(f"array<{PAIR}>").alias("rules"))
    return empty.select("sys", "n_species").join(rows.select("sys", "rules"), "sys", "left").select(
        "sys", "n_species", F.coalesce("rules", F.array().cast(f"array<{PAIR}>")).alias("rules"))


def bond_table(spark: SparkSession, bonds) -> DataFrame:
    if isinstance(bonds, DataFrame):
        return bonds.select(*[F.col(c).cast("smallint").alias(c) for c in BOND_COLUMNS])
    return literal_table(spark, [tuple(int(v) for v in row) for row in bonds],
                         ", ".join(f"{c} smallint" for c in BOND_COLUMNS))


def bond_types(rules: Column) -> Column:
    """One entry per unordered allowed label pair, ordered by larger, then smaller label."""
    once = F.filter(rules, lambda r: r["i"] <= r["j"])
    return swapped(F.array_sort(swapped(once)))


def is_symmetric(pairs: Column) -> Column:
    return F.size(F.array_except(swapped(pairs), pairs)) == 0


def partners_by_label(library: BlockLibrary, rules: Column) -> Column:
    """``array<array<smallint>>``: allowed partner labels of label 1, 2, ..."""
    labels = _array_literal(range(1, library.n_labels + 1), "smallint")
    return F.transform(labels, lambda l: F.transform(F.filter(rules, lambda r: r["i"] == l), lambda r: r["j"]))


#: rules travel with every structure as packed pairs ``a * PACK + b``
PACK = 32768


def packed_rules(rules: Column) -> Column:
    return F.transform(rules, lambda r: r["i"].cast("int") * PACK + r["j"])


def packed_colors(library: BlockLibrary, rules: Column) -> Column:
    """Colour pairs that some rule allows to meet."""
    color = _array_literal([c for row in library.site_colors for c in row], "int")
    return F.array_sort(F.array_distinct(F.transform(rules, lambda r: F.element_at(color, r["i"].cast("int")) * PACK
                                                     + F.element_at(color, r["j"].cast("int")))))


SITE_SCHEMA = ("species int, site int, geom string, label smallint, color smallint, n_vertices int, "
               "p array<double>, ref array<double>, turn array<double>, r_min double, r_max double")


def site_table(spark: SparkSession, library: BlockLibrary) -> DataFrame:
    """Literal site table of the library (definition-sized), rotations in its dimension's form."""
    from ..functions.rotation import point, quat
    raw = literal_table(spark, [(a, b, g, l, c, v, [float(t) for t in p], [float(t) for t in r],
                                  [float(t) for t in d], lo, hi)
                                 for a, b, g, l, c, v, p, r, d, lo, hi in library.site_rows()], SITE_SCHEMA)
    as_quat = lambda name: quat(*[F.col(name)[i] for i in range(4)])
    return raw.select("species", "site", "geom", "label", "color", "n_vertices",
                      point(*[F.col("p")[i] for i in range(3)]).alias("x"),
                      as_quat("ref").alias("ref"), as_quat("turn").alias("turn"), "r_min", "r_max")
