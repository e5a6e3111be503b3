"""What structures are made of: species counts, bond-type counts, symmetry, parents.

All of it is row-local; only the summaries users put on top need a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..blocks import BlockLibrary
from ..sources.systems import PACK
from . import growth


def slot_label(library: BlockLibrary, slot: str, side: str = "label") -> str:
    """SQL: label (or colour) of a 0-based slot index expression of the row's structure."""
    m = library.stride
    if side == "label":
        offsets = ",".join(map(str, library.offsets))
        return f"CAST(array({offsets})[species[({slot}) DIV {m}] - 1] + ({slot}) % {m} + 1 AS SMALLINT)"
    rows = ",".join("array(" + ",".join(map(str, c + [0] * (m - len(c)))) + ")" for c in library.site_colors)
    return f"CAST(array({rows})[species[({slot}) DIV {m}] - 1][({slot}) % {m}] AS SMALLINT)"


def ordered_types(allowed: str) -> str:
    """SQL: allowed unordered pairs by larger, then smaller entry, from an ``allowed`` column.

    The packed pairs are sorted by their first entry; those with the smaller entry second are
    exactly the unordered pairs in the wanted order.
    """
    return (f"transform(filter({allowed}, r -> r % {PACK} <= r DIV {PACK}), r -> named_struct("
            f"'i', CAST(r % {PACK} AS SMALLINT), 'j', CAST(r DIV {PACK} AS SMALLINT)))")


def bonds_of(library: BlockLibrary, side: str = "label") -> str:
    """SQL: ``array<struct<i, j>>`` of the sites joined by each bond, smaller entry first."""
    a, b = slot_label(library, "s", side), slot_label(library, "partner[s] - 1", side)
    pair = f"named_struct('i', least({a}, {b}), 'j', greatest({a}, {b}))"
    return (f"transform(filter(sequence(0, size(partner) - 1), s -> partner[s] > s + 1), s -> {pair})")


def composition(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Add ``species_counts`` and ``bond_counts`` (one entry per allowed bond type).

    With look-alike sites, bonds are told apart by colours only; a bond then counts for the
    first allowed type of its colour pair.
    """
    blocks = f"transform(sequence(1, {library.n_species}), k -> size(filter(species, s -> s = k)))"
    df = structures.withColumn("species_counts", F.expr(blocks))
    types = ordered_types("allowed")
    if library.distinct_sites:
        return (df.selectExpr("*", f"explode(array(named_struct('t', {types}, 'b', {bonds_of(library)}))) AS v")
                .withColumn("bond_counts", F.expr("transform(v.t, t -> size(filter(v.b, b -> b = t)))")).drop("v"))
    color = "array(" + ",".join(str(c) for row in library.site_colors for c in row) + ")"
    seen = (f"transform({types}, t -> named_struct('i', CAST(least({color}[t.i - 1], {color}[t.j - 1]) AS SMALLINT), "
            f"'j', CAST(greatest({color}[t.i - 1], {color}[t.j - 1]) AS SMALLINT)))")
    df = df.selectExpr("*", f"explode(array(named_struct('t', {seen}, 'b', {bonds_of(library, 'color')}))) AS v")
    counts = "transform(v.t, (t, i) -> IF(array_position(v.t, t) = i + 1, size(filter(v.b, b -> b = t)), 0))"
    return df.withColumn("bond_counts", F.expr(counts)).drop("v")


def compositions(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """``composition``: species counts followed by bond-type counts, one row per structure."""
    return composition(structures, library).withColumn("composition", F.concat("species_counts", "bond_counts"))


def with_symmetry(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Add ``sigma``, the number of rotations that map a structure onto itself."""
    return structures.withColumn("sigma", growth.canonical(library, F.col("species"), F.col("partner"), key=False)["sigma"])


def with_key(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Add the exact binary ``key`` and its 64-bit ``rhash``; equal keys mean isomorphic."""
    named = structures.withColumn("key", growth.canonical(library, F.col("species"), F.col("partner"), key=True)["key"])
    return named.withColumn("rhash", F.xxhash64("key"))


def isomorphic(library: BlockLibrary, left: DataFrame, right: DataFrame, on=("sys",)) -> DataFrame:
    """Pairs of isomorphic rows of two collections: an equi-join on the exact key.

    The collections must hold each structure once per ``on`` value, as enumerations do.
    """
    a = with_key(left, library).select(*on, "key", F.struct(*left.columns).alias("left"))
    b = with_key(right, library).select(*on, "key", F.struct(*right.columns).alias("right"))
    return a.join(b, [*on, "key"])


def parents(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Replace each canonical structure by its canonical parent, named.

    The parent lacks the last block in canonical order.  That order is breadth-first, so the
    last block never separates the others and is always removable.
    """
    rest = [c for c in structures.columns if c not in ("species", "partner", "key", "n")]
    left = f"(size(species) - 1) * {library.stride}"
    cut = structures.where("size(species) > 0").selectExpr(
        *rest, "slice(species, 1, size(species) - 1) AS species",
        f"transform(slice(partner, 1, {left}), p -> CAST(IF(p > {left}, 0, p) AS SMALLINT)) AS partner")
    return growth.named(cut, library).withColumn("n", F.size("species"))


def removable_counts(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Add ``removable``: how many blocks can go without splitting the rest."""
    return structures.withColumn("removable", F.size(F.filter(
        growth.removable(library, F.col("species"), F.col("partner")), lambda r: r)))


def positions(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Add ``pose``: block positions and rotation quaternions in the frame of block 1."""
    return structures.withColumn("pose", growth.place(library, F.col("species"), F.col("partner")))
