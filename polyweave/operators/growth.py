"""Growing structures by one block: open sites x rules x block templates, contact test, naming.

All steps are narrow: the rules travel in the row, so open sites meet them without a join, and
the contact test works on the arrays of the row, so no pair of blocks is ever shuffled.  Spark
expands, filters and de-duplicates; two Arrow helpers do the vector geometry and the naming.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..blocks import BlockLibrary
from ..sources.systems import PACK, SystemCatalog, packed_colors, packed_rules
from . import arrow_helpers


# ---------------------------------------------------------------------- Arrow UDFs

def _udf(function, schema: str):
    def call(species: pa.Array, partner: pa.Array) -> pa.Array:
        return function(species, partner)
    return arrow_udf(call, schema)


def place(library: BlockLibrary, species, partner) -> Column:
    """Struct of pose component arrays of a canonical structure, block 1 at the origin."""
    schema = ", ".join(f"{n}: array<double>" for n in ("x", "y", "z", "qw", "qx", "qy", "qz"))
    return _udf(partial(arrow_helpers.place_batch, library.tables), f"struct<{schema}>")(species, partner)


def attach(library: BlockLibrary, species, partner, wanted, contact_rule: str = "color") -> Column:
    """Array of possible attachments of a structure, with everything each one touches."""
    tables, by_site = library.tables, contact_rule == "site"

    def call(species: pa.Array, partner: pa.Array, wanted: pa.Array) -> pa.Array:
        return arrow_helpers.attach_batch(tables, species, partner, wanted, by_site)
    touch = "array<struct<slot: smallint, here: smallint, there: smallint>>"
    return arrow_udf(call, "array<struct<slot: smallint, label_j: smallint, species_j: smallint, "
                           f"hit: array<smallint>, touch: {touch}>>")(species, partner, wanted)


def canonical(library: BlockLibrary, species, partner, key: bool | None = None, search: bool = False) -> Column:
    """Struct ``species, partner, sigma [, key] [, accepted, orbit]`` of the canonical form."""
    key = not library.exact_arrays if key is None else key
    schema = "species: array<smallint>, partner: array<smallint>, sigma: bigint"
    schema += ", key: binary" if key else ""
    schema += ", accepted: boolean, orbit: array<smallint>" if search else ""
    function = partial(arrow_helpers.canonical_batch, library.tables, with_key=key, with_search=search)
    return _udf(function, f"struct<{schema}>")(species, partner)


def removable(library: BlockLibrary, species, partner) -> Column:
    """``array<boolean>`` per block: deleting it leaves the others connected."""
    return _udf(partial(arrow_helpers.removable_batch, library.tables), "array<boolean>")(species, partner)


# --------------------------------------------------------------------------- level one

def monomers(catalog: SystemCatalog) -> DataFrame:
    """Level 1: every species of every system, all sites open, with its rule columns."""
    return single_blocks(rule_columns(catalog, catalog.rows), catalog.library)


def rule_columns(catalog: SystemCatalog, rows: DataFrame) -> DataFrame:
    """``rows`` with the packed rules that growth looks up, instead of ``rules``."""
    lib, rules = catalog.library, F.col("rules")
    if not lib.distinct_sites:
        rows = rows.withColumn("rules", F.when(treats_alike(lib, rules), rules).otherwise(F.raise_error(F.lit(
            "rules differ between look-alike sites: use an AssemblySystem, or a library split by these rules"))))
    cols = [packed_rules(rules).alias("allowed")]
    if judged_by(catalog) == "allowed_colors":
        cols.append(packed_colors(lib, rules).alias("allowed_colors"))
    return rows.select(*[c for c in rows.columns if c != "rules"], *cols)


def single_blocks(rows: DataFrame, library: BlockLibrary) -> DataFrame:
    """A row for each of the ``n_species`` blocks of each row."""
    open_sites = F.array_repeat(F.lit(0).cast("smallint"), library.stride)
    return (rows.withColumn("k", F.explode(F.sequence(F.lit(1), "n_species"))).drop("n_species")
            .withColumn("species", F.array(F.col("k").cast("smallint"))).drop("k")
            .withColumn("partner", open_sites))


# ------------------------------------------------------------------------ growth steps

def slot_labels(library: BlockLibrary, n: int) -> str:
    """SQL: site label of every slot of a size-n structure, 0 on padding."""
    m = library.stride
    sizes, offsets = (",".join(map(str, v)) for v in ([s.n_sites for s in library.shapes], library.offsets))
    return (f"transform(sequence(0, {n * m - 1}), s -> IF(s % {m} < array({sizes})[species[s DIV {m}] - 1], "
            f"array({offsets})[species[s DIV {m}] - 1] + s % {m} + 1, 0))")


def open_bonds(library: BlockLibrary, n: int) -> str:
    """SQL: all (slot, partner label) pairs of the open sites of a structure and its rules."""
    once = ""
    if not library.distinct_sites:  # labels of one symmetry class give the same structures: the least will do
        kind = "array(" + ",".join(map(str, library.label_classes())) + ")"
        once = (f" AND NOT exists(allowed, q -> q DIV {PACK} = l AND q % {PACK} < r % {PACK} "
                f"AND {kind}[q % {PACK} - 1] = {kind}[r % {PACK} - 1])")
    each = (f"transform(filter(allowed, r -> r DIV {PACK} = l{once}), "
            f"r -> named_struct('slot', CAST(i + 1 AS SMALLINT), 'label', CAST(r % {PACK} AS SMALLINT)))")
    none = "CAST(array() AS ARRAY<STRUCT<slot: SMALLINT, label: SMALLINT>>)"
    return f"flatten(transform({slot_labels(library, n)}, (l, i) -> IF(l > 0 AND partner[i] = 0, {each}, {none})))"


def candidates(frontier: DataFrame, library: BlockLibrary, n: int, contact_rule: str = "color") -> DataFrame:
    """One row per attachment without overlap: ``new`` holds slot, label, species and contacts."""
    wanted = frontier.selectExpr("*", f"{open_bonds(library, n)} AS wanted")
    return wanted.withColumn("new", F.explode(attach(library, "species", "partner", "wanted", contact_rule))).drop("wanted")


def judged_by(catalog: SystemCatalog) -> str:
    """The column that contacts are looked up in: pairs of site labels, or of face labels."""
    return "allowed" if catalog.contact_rule == "site" or catalog.library.plain_colors else "allowed_colors"


def permitted(catalog: SystemCatalog) -> str:
    """SQL: every face pair the new block makes is one the catalog's contact rule allows."""
    return f"NOT exists(new.touch, t -> NOT array_contains({judged_by(catalog)}, t.here * {PACK} + t.there))"


def treats_alike(library: BlockLibrary, rules: Column) -> Column:
    """Whether labels of one symmetry class have partners of the same classes."""
    kind = F.array(*[F.lit(c) for c in library.label_classes()])
    of = lambda label: F.element_at(kind, label.cast("int"))
    met = lambda label: F.array_sort(F.array_distinct(F.transform(
        F.filter(rules, lambda r: r["i"] == label), lambda r: of(r["j"]))))
    labels = F.array(*[F.lit(i) for i in range(1, library.n_labels + 1)])
    return F.forall(labels, lambda label: met(label) == met(of(label)))


def one_per_placement(library: BlockLibrary, once: str, n: int) -> str:
    """SQL: drop candidates that reach a placement another candidate of the row reaches too.

    ``"first"`` keeps the lowest touched slot, ``"orbit"`` one placement per symmetry class of
    the structure (lowest slot orbit, then lowest class of the touching site).  Only contacts
    that are candidates themselves count: a face label may allow contacts no rule starts from.
    Where blocks can be twisted a place may be filled in several orientations, each reached from a bond
    of its own; then all candidates stay and the callers keep different structures.
    """
    if library.twists:
        return "true"
    classes = "array(" + ",".join(map(str, library.label_classes())) + ")"
    offsets = "array(" + ",".join(map(str, library.offsets)) + ")"
    far = f"{classes}[{offsets}[new.species_j - 1] + new.hit[t.slot - 1] - 1]"
    touch = "new.touch"
    if not library.colors_are_classes:
        pairs = f"transform(allowed, r -> {classes}[r DIV {PACK} - 1] * {PACK} + {classes}[r % {PACK} - 1])"
        touch = f"filter(new.touch, t -> array_contains({pairs}, {classes}[{slot_labels(library, n)}[t.slot - 1] - 1] * {PACK} + {far}))"
    if once == "first":
        return f"{touch}[0].slot = new.slot" if library.distinct_sites else "true"
    least = f"array_min(transform({touch}, t -> named_struct('o', orbit[t.slot - 1], 'c', {far})))"
    return f"{least} = named_struct('o', new.slot, 'c', {classes}[new.label_j - 1])"


def assembled(chosen: DataFrame, library: BlockLibrary, n: int, names) -> DataFrame:
    """Write the new block and all its bonds into the arrays."""
    kept = f"zip_with(partner, new.hit, (p, g) -> CAST(IF(g > 0, g + {n * library.stride}, p) AS SMALLINT))"
    fresh = f"transform(sequence(1, {library.stride}), g -> CAST(array_position(new.hit, g) AS SMALLINT))"
    return chosen.selectExpr(*names, "concat(species, array(new.species_j)) AS species",
                             f"concat({kept}, {fresh}) AS partner")


def children(frontier: DataFrame, catalog: SystemCatalog, n: int, once: str = "first", keep=()) -> DataFrame:
    """All feasible one-block extensions ``(sys, species, partner)`` of size-``n`` structures, not yet canonical.

    ``frontier`` has the rule columns; children don't carry them, unless they are named in ``keep``.
    """
    lib = catalog.library
    chosen = candidates(frontier, lib, n, catalog.contact_rule).where(permitted(catalog)).where(one_per_placement(lib, once, n))
    return assembled(chosen, lib, n, ["sys", *keep])


def named(structures: DataFrame, library: BlockLibrary, search: bool = False) -> DataFrame:
    """Replace ``species, partner`` by the canonical form and add its other columns."""
    rest = [c for c in structures.columns if c not in ("species", "partner")]
    df = structures.select(*rest, canonical(library, F.col("species"), F.col("partner"), search=search).alias("c"))
    extra = [] if library.exact_arrays else ["key"]
    if search:
        # a generator instead of a filter: the named row is computed once and not pushed around
        df = df.select(*rest, F.explode(F.filter(F.array("c"), lambda c: c["accepted"])).alias("c"))
        extra.append("orbit")
    return df.select(*rest, "c.species", "c.partner", *[f"c.{e}" for e in extra])


def distinct_structures(structures: DataFrame, library: BlockLibrary) -> DataFrame:
    """Exact DISTINCT. The canonical arrays are the key, unless faces of cubes look alike."""
    if library.exact_arrays:
        return structures.distinct()
    return structures.dropDuplicates(["sys", "key"])
