"""Enumeration drivers: level by level with a DISTINCT, and reverse search without one.

Both run one Spark job per size.  Each level is written once as Parquet under the shared
checkpoint folder, which cuts the lineage, survives lost executors, and is both the input of
the next level and part of the result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..operators import growth
from ..sources.systems import PACK, AssemblySystem, SystemCatalog

#: rows of a level one growth task should handle; growing costs far more than reading
ROWS_PER_TASK = 20_000
#: rows of rule lists and structures that one task takes along the edges, or ranks
ROWS_PER_STEP = 250_000
UNBOUNDED = None

KEEP, LEAF, DROP, STOP = 0, 1, 2, 3


def checkpoint_folder(spark: SparkSession) -> str:
    """New folder for level tables under the session's ``spark.checkpoint.dir``.

    Where executors are other processes that folder has to be one they all share, so it must be
    set.  A local session may leave it unset and gets a temporary folder that goes when it ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="polyweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/polyweave-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(rows: DataFrame, n_rows: int, *by: str) -> DataFrame:
    """``rows`` over as many tasks as their number asks for, those that agree in ``by`` together."""
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_STEP))
    return rows.repartition(wanted, *by) if n_rows > ROWS_PER_TASK else rows


@dataclass
class Enumeration:
    """Result of a run: the structures, their number, the largest size, and early-stop flag.

    ``close`` deletes the written levels; ``structures`` can't be read after that.
    """

    structures: DataFrame
    counts: dict
    stopped: bool = False
    folder: str | None = None
    rules: RuleDictionary | None = None
    shared: DataFrame | None = None

    def by_system(self, summary) -> DataFrame:
        """``summary`` of the structures, a table with a row or more for each ``sys``.

        It is made once for each different rule list, whose number then stands for ``sys``, and handed to the systems
        that have it, so it must not depend on the number itself; ``allowed`` is not given.  A run cut by ``max_strs``, which may end
        within systems of one list, is summarised system by system.
        """
        if self.shared is None:
            return summary(self.structures.drop("allowed"))
        return self.rules.handed(summary(self.shared))

    def close(self) -> None:
        if self.folder:
            delete_folder(self.structures.sparkSession, self.folder)

    @property
    def n_structures(self) -> int:
        return sum(self.counts.values())

    @property
    def largest(self) -> int:
        return max((n for n, c in self.counts.items() if c), default=0)


def spread(level: DataFrame, rows: int) -> DataFrame:
    """Give a level enough tasks for the compute-heavy growth that follows."""
    parallelism = level.sparkSession.sparkContext.defaultParallelism
    wanted = max(min(parallelism, -(-rows // 64)), -(-rows // ROWS_PER_TASK))
    return level.repartition(wanted) if wanted > 1 else level


#: bytes of a rule dictionary, and rows of a table of systems, that may be broadcast
BROADCAST_BYTES, BROADCAST_SYSTEMS = 48 << 20, 500_000


class RuleDictionary:
    """The different rule lists of a catalog, and the systems that share each.

    Structures carry only the number ``sys`` of their rule list and the number ``w`` of systems that have it.  A list is
    grown once, whatever the number of its systems; :meth:`of_systems` gives each of them its structures.  With
    ``shared=False`` every system is a list of its own.  The rules of a single system stand in the plan.
    """

    def __init__(self, catalog: SystemCatalog, base: str, shared: bool = True):
        self.catalog, self.literal, self.different = catalog, None, 1
        spark, rows = catalog.spark, growth.rule_columns(catalog, catalog.rows)
        self.columns = [c for c in rows.columns if c.startswith("allowed")]
        if isinstance(catalog, AssemblySystem):
            row = rows.first()
            self.number, self.literal = row["sys"], {c: F.array(*map(F.lit, row[c])).cast("array<int>") for c in self.columns}
            self.lists = spark.range(1).select(F.col("id").alias("sys"), F.lit(1).cast("long").alias("w"), F.lit(row["n_species"]).alias("n_species"))
            return
        for seed in range(8):
            name = F.xxhash64(F.lit(seed), "n_species", "allowed") if shared else F.col("sys")
            path = f"{base}/systems-{seed}"
            named = rows.withColumn("list", name)
            named.write.parquet(path)
            self.members = spark.read.schema(named.schema).parquet(path)
            if shared:
                lists = self.members.groupBy("list", "n_species", *self.columns).agg(F.count(F.lit(1)).alias("w"))
            else:
                lists = self.members.select("list", "n_species", *self.columns, F.lit(1).cast("long").alias("w"))
            lists = lists.withColumnRenamed("list", "sys")
            lists.write.parquet(f"{base}/rules-{seed}")
            self.lists = spark.read.schema(lists.schema).parquet(f"{base}/rules-{seed}")
            size = sum(F.size(c) for c in self.columns) * 4 + 64
            self.different, names, self.bytes, self.systems = self.lists.agg(F.count(F.lit(1)), F.count_distinct("sys"), F.sum(size), F.sum("w")).first()
            if self.different == names or not shared:  # else two lists have one number: name them anew
                return
        raise ValueError("rule lists could not be numbered")

    def blocks(self) -> DataFrame:
        """``(sys, w, species, partner)`` of the single blocks of every list."""
        return growth.single_blocks(self.lists.select("sys", "w", "n_species"), self.catalog.library)

    def attached(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` with the rule columns of its lists."""
        if self.literal:
            return frontier.withColumns(self.literal)
        lists = self.lists.select("sys", *self.columns)
        return frontier.join(F.broadcast(lists) if (self.bytes or 0) <= BROADCAST_BYTES else lists, "sys")

    def of_systems(self, structures: DataFrame) -> DataFrame:
        """The structures of each system, with its packed rules."""
        if self.literal:
            return structures.drop("w").withColumn("sys", F.lit(self.number)).withColumns({"allowed": self.literal["allowed"]})
        members = self.members.select("sys", "list", "allowed")
        members = F.broadcast(members) if self.systems and self.systems <= BROADCAST_SYSTEMS and self.bytes <= BROADCAST_BYTES else members
        return structures.drop("w").withColumnRenamed("sys", "list").join(members, "list").drop("list")

    def handed(self, values: DataFrame) -> DataFrame:
        """A table of the rule lists as one of the systems, with the same columns."""
        if self.literal:
            return values.withColumn("sys", F.lit(self.number))
        members = self.members.select(F.col("sys").alias("system"), F.col("list").alias("sys"))
        members = F.broadcast(members) if self.systems and self.systems <= BROADCAST_SYSTEMS else members
        return values.join(members, "sys").select(*[F.col("system").alias("sys") if c == "sys" else F.col(c) for c in values.columns])


#: different rule lists from which their structures are grown together; fewer take less time one by one
SHARED_LISTS = 2000
#: pairs of labels that the systems of a catalog may use together, to have their structures grown as one
UNION_PAIRS = 4096


class SharedShapes:
    """The different structures of all systems of a catalog, each placed, tested for contacts and named once.

    A structure belongs to a system if the rules allow its contacts, whatever else they allow.  So the structures of a
    size are grown under the rules of all systems together, and every growth step is an edge ``(parent, sid, need, touch)``
    with the bond it starts from and the contacts it makes.  The systems then walk along the edges with two numbers a
    row, the rule list and the structure, and one look at the list for each edge.
    """

    def __init__(self, rules: RuleDictionary, base: str, search: bool, seed: int = 0):
        self.rules, self.base, self.search, self.seed = rules, f"{base}/{seed}", search, seed
        self.catalog, self.library = rules.catalog, rules.catalog.library
        #: of edges that lead from one structure to another, one is enough only if contacts that may touch may also start
        self.one_edge = search and self.library.colors_are_classes and not self.library.twists
        self.total, self.exact = 0, ["species", "partner"] if self.library.exact_arrays else ["key"]
        self.pairs = [r[0] for r in rules.lists.select(F.explode("allowed")).distinct().limit(UNION_PAIRS + 1).collect()]

    @property
    def fits(self) -> bool:
        return len(self.pairs) <= UNION_PAIRS

    def united(self) -> dict:
        allowed = F.array(*map(F.lit, sorted(self.pairs))).cast("array<int>")
        if "allowed_colors" not in self.rules.columns:
            return {"allowed": allowed}
        color = [c for row in self.library.site_colors for c in row]
        colors = sorted({color[p // PACK - 1] * PACK + color[p % PACK - 1] for p in self.pairs})
        return {"allowed": allowed, "allowed_colors": F.array(*map(F.lit, colors)).cast("array<int>")}

    def written(self, df: DataFrame, name: str, n: int) -> tuple[DataFrame, int]:
        """``df`` read back from its table for size ``n``, and its number of rows."""
        path, seen = f"{self.base}/{name}/n={n}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]

    def numbered(self, named: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """``named`` with the number ``sid`` of each structure, and the different structures ``(sid, species, partner, ...)``.

        Numbers are hashes of the exact form; :meth:`unique` checks that no two structures of a size have the same one.
        """
        rows, self.steps = self.written(named.withColumn("sid", F.xxhash64(F.lit(self.seed), *self.exact)), "grown", n)
        own = rows.select("sid", *[c for c in ("species", "partner", "key", "orbit") if c in rows.columns])
        shapes, self.count = self.written(own.distinct() if self.library.exact_arrays else own.dropDuplicates(["sid", "key"]), "shapes", n)
        self.total += self.count
        return rows, shapes

    def unique(self, kept: DataFrame) -> bool:
        return not kept.groupBy("n", "sid").count().where("count > 1").take(1)

    def first(self) -> tuple[DataFrame, DataFrame]:
        """``(sys, w, sid)`` of the single blocks of every list, and the blocks."""
        blocks = self.rules.blocks()
        if self.search or not self.library.exact_arrays:
            blocks = growth.named(blocks, self.library, self.search)
        rows, shapes = self.numbered(blocks, 1)
        return rows.select("sys", "w", "sid"), shapes

    def edges(self, shapes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The growth steps from the structures of size ``n``, and the structures they lead to."""
        lib, catalog, parents = self.library, self.catalog, self.count
        rows = growth.candidates(spread(shapes, self.count).drop("key").withColumns(self.united()), lib, n, catalog.contact_rule)
        rows = rows.where(growth.permitted(catalog))
        if self.one_edge:
            rows = rows.where(growth.one_per_placement(lib, "orbit", n))
        label = f"{growth.slot_labels(lib, n)}[new.slot - 1]"
        rows = rows.selectExpr("*", f"CAST({label} * {PACK} + new.label_j AS INT) AS need",
                               f"array_sort(array_distinct(transform(new.touch, t -> CAST(t.here * {PACK} + t.there AS INT)))) AS contacts")
        grown = growth.assembled(rows.withColumnRenamed("sid", "parent"), lib, n, ["parent", "need", "contacts"])
        rows, found = self.numbered(growth.named(grown, lib, self.search), n + 1)
        self.fan = -(-self.steps // max(1, parents))
        return rows.select("parent", "sid", "need", "contacts").distinct(), found

    def step(self, frontier: DataFrame, edges: DataFrame, n: int, n_rows: int) -> DataFrame:
        """The rows ``(sys, w, sid)`` that the lists of ``frontier``, which has up to ``n_rows`` rows, allow.

        A row leads to a number of rows that the library bounds.  So tasks of so many rows need memory of one size, whatever the
        number of lists.  A list has at most all structures of a size; unless these are many, its rows meet in one task, and
        are made different there without another exchange.
        """
        together = self.count <= ROWS_PER_STEP
        frontier = dealt(frontier, n_rows, *["sys"] * together)
        judged = growth.judged_by(self.catalog)
        small = self.steps * 64 <= BROADCAST_BYTES
        steps = self.rules.attached(frontier).withColumnRenamed("sid", "parent").join(F.broadcast(edges) if small else edges, "parent")
        fits = F.expr(f"array_contains(allowed, need) AND forall(contacts, c -> array_contains({judged}, c))")
        rows = steps.where(fits).select("sys", "w", "sid")
        if self.one_edge:
            return rows
        return (rows if together else dealt(rows, n_rows * self.fan, "sys", "sid")).distinct()


def _unfinished(frontier: DataFrame, levels: str, schema: T.StructType, each: int | None) -> DataFrame:
    """``frontier`` without the systems (or rule lists) that have ``each`` structures in the written levels already."""
    if each is None:
        return frontier
    rows = frontier.sparkSession.read.schema(schema).option("basePath", levels).parquet(levels)
    done = rows.groupBy("sys").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= each).select("sys")
    return frontier.join(done, "sys", "left_anti")


def _shared_levels(shapes: SharedShapes, max_size: int | None, max_strs: int | None, each: int | None = None) -> tuple[DataFrame, dict, bool] | None:
    """``(sys, n, species, partner, ...)`` of all rule lists, the number of structures of all systems by size,
    and whether ``max_strs`` ended it.  None if two structures got the same number."""
    base, spark, counts, n, stopped = f"{shapes.base}/levels", shapes.catalog.spark, {}, 1, False
    level, found = shapes.first()
    sizes = F.lit(1).alias("n")
    kept = found.drop("orbit").select("*", sizes)
    while True:
        seen = Observation()
        level.observe(seen, F.sum("w").alias("structures"), F.count(F.lit(1)).alias("rows")).write.parquet(f"{base}/n={n}")
        got = seen.get
        counts[n] = got["structures"] or 0
        if max_strs is not None and sum(counts.values()) >= max_strs and (shapes.search or got["rows"]):
            stopped = True
            break
        if not got["rows"] or (max_size is not None and n >= max_size):
            break
        edges, found = shapes.edges(found, n)
        frontier = _unfinished(spark.read.schema(level.schema).parquet(f"{base}/n={n}"), base, level.schema, each)
        level = shapes.step(frontier, edges, n, got["rows"])
        n += 1
        kept = kept.unionByName(found.drop("orbit").select("*", F.lit(n).alias("n")))
    schema = T.StructType([*level.schema.fields, T.StructField("n", T.IntegerType())])
    levels = spark.read.schema(schema).option("basePath", base).parquet(base)
    if not shapes.unique(kept):
        return None
    small = shapes.total <= BROADCAST_SYSTEMS // 4
    return levels.join(F.broadcast(kept) if small else kept, ["n", "sid"]).drop("sid"), counts, stopped


def enumerate_levels(catalog: SystemCatalog, strategy: str, max_size: int | None = None,
                     max_strs: int | None = None, rejector=None, each_system: int | None = None) -> Enumeration:
    """Grow sizes 1, 2, ... until nothing is left or a limit is hit.

    ``rejector`` maps a DataFrame of structures to an integer column: 0 keep, 1 keep but do
    not grow, 2 drop, 3 keep and grow no more of its system after this size; other systems go on.  ``max_strs`` counts the structures of all systems together,
    ``each_system`` those of every system by itself: a system that has as many grows no further, and the smallest of its
    structures stay, those of one size in order of their canonical arrays.  In a catalog systems with the same rules are grown once and
    structures that several systems have are placed and named once, see ``SharedShapes``; not with a rejector,
    which may look at ``sys``, nor with very many different rules.
    """
    spark, lib = catalog.spark, catalog.library
    search = strategy == "reverse_search"
    base = checkpoint_folder(spark)
    rules = RuleDictionary(catalog, base, shared=rejector is None)
    if rejector is None and rules.different > SHARED_LISTS:
        for seed in range(8):
            shapes = SharedShapes(rules, base, search, seed)
            found = _shared_levels(shapes, max_size, max_strs, each_system) if shapes.fits else None
            if found:
                return _result(rules, *found, base, max_strs, search, each_system)
            if not shapes.fits:
                break
    counts, schema, stopped, n = {}, None, False, 1
    levels = f"{base}/levels"
    level = rules.blocks()
    if search or not lib.exact_arrays:
        level = growth.named(level, lib, search)
    while True:
        if rejector is not None:
            sized = rules.attached(level).withColumn("n", F.lit(n))
            level = sized.withColumn("verdict", rejector(sized)).where(F.col("verdict") != DROP).drop("n", *rules.columns)
        else:
            level = level.withColumn("verdict", F.lit(KEEP))
        seen = Observation()
        level = level.observe(seen, F.sum("w").alias("structures"), F.max("verdict").alias("worst"),
                              F.count(F.when(F.col("verdict") == KEEP, 1)).alias("growing"))
        path = f"{levels}/n={n}"
        level.write.parquet(path)
        schema = schema or level.schema
        got = seen.get
        counts[n] = got["structures"] or 0
        total = sum(counts.values())
        ends = (got["worst"] or 0) >= STOP
        stopped = stopped or ends
        if max_strs is not None and total >= max_strs and (search or got["growing"]):
            stopped = True
            break
        if not got["growing"] or (ends and rules.literal) or (max_size is not None and n >= max_size):
            break
        written = spark.read.schema(schema).parquet(path)
        frontier = written.where(F.col("verdict") == KEEP).drop("verdict", "key")
        if ends:
            frontier = frontier.join(written.where(F.col("verdict") == STOP).select("sys").distinct(), "sys", "left_anti")
        frontier = rules.attached(spread(_unfinished(frontier, levels, schema, each_system), got["growing"]))
        level = growth.named(growth.children(frontier, catalog, n, once="orbit" if search else "first", keep=["w"]), lib, search)
        if not search or lib.twists:
            level = growth.distinct_structures(level, lib)
        n += 1
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("n", T.IntegerType())])).option("basePath", levels).parquet(levels)
    return _result(rules, stored, counts, stopped, base, max_strs, search, each_system)


def _result(rules: RuleDictionary, stored: DataFrame, counts: dict, stopped: bool, base: str, max_strs: int | None, search: bool,
            each: int | None = None) -> Enumeration:
    key = [] if rules.catalog.library.exact_arrays else ["key"]
    columns = ["n", "species", "partner", *key]
    if each is not None:  # systems with the same rules have the same structures, so lists are cut
        order = Window.partitionBy("sys").orderBy("n", "species", "partner")
        blocks = 0 if search else rules.catalog.library.n_species  # generation always returns the blocks
        ranked = dealt(stored.select("sys", "w", *columns), sum(counts.values()), "sys")
        ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(each, blocks))
        ranked = ranked.where((F.col("place") <= each) | (F.lit(not search) & (F.col("n") == 1))).drop("place")
        ranked.write.parquet(f"{base}/first")
        stored = ranked.sparkSession.read.schema(ranked.schema).parquet(f"{base}/first")
        counts = {r["n"]: r["structures"] for r in stored.groupBy("n").agg(F.sum("w").alias("structures")).collect()}
    result, shared = rules.of_systems(stored.select("sys", *columns)).select("sys", "n", "species", "partner", "allowed", *key), stored.select("sys", *columns)
    if max_strs is not None and sum(counts.values()) > max_strs:
        result, counts = _first_by_size(result, counts, max_strs, at_least=0 if search else counts[1])
        shared = None
    return Enumeration(result, counts, stopped, base, rules, shared)


def _first_by_size(result: DataFrame, counts: dict, max_strs: int, at_least: int):
    """The limit feature: whole smaller sizes, then the first structures, in order of system and canonical
    arrays, of the size that crosses the limit."""
    room, kept, parts = max(max_strs, at_least), {}, []
    for n, c in sorted(counts.items()):
        take = min(c, room)
        room -= take
        if take:
            kept[n] = take
            rows = result.where(F.col("n") == n)
            parts.append(rows if take == c else rows.orderBy("sys", "species", "partner").limit(take))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, kept


# ----------------------------------------------------------------------- public calls

def polygen(catalog: SystemCatalog, callback=None, max_size: int | None = UNBOUNDED,
            max_strs: int | None = UNBOUNDED, each_system: int | None = UNBOUNDED, summary=None) -> DataFrame:
    """All structures as a DataFrame ``(sys, n, species, partner, ...)``, blocks first.

    ``callback`` maps the DataFrame of structures to the DataFrame to return.  The blocks are
    always part of the result, whatever the limits.  For a catalog ``max_strs`` counts the
    structures of all its systems together and ``each_system`` those of each.  With ``summary``
    the result is :meth:`Enumeration.by_system` of it.
    """
    bound = max(max_size, 1) if max_size is not None else None
    run = enumerate_levels(catalog, "levels", bound, max_strs, each_system=each_system)
    if summary:
        return run.by_system(summary)
    return callback(run.structures) if callback else run.structures


@dataclass
class Summary:
    """``polyenum`` outcome; ``reduced`` / ``collected`` are set when callbacks were given."""

    n_structures: int
    largest: int
    reduced: object = None
    collected: DataFrame | None = None
    broke: bool = False
    structures: DataFrame | None = None
    run: Enumeration | None = None

    def close(self) -> None:
        """Delete the written levels, once nothing more is read from the result."""
        self.run.close()

    def __iter__(self):
        return iter((self.n_structures, self.largest))

    def __getitem__(self, i):
        return (self.n_structures, self.largest)[i]


FOLDS = {"+": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "*": F.product,
         "and": F.bool_and, "or": F.bool_or}


def polyenum(catalog: SystemCatalog, max_size: int | None = None, max_strs: int | None = None,
             reducer=None, reduce_op="+", aggregator=None, rejector=None, fold_by: tuple | None = None,
             each_system: int | None = None, fold_lists: bool = False) -> Summary:
    """Count, fold, filter and collect structures by reverse search.

    * ``reducer(df)`` gives the column to fold with ``reduce_op`` (a name in ``FOLDS`` or an
      associative, commutative Python function); its value on the empty structure is the start.  With ``fold_by``,
      ``()`` or ``("sys",)``, ``reduced`` is the table of :func:`fold_table` instead of one value.  With ``fold_lists`` the reducer does
      not look at ``sys`` or ``allowed``, and the fold by system is made once for each different rule list.
    * ``aggregator(df)`` gives ``(keep, value)`` columns; kept values are collected.
    * ``rejector(df)`` gives the code 0, 1, 2 or 3 (see :func:`enumerate_levels`).

    Limits of 0 or None mean no limit.
    """
    run = enumerate_levels(catalog, "reverse_search", max_size or None, max_strs or None, rejector, each_system or None)
    out = Summary(run.n_structures, run.largest, broke=run.stopped, structures=run.structures, run=run)
    if reducer is not None:
        if fold_lists and fold_by == ("sys",):
            table = run.by_system(lambda found: fold_table(found, reducer, reduce_op, fold_by))
        else:
            table = fold_table(run.structures, reducer, reduce_op, fold_by or ())
        out.reduced = table if fold_by is not None else table.first()["value"]
    if aggregator is not None:
        keep, value = aggregator(run.structures)
        out.collected = run.structures.where(keep).select("sys", value.alias("value"))
    return out


def with_empty(structures: DataFrame, by: tuple = ()) -> DataFrame:
    """Add the empty structure, on which every fold starts; with ``by`` the one of each group."""
    cols = [F.col(f.name) if f.name in by else F.lit(0).cast(f.dataType).alias(f.name) if f.name in ("sys", "n")
            else F.array().cast(f.dataType).alias(f.name) if f.dataType.typeName() == "array"
            else F.lit(None).cast(f.dataType).alias(f.name) for f in structures.schema]
    groups = structures.select(*by).distinct() if by else structures.sparkSession.range(1)
    return structures.unionByName(groups.select(*cols))


#: groups whose values a task holds before it hands them on
FOLDED = 100_000


def fold_table(structures: DataFrame, reducer, reduce_op="+", by: tuple = ("sys",)) -> DataFrame:
    """``(*by, value)``: the fold over all structures (``by=()``, one row) or over those of each system.

    A named fold is an aggregation.  Any other associative, commutative function first folds the rows of each task by
    group, at most ``FOLDED`` of them at a time, and then the partial values of each group, group after group.  Equal whole
    numbers of a group are counted before and folded by doubling.
    """
    whole = with_empty(structures, by)
    values = whole.select(*by, reducer(whole).alias("value"))
    if isinstance(reduce_op, str):
        return values.groupBy(*by).agg(FOLDS[reduce_op]("value").alias("value"))
    schema = values.schema
    kinds, names = [to_arrow_type(f.dataType) for f in schema], values.columns
    counted = isinstance(schema["value"].dataType, T.IntegralType)
    if counted:
        values = values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("times"))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def of_times(value, times):
        out = None
        while times:
            if times & 1:
                out = value if out is None else reduce_op(out, value)
            times >>= 1
            if times:
                value = reduce_op(value, value)
        return out

    def folded(held, columns):
        for *k, v in zip(*columns):
            k = tuple(k)
            held[k] = reduce_op(held[k], v) if k in held else v
        return held

    def part(batches):
        held = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if counted:
                times = columns.pop()
                columns[-1] = [of_times(v, n) if n > 1 else v for v, n in zip(columns[-1], times)]
            if len(folded(held, columns)) > FOLDED:
                yield table([(*k, v) for k, v in held.items()])
                held = {}
        if held:
            yield table([(*k, v) for k, v in held.items()])

    def total(batches):
        held = {}
        for batch in batches:
            folded(held, [c.to_pylist() for c in batch.columns])
            *done, last = held or [None]
            if done:
                yield table([(*k, held[k]) for k in done])
                held = {last: held[last]}
        if held:
            yield table([(*k, v) for k, v in held.items()])

    parts = values.mapInArrow(part, schema)
    parts = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.repartition(1)
    return parts.mapInArrow(total, schema)


def counts_by_size(structures: DataFrame, *extra: Column) -> DataFrame:
    return structures.groupBy("sys", "n", *extra).agg(F.count(F.lit(1)).alias("structures"))
