"""Reachability and simple paths over many graphs at once, as iterated joins.

Edges are ``(graph, src, dst)``.  Work is keyed by (graph, vertex), never by graph alone, so
one very large graph is spread like any other data.  Each round is written to the shared
checkpoint folder to cut the lineage, and deleted when the rounds after it no longer read it.
Many small graphs need none of that: where a graph of at most ``SMALL`` edges is one row with its
edges, it is followed within the row, whole batches at a time, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.enumerate import checkpoint_folder, delete_folder

#: steps of a search made edge by edge before the part of the graph that is left is contracted; a round of that costs
#: about five such steps
PLAIN_STEPS = 12
#: share of the edges that a round of pruning has to remove for another one to be made
WORTH = 0.1
#: edges up to which a graph is followed within its row
SMALL = 128
#: paths that are grown at once within a task, rows whose paths are grown together, and vertices handed on at once
GROWN, WALKED, GIVEN = 50_000, 1_000, 2_000_000


class Rounds:
    """Numbered Parquet tables of an iteration."""

    def __init__(self, spark):
        self.spark, self.base, self.count = spark, checkpoint_folder(spark), 0
        self.schema = None

    def save(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` read back from the table of the next round, and its number of rows."""
        seen, path = Observation(), f"{self.base}/round={self.count}"
        self.count += 1
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(self.schema).parquet(path), seen.get["rows"]

    def forget(self) -> None:
        """Delete the table of the round before the last one."""
        delete_folder(self.spark, f"{self.base}/round={self.count - 2}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.base).parquet(self.base).select(
            *self.schema.names)

    def close(self) -> None:
        delete_folder(self.spark, self.base)


def _same_fate(edges: DataFrame, i: int) -> DataFrame:
    """``(graph, vertex, to)``: vertices that are reached if and only if ``to`` is, which stays.

    A vertex shares the fate of its only predecessor, and of a neighbour with edges both ways.  Of these it takes
    the one that comes first in the order of round ``i``, if that comes before itself, so that no cycles arise; up to
    four of such steps are followed, and who would have to go further stays for the next round.
    """
    def place(v):
        return F.struct(F.xxhash64(F.lit(i), v), F.col(v))

    single = (edges.groupBy("graph", F.col("dst").alias("vertex")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to"))
              .where("n = 1").select("graph", "vertex", "to"))
    both = (edges.groupBy("graph", F.least("src", "dst").alias("vertex"), F.greatest("src", "dst").alias("to"))
            .agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("graph", "vertex", "to"))
    either = both.unionByName(both.select("graph", F.col("to").alias("vertex"), F.col("vertex").alias("to")))
    moves = (single.unionByName(either).where(place("to") < place("vertex"))
             .groupBy("graph", "vertex").agg(F.min(place("to"))["to"].alias("to")))
    for _ in range(2):
        moves = moves.join(moves.select("graph", F.col("vertex").alias("to"), F.col("to").alias("next")), ["graph", "to"], "left") \
            .select("graph", "vertex", F.coalesce("next", "to").alias("to"))
    return moves.join(moves.select("graph", F.col("vertex").alias("to")), ["graph", "to"], "left_anti").select("graph", "vertex", "to")


def _relabelled(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``edges`` between the vertices that stay."""
    for end in ("src", "dst"):
        edges = edges.join(moves.select("graph", F.col("vertex").alias(end), "to"), ["graph", end], "left") \
            .withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.where("src <> dst").select("graph", "src", "dst").distinct()


def reachable(edges: DataFrame, starts: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """``(graph, vertex)`` reached from ``starts (graph, vertex)`` without entering ``forbidden``.

    The first ``PLAIN_STEPS`` steps follow the edges.  After them each round also contracts the part that is not
    reached yet, by vertices that share the fate of another: paths, trees and graphs with edges both ways shrink by a
    constant factor a round, so rounds grow with the logarithm of the distance there.  Graphs in which no vertex has such
    another take one round a step.  Rows with a null take no part.
    """
    spark = edges.sparkSession
    steps, fates, left = Rounds(spark), Rounds(spark), Rounds(spark)
    edges = edges.select("graph", "src", "dst").where("src <> dst").dropna().distinct()
    if forbidden is not None:
        edges = edges.join(forbidden.select("graph", F.col("vertex").alias("dst")), ["graph", "dst"], "left_anti")
    edges, _ = left.save(edges.select("graph", "src", "dst"))
    frontier, count = steps.save(starts.select("graph", "vertex").dropna().distinct())

    def entered():
        return edges.join(frontier.withColumnRenamed("vertex", "src"), ["graph", "src"], "left_semi").select("graph", F.col("dst").alias("vertex")).distinct()

    def without(vertices):
        return edges.join(vertices.withColumnRenamed("vertex", "dst"), ["graph", "dst"], "left_anti").select("graph", "src", "dst")

    while count and steps.count <= PLAIN_STEPS:
        frontier, count = steps.save(entered().join(steps.all(), ["graph", "vertex"], "left_anti"))
    if count:
        edges, _ = left.save(without(steps.all()))
        left.forget()
    while count:
        frontier, count = steps.save(entered())
        if not count:
            break
        edges = without(frontier)
        moves, moved = fates.save(_same_fate(edges, steps.count))
        edges, _ = left.save(_relabelled(edges, moves) if moved else edges)
        left.forget()
    seen, moves, depth = steps.all(), fates, 1
    if fates.count:  # a vertex moves once, to one that moves later or never: follow these moves, twice as far each time
        moves = fates.all()
        while depth < fates.count:
            moves = moves.join(moves.select("graph", F.col("vertex").alias("to"), F.col("to").alias("next")), ["graph", "to"], "left") \
                .select("graph", "vertex", F.coalesce("next", "to").alias("to"))
            depth *= 2
        seen = seen.unionByName(moves.join(seen.withColumnRenamed("vertex", "to"), ["graph", "to"], "left_semi").select("graph", "vertex"))
    found, _ = Rounds(spark).save(seen)
    for used in (steps, fates, left):
        used.close()
    return found


def connected(edges: DataFrame, starts: DataFrame, targets: DataFrame,
              forbidden: DataFrame | None = None) -> DataFrame:
    """``(graph, connected)``: every target is reached from the graph's start vertex.

    A graph without targets is not connected, and neither is one whose only target is the
    start when no other vertex can be entered: the test is made on entering a vertex.
    """
    seen = reachable(edges, starts, forbidden).withColumn("hit", F.lit(1))
    entered = seen.groupBy("graph").agg((F.count(F.lit(1)) > 1).alias("moved"))
    hits = targets.select("graph", "vertex").distinct().join(seen, ["graph", "vertex"], "left")
    all_hit = hits.groupBy("graph").agg((F.count(F.lit(1)) == F.count("hit")).alias("all_hit"))
    return (starts.select("graph").distinct().join(all_hit, "graph", "left").join(entered, "graph", "left")
            .select("graph", F.coalesce(F.col("all_hit") & F.col("moved"), F.lit(False)).alias("connected")))


def connected_rows(rows: DataFrame) -> DataFrame:
    """:func:`connected` of rows ``(graph, n_edges, edges, start, targets, forbidden)``, one for each graph.

    ``edges`` is an array of ``n_edges`` structs ``src, dst`` of whole numbers, ``targets`` and ``forbidden`` are arrays.  Graphs of more
    than ``SMALL`` edges go by joins.
    """
    own = rows.where(F.col("n_edges") <= SMALL)
    seen = arrow_udf(_reached_batch, "array<bigint>")("edges", F.col("start").cast("long"), F.col("forbidden").cast("array<bigint>"))
    all_hit = (F.size("targets") > 0) & (F.size(F.array_except(F.col("targets").cast("array<bigint>"), "seen")) == 0)
    found = own.withColumn("seen", seen).select("graph", (all_hit & (F.size("seen") > 1)).alias("connected"))
    rest = rows.where(F.col("n_edges") > SMALL)
    if rest.isEmpty():
        return found
    return found.unionByName(connected(
        rest.selectExpr("graph", "inline(edges)"), rest.select("graph", F.col("start").alias("vertex")),
        rest.select("graph", F.explode("targets").alias("vertex")), rest.select("graph", F.explode("forbidden").alias("vertex"))))


def simple_paths_rows(rows: DataFrame) -> DataFrame:
    """:func:`simple_paths` of rows ``(graph, v, w, n_edges, edges)``, with the edges as for :func:`connected_rows`."""
    kinds = T.StructType([rows.schema["graph"], T.StructField("path", T.ArrayType(rows.schema["v"].dataType))])
    names, types = kinds.names, [to_arrow_type(f.dataType) for f in kinds]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, WALKED):
                part = batch.slice(at, WALKED)
                for row, path in _paths_batch(*part.columns[1:]):
                    step = max(1, GIVEN // path.shape[1])
                    for low in range(0, len(row), step):
                        some = path[low:low + step]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * some.shape[1]), pa.array(some.ravel()))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[low:low + step])).cast(types[0]), lists.cast(types[1])], names)

    own = rows.where(F.col("n_edges") <= SMALL).select("graph", F.col("v").cast("long"), F.col("w").cast("long"), "edges")
    found = own.mapInArrow(run, kinds)
    rest = rows.where(F.col("n_edges") > SMALL)
    return found if rest.isEmpty() else found.unionByName(simple_paths(rest.selectExpr("graph", "inline(edges)"), rest.select("graph", "v", "w")))


def _flat_edges(edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every edge of a column of edge lists."""
    row = np.repeat(np.arange(len(edges)), np.diff(edges.offsets.to_numpy()))
    pairs = edges.flatten()
    src, dst = (pairs.field(f).cast(pa.int64()).to_numpy(zero_copy_only=False) for f in ("src", "dst"))
    return row, src, dst


def _numbered(row: np.ndarray, *vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rows and values of the different (row, vertex) pairs, in order, and the numbers of the given vertices among them."""
    values, at = np.unique(np.concatenate(vertices), return_inverse=True)
    codes, number = np.unique(np.concatenate([row] * len(vertices)) * max(len(values), 1) + at, return_inverse=True)
    return codes // max(len(values), 1), values[codes % max(len(values), 1)], np.split(number, len(vertices))


def _spread(mark: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
    """Mark all that is reached from marked vertices along the edges."""
    while len(src):
        on = mark[src] & ~mark[dst]
        if not on.any():
            return
        mark[dst[on]] = True
        left = ~mark[dst]
        src, dst = src[left], dst[left]


def _reached_batch(edges: pa.Array, start: pa.Array, forbidden: pa.Array) -> pa.Array:
    row, src, dst = _flat_edges(edges)
    start = start.to_numpy(zero_copy_only=False)
    all_rows = np.arange(len(start))
    walls = np.repeat(all_rows, np.diff(forbidden.offsets.to_numpy())), forbidden.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([row, all_rows, walls[0]]), np.concatenate([src, start, walls[1]]), np.concatenate([dst, start, walls[1]])
    of, value, (a, b) = _numbered(*ends)
    mark, wall = np.zeros(len(of), bool), np.zeros(len(of), bool)
    mark[a[len(row):len(row) + len(start)]] = True
    wall[a[len(row) + len(start):]] = True
    a, b = a[:len(row)], b[:len(row)]
    open_ = ~wall[b]
    _spread(mark, a[open_], b[open_])
    sizes = np.bincount(of[mark], minlength=len(start))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(value[mark], pa.int64()))


def _paths_batch(v: pa.Array, w: pa.Array, edges: pa.Array):
    """``(row, path)`` arrays of simple paths, those of one length together; at most ``GROWN`` are grown at once."""
    row, src, dst = _flat_edges(edges)
    v, w = v.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
    same = np.flatnonzero(v == w)
    if len(same):
        yield same, v[same][:, None]
    use = (src != dst) & (dst != v[row]) & (src != w[row])
    all_rows = np.arange(len(v))
    of, value, (a, b) = _numbered(np.concatenate([row[use], all_rows]), np.concatenate([src[use], v]), np.concatenate([dst[use], w]))
    n = int(use.sum())
    first, last, a, b = a[n:], b[n:], a[:n], b[:n]
    leads = np.zeros(len(of), bool)
    leads[last] = True
    _spread(leads, b, a)
    arcs = np.unique((a * len(of) + b)[leads[b]])
    a, b = np.divmod(arcs, max(len(of), 1))
    # a bit for each vertex that can be entered; there are no more of these than edges
    entered = np.unique(b)
    bit, word = np.zeros(len(of), np.uint64), np.zeros(len(of), np.int64)
    before = np.searchsorted(of[entered], of[entered], side="left")
    word[entered], place = np.divmod(np.arange(len(entered)) - before, 64)
    bit[entered] = np.uint64(1) << place.astype(np.uint64)
    begin, degree = np.searchsorted(a, np.arange(len(of))), np.bincount(a, minlength=len(of))
    apart = np.flatnonzero(v != w)
    open_ = [(first[apart][:, None], np.zeros((len(apart), int(word.max(initial=0)) + 1), np.uint64))]
    while open_:
        path, seen = open_.pop()
        if len(path) > GROWN:
            open_.append((path[GROWN:], seen[GROWN:]))
            path, seen = path[:GROWN], seen[:GROWN]
        here = path[:, -1]
        fan = degree[here]
        host = np.repeat(np.arange(len(path)), fan)
        to = b[np.repeat(begin[here] - np.cumsum(fan) + fan, fan) + np.arange(len(host))]
        free = (seen[host, word[to]] & bit[to]) == 0
        host, to = host[free], to[free]
        path, seen = np.concatenate([path[host], to[:, None]], axis=1), seen[host]
        seen[np.arange(len(to)), word[to]] |= bit[to]
        rows = of[to]
        done = to == last[rows]
        if done.any():
            yield rows[done], value[path[done]]
        if not done.all():
            open_.append((path[~done], seen[~done]))


def simple_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """All simple paths: ``(graph, path)`` for every ``(graph, v, w)`` of ``ends``.

    Only edges that may lie on such a path are followed: see :func:`_leading`.
    """
    spark = edges.sparkSession
    ends = ends.select("graph", "v", "w")
    steps, rounds = _leading(edges, ends), Rounds(spark)
    start = ends.select("graph", "v", "w", F.col("v").alias("at"), F.array("v").alias("path"),
                        (F.col("v") == F.col("w")).alias("done"))
    frontier, count = rounds.save(start)
    while count:
        grown = (frontier.where("NOT done").join(steps.withColumnRenamed("src", "at"), ["graph", "v", "w", "at"])
                 .where("NOT array_contains(path, dst)")
                 .select("graph", "v", "w", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"),
                         (F.col("dst") == F.col("w")).alias("done")))
        frontier, count = rounds.save(grown)
    return rounds.all().where("done").select("graph", "path")


def _leading(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``(graph, v, w, src, dst)``: the edges that a simple path from ``v`` to ``w`` may use.

    No path enters ``v`` or leaves ``w``; edges to vertices that ``w`` can't be reached from go, and then, again and
    again, edges that can only be gone back on, so that paths are not grown into dead ends of these kinds.
    """
    spark, pair = edges.sparkSession, ["graph", "v", "w"]
    kept = Rounds(spark)
    steps, _ = kept.save(edges.select("graph", "src", "dst").distinct().join(ends.distinct(), "graph")
                         .where("src <> dst AND dst <> v AND src <> w").select(*pair, "src", "dst"))
    named = steps.select(F.struct(*pair).alias("graph"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reachable(named, ends.select(F.struct(*pair).alias("graph"), F.col("w").alias("vertex")))
    useful = back.select("graph.*", F.col("vertex").alias("dst"))
    steps, count = kept.save(steps.join(useful, [*pair, "dst"], "left_semi").select(*pair, "src", "dst"))
    kept.forget()
    before = 2 * count
    while count < (1 - WORTH) * before:
        before = count
        for here, there, end in (("dst", "src", "w"), ("src", "dst", "v")):
            on = steps.groupBy(*pair, F.col(there).alias(here)).agg(F.min(here).alias("least"), F.max(here).alias("most"))
            # a path goes on from ``here`` (or came to it) by another vertex than the one at the other end
            steps = steps.join(on, [*pair, here], "left").where(f"{here} = {end} OR least <> {there} OR most <> {there}").select(*pair, "src", "dst")
        steps, count = kept.save(steps)
        kept.forget()
    return steps
