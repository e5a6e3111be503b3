"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, QUERY_EVERY, SCALE = 5, 50, 256
#: vectors of a block of candidates and of a block of queries; queries that are worked on at once
CANDIDATE_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 16384, 256
#: share of each sorted list that has been read after each round, and share of (query, candidate)
#: pairs that may be left to have their scores resolved one by one
DEPTHS, FEW = (0.25, 0.85, 1.0), 0.02
EXACT = float(1 << 53)


class SortedLists:
    """For each dimension of a block its values in order, read from either end.

    A query reads a list from the end that its own component favours.  After reading to some
    depth, an unread entry is at most the frontier times the component and at least the far end
    times it.  That bounds every candidate's score from what was read, without looking it up.
    """

    def __init__(self, block: np.ndarray):
        bound = np.abs(block).max(initial=0) if block.size else 0
        self.kind = np.float64 if float(bound) ** 2 * max(1, block.shape[1]) < EXACT else object
        self.block = block.astype(self.kind)
        order = np.sort(block, axis=0)
        self.rising, self.n = order.astype(self.kind), len(block)
        self.low, self.high = self.rising[0], self.rising[-1]

    def _bounds(self, rows, up, down, depth):
        """Lower and upper bounds of ``rows`` for queries split into positive and negative parts."""
        top, bottom = self.rising[self.n - depth], self.rising[depth - 1]
        upper = np.maximum(rows, top) @ up.T + np.minimum(rows, bottom) @ down.T
        lower = np.where(rows >= top, rows, self.low) @ up.T + np.where(rows <= bottom, rows, self.high) @ down.T
        return lower, upper

    def best(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
        """``(query position, candidate position, score)`` of the k best candidates of every query;
        ties go to the smaller id, and rows with the query's own id are left out."""
        queries = queries.astype(self.kind)
        if self.kind is not object and float(np.abs(queries).max(initial=0)) * float(np.abs(self.block).max(initial=0)) * max(1, queries.shape[1]) >= EXACT:
            self.kind, self.block, self.rising = object, self.block.astype(np.int64).astype(object), self.rising.astype(np.int64).astype(object)
            self.low, self.high, queries = self.rising[0], self.rising[-1], queries.astype(np.int64).astype(object)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], own, side) for side in ("left", "right"))
        for share in DEPTHS:  # read on, for all queries at once, while many candidates may still qualify
            lower, upper = self._bounds(self.block, up, down, max(1, int(self.n * share)))
            for q in np.flatnonzero(last > first):
                lower[order[first[q]:last[q]], q] = upper[order[first[q]:last[q]], q] = -np.inf
            live = (upper >= self._kth(lower, k)) & (upper > -np.inf)
            if live.mean() <= FEW:
                break
        out = []
        at, rows = np.nonzero(live.T)
        starts = np.searchsorted(at, np.arange(len(queries) + 1))
        for q in range(len(queries)):  # resolve the scores of those that are left
            left = rows[starts[q]:starts[q + 1]]
            final = self.block[left] @ queries[q]
            out += [(q, int(left[i]), int(final[i])) for i in np.lexsort((ids[left], -final))[:k]]
        return out

    @staticmethod
    def _kth(lower, k):
        """The k-th best lower bound of each query; all qualify while there are fewer candidates."""
        if len(lower) <= k:
            return np.full(lower.shape[1], -np.inf)
        return (np.sort(lower, axis=0) if lower.dtype == object else np.partition(lower, len(lower) - k, axis=0))[len(lower) - k]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as floor(scale * x), without vectors that are null or hold a
    null, NaN or infinite component.  Rows with a null id take no part either."""
    x = F.col(vector_col)
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, candidate_block: int = CANDIDATE_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other vectors by inner product.

    ``vectors`` and ``queries`` are ``(vec_id, v array<long>)``, queries with a row for each vec_id.  Ties go to the smaller vec_id; a
    query with fewer candidates gets them all.  vec_id names a vector: rows that repeat the
    query's own id are no candidates of it, other repeated rows count as often as they occur.
    Vectors of different length are not compared.  Scores outside of long are not defined.

    Candidates and queries are dealt into blocks whose number follows the row counts, so that a
    task holds one block of each.  Each pair of blocks reads the sorted lists of its candidates;
    k rows a query leave it, and a window keeps the best k.
    """
    n, m = vectors.count(), queries.count()
    over, across = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    row = F.xxhash64(F.monotonically_increasing_id())  # of the row as it is read, before any copy of it
    right = vectors.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(row, F.lit(over)).cast("int").alias("cb"))
    left = queries.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("qb"))
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("qb"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(over - 1))).alias("cb"))

    def matrix(table):
        values = table.column("v").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, np.int64)
        return flat.reshape(len(values), -1) if len(flat) else np.zeros((len(values), 0), np.int64)

    def search(asked, block):
        columns = [[], [], []]
        if len(asked) and len(block):
            ids, own = block.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            lists, wanted = SortedLists(matrix(block)), matrix(asked)
            for at in range(0, len(own), AT_ONCE):
                part = own[at:at + AT_ONCE]
                for q, c, score in lists.best(wanted[at:at + AT_ONCE], ids, part, k):
                    for column, value in zip(columns, (part[q], ids[c], score)):
                        column.append(int(value))
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    key = ["cb", "qb", "dims"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_rows(vectors: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0)
