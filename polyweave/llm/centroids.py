"""Exact integer k-means whose far centroids are filtered out in PCA-rotated coordinates."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .topk import usable

CLUSTERS, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
#: rotated coordinates that are stored with a vector; the others are stored as one norm
LEADING = 16
#: components below this have squared distances far inside 64 bits; others are worked on as Python integers
PLAIN = 1 << 25
LARGEST = (1 << 63) - 1


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _exact(v: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``v``, as Python integers if 64 bits might not hold its squared distances."""
    small = all(not x.size or (x.min() > -PLAIN and x.max() < PLAIN) for x in (v, *others))
    return v if small else v.astype(object)


# ------------------------------------------------------------------------------- rotation

@dataclass
class Rotation:
    """Orthonormal axes in order of falling variance around the mean of all vectors."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading rotated coordinates, and the norm of what they leave out."""
        turned = (v.astype(np.float64) - self.mean) @ self.axes
        return turned[:, :self.leading], np.sqrt((turned[:, self.leading:] ** 2).sum(1))


def fit_rotation(rows: DataFrame, dims: int = DIMS, leading: int = LEADING) -> Rotation:
    """Principal axes from the sums of components and of their products over all rows.

    Every task adds up its rows; ``dims * (dims + 1) + 1`` numbers are summed by position and sent to the driver.
    """
    def run(batches):
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, dims + 1))
            x[:, 1:] = _matrix(batch.column(0), np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    sums = np.zeros((dims + 1) ** 2)
    for at, x in rows.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
        sums[at] = x
    sums = sums.reshape(dims + 1, dims + 1)
    n = max(1.0, sums[0, 0])
    mean = sums[0, 1:] / n
    _, axes = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, axes[:, ::-1], min(leading, dims))


# ----------------------------------------------------------------------------- assignment

class Centroids:
    """Integer centroids with their rotated coordinates."""

    def __init__(self, points: list[list[int]], rotation: Rotation):
        self.points = np.array(points, np.int64).reshape(len(points), len(rotation.mean))
        self.lead, self.rest = rotation(self.points)

    def nearest(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of every row and the squared distance, exactly; and how
        many distances were computed in full.

        The projected distance and the squared difference of the residual norms add up to a lower bound.  The
        centroid of the least bound is measured in integers, and so is each other whose bound,
        less what rounding can add to it, does not exceed the least distance found so far.
        """
        n, k = len(v), len(self.points)
        size = (lead ** 2).sum(1) + rest ** 2
        own = (self.lead ** 2).sum(1) + self.rest ** 2
        bound = size[:, None] + own - 2 * (lead @ self.lead.T + np.outer(rest, self.rest))
        bound -= 1e-9 * (size[:, None] + own) + 1e-6
        exact, points = _exact(v, self.points), self.points.astype(object)
        plain = exact.dtype != object
        points = self.points if plain else points
        first = bound.argmin(1) if n else np.zeros(0, np.int64)
        best, at, measured = ((exact - points[first]) ** 2).sum(1), first.copy(), n
        for c in range(k):
            rows = np.flatnonzero((bound[:, c] <= best.astype(np.float64)) & (first != c))
            if not len(rows):
                continue
            measured += len(rows)
            found = ((exact[rows] - points[c]) ** 2).sum(1)
            better = (found < best[rows]) | ((found == best[rows]) & (c < at[rows]))
            best[rows[better]], at[rows[better]] = found[better], c
        return at, best, measured


def _sums(rotated: DataFrame, now: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the vectors of each non-empty cluster: one row a cluster and task,
    then added up by cluster and component."""
    k, dims = now.points.shape
    whole = pa.decimal128(38, 0)

    def run(batches):
        counts, sums = [0] * k, np.zeros((k, dims), object)
        for batch in batches:
            v = _matrix(batch.column(0))
            at, _, _ = now.nearest(v, _matrix(batch.column(1), np.float64), batch.column(2).to_numpy())
            v = _exact(v)
            for c in np.unique(at):
                counts[c] += int((at == c).sum())
                sums[c] += v[at == c].sum(0).astype(object)
        filled = [c for c in range(k) if counts[c]]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([counts[c] for c in filled], pa.int64()),
                                          pa.array([[Decimal(int(x)) for x in sums[c]] for c in filled], pa.list_(whole))], ["cluster", "n", "s"])

    parts = rotated.select("v", "lead", "rest").mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>")
    added = parts.select("cluster", "n", F.posexplode("s").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n"), F.sum("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, at, n, x in added.collect():
        out.setdefault(cluster, (n, [0] * dims))[1][at] = int(x)
    return out


def start(rows: DataFrame, clusters: int = CLUSTERS, salt: str = "3:") -> list[list[int]]:
    """The vectors of the ``clusters`` smallest hashes of their ids, in order of the hash."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in rows.withColumn("key", key).orderBy("key", "v").limit(clusters).select("v").collect()]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            leading: int = LEADING, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector of ``dims`` components.

    Components become floor(scale * x).  Vectors that are null, of another length, or hold a null,
    NaN or infinite component take no part, nor do rows with a null id; other columns are ignored.  Repeated rows
    are clustered and returned as often as they occur.  Fewer vectors than ``clusters`` give as many
    centroids; an empty table gives no row.  Ties go to the smaller cluster; clusters that become empty keep
    their centroid.  All sums and distances are exact; results beyond 64 bits are given as the largest long.

    The rotated rows are written once.  A round reads them and sends ``clusters * dims`` sums to the driver; it
    ends early when no centroid has moved, since the next would give the same.
    """
    rows = settle(usable(vectors, id_col, vector_col, scale).where(F.size("v") == dims))
    points = start(rows, clusters)
    if not points:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rotation = fit_rotation(rows, dims, leading)

    def turn(batches):
        for batch in batches:
            lead, rest = rotation(_matrix(batch.column(1)))
            lead = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * rotation.leading, pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lead, pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    rotated = settle(rows.mapInArrow(turn, "vec_id long, v array<long>, lead array<double>, rest double"))
    for _ in range(rounds):
        sums = _sums(rotated, Centroids(points, rotation))
        moved = [[x // sums[c][0] for x in sums[c][1]] if c in sums else p for c, p in enumerate(points)]
        if moved == points:
            break
        points = moved
    final = Centroids(points, rotation)

    def assign(batches):
        for batch in batches:
            at, best, _ = final.nearest(_matrix(batch.column(1)), _matrix(batch.column(2), np.float64), batch.column(3).to_numpy())
            best = pa.array([min(int(x), LARGEST) for x in best], pa.int64()) if best.dtype == object else pa.array(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), best], ["vec_id", "cluster", "distance"])

    assigned = settle(rotated.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    total = sum(int(x) for x in inertia.values())
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    number = F.col("cluster") + 1
    return assigned.select(
        "vec_id", "cluster", "distance",
        F.element_at(F.array(*[F.lit(min(int(inertia.get(c, 0)), LARGEST)).cast(T.LongType()) for c in range(len(points))]), number).alias("cluster_inertia"),
        F.lit(min(total, LARGEST)).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), number).alias("centroid_sha256"))
