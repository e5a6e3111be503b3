import os

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from polyweave.llm import metric_join
from polyweave.llm.queries import registered


def plain(rows, least):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    n = len(rows)
    near = [[i != j and a is not None and b is not None and len(a) == len(b) and metric_join.cosine(np.array(a), np.array(b)) >= least
             for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    ids = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return sorted(((rows[i][0], sum(near[i]), ids[root[i]], rows[i][0] is not None and rows[i][0] == ids[root[i]]) for i in range(n)), key=str)


def sample(seed, d):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(8, d))
    rows = np.concatenate([centre[rnd.integers(0, 8, 90)] + rnd.normal(size=(90, d)) * 0.15, rnd.normal(size=(30, d)),
                           np.repeat(centre[:2], 8, 0) * rnd.choice([1.0, 2.0], (16, 1))])
    return [(int(i), r.tolist()) for i, r in zip(rnd.permutation(len(rows)), rows)]


@pytest.mark.parametrize("seed,d,options", [(0, 3, {}), (1, 3, {"cell_rows": 20, "tile_rows": 7}), (2, 6, {"cell_rows": 9, "tile_rows": 40}),
                                            (3, 2, {"cell_rows": 12, "tile_rows": 5}), (4, 16, {"cell_rows": 30, "tile_rows": 11})])
def test_against_all_pairs(spark, seed, d, options):
    rows = sample(seed, d)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = metric_join.near_duplicates(frame, 0.95, **options).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 0.95)


def test_every_near_pair_meets_once():
    rnd = np.random.default_rng(5)
    u = metric_join.units(rnd.normal(size=(400, 3)))
    points, radius = metric_join.pivots(u, 12), 0.32
    home, near = metric_join.reach(u, points, None, radius)
    d = np.sqrt(((u[:, None] - u) ** 2).sum(2))
    replica = near & (home[:, None] != np.arange(len(points)))
    for i, j in zip(*np.nonzero(np.triu(d <= radius, 1))):
        assert (near[i] & near[j] & ~(replica[i] & replica[j])).sum() == 1
    assert near.sum() < 0.7 * near.size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0]), (None, [1.0, 0.0]), (9, None), (8, []), (7, [0.0, -0.0]), (6, [nan, 1.0]), (3, [inf, 1.0]),
            (2, [None, 1.0]), (1, [1.0]), (0, [-1.0, 0.0]), (None, None), (11, [1e-300, 1e-300]), (10, [1e300, 1e300]), (12, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_duplicates(frame).collect()}
    assert got == {(5, 3, 4, False), (4, 3, 4, True), (None, 3, 4, False), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True), (6, 0, 6, True), (3, 0, 3, True),
                   (2, 0, 2, True), (1, 0, 1, True), (0, 0, 0, True), (None, 0, None, False), (11, 1, 10, False), (10, 1, 10, True), (12, 0, 12, True)}
    assert metric_join.near_duplicates(frame).count() == len(rows)
    assert metric_join.near_duplicates(frame.limit(0)).collect() == []


def test_query_matches_sql(spark, con, small):
    ok, text = compare(spark, con, small, "op12_metric_join", *registered()["op12_metric_join"])
    assert ok, text


def shuffled(spark):
    """Bytes of the session's shuffle files, by name."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {os.path.join(at, f): os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, files in os.walk(folder) for f in files if f.endswith(".data")}


def test_vectors_are_not_copied_for_each_tile_they_meet(spark, monkeypatch):
    d, n, found, real = 24, 1200, {}, metric_join.settle
    before = shuffled(spark)

    def settled(df):
        out = real(df)
        found.update({name: size for name, size in shuffled(spark).items() if name not in before})
        return out

    monkeypatch.setattr(metric_join, "settle", settled)
    frame = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(k).cast("float") for k in range(d)]).alias("embedding"))
    got = metric_join.near_duplicates(frame, 0.95, tile_rows=60, cell_rows=n).agg(F.count("*"), F.sum("n_links")).first()
    assert tuple(got) == (n, 0)
    assert 0 < sum(found.values()) < 8 * n * d * 4
