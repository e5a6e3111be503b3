import hashlib

import numpy as np
import pytest
from compare import compare

from polyweave.llm import centroids
from polyweave.llm.queries import registered


def plain(rows, clusters, rounds):
    """Lloyd's rounds in Python integers: rows of (vec_id, vector)."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in rows]
    for _ in range(rounds):
        at = assign()
        for c in range(len(points)):
            own = [v for (_, v), (_, k) in zip(rows, at) if k == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = [sum(d for d, k in at if k == c) for c in range(len(points))]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(rows, at))


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_rounds(spark, seed):
    rnd = np.random.default_rng(seed)
    d, n = (2, 60) if seed else (3, 5)
    centre = rnd.integers(-3, 4, (6, d)) * (1, 40, 1000)[seed]
    x = (centre[rnd.integers(0, 6, n)] + rnd.integers(-2, 3, (n, d))).astype(float) / (1, 4, 1)[seed]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = centroids.cluster(frame, dims=d, scale=4, leading=1).collect()
    want = plain([(i, [int(np.floor(4 * v)) for v in r]) for i, r in enumerate(x.tolist())], 8, 10)
    assert sorted(map(tuple, got)) == want


def test_far_centroids_are_not_measured():
    rnd = np.random.default_rng(1)
    points = rnd.integers(-1000, 1000, (8, 64))
    v = points[rnd.integers(0, 8, 500)] + rnd.integers(-9, 10, (500, 64))
    rotation = centroids.Rotation(v.mean(0), np.linalg.eigh(np.cov(v.T))[1][:, ::-1], 16)
    now = centroids.Centroids(points.tolist(), rotation)
    at, best, measured = now.nearest(v, *rotation(v))
    whole = ((v[:, None] - points) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (best == whole.min(1)).all() and measured < 1.1 * len(v)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0], "a"), (1, [0.0, 1.0], "a"), (2, [3e38, -3e38], "b"), (3, None, "c"), (4, [1.0], "d"), (5, [nan, 1.0], "e"),
            (6, [inf, 0.0], "f"), (7, [None, 0.0], "g"), (None, [5.0, 5.0], "h"), (8, [-0.0005, 0.0], "i")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    got = sorted(map(tuple, centroids.cluster(frame, dims=2).collect()))
    assert [r[0] for r in got] == [1, 1, 2, 8] and all(r[2] == 0 for r in got) and got[0] == got[1]
    few = sorted(map(tuple, centroids.cluster(frame, dims=2, clusters=1).collect()))
    assert len(few) == 4 and max(r[2] for r in few) == centroids.LARGEST == few[0][4]
    assert centroids.cluster(frame.where("vec_id > 90"), dims=2).collect() == []


def test_query_matches_sql(spark, con, small):
    ok, text = compare(spark, con, small, "op13_centroids", *registered()["op13_centroids"])
    assert ok, text
