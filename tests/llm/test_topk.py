import numpy as np
import pytest
from compare import compare

from polyweave.llm import topk
from polyweave.llm.queries import registered


def plain(ids, rows, query, own, k):
    scores = [(-sum(int(a) * int(b) for a, b in zip(query, r)), int(i), n) for n, (i, r) in enumerate(zip(ids, rows)) if i != own]
    return [(-s, i) for s, i, _ in sorted(scores)[:k]]


@pytest.mark.parametrize("seed", range(40))
def test_lists_against_all_scores(seed):
    rnd = np.random.default_rng(seed)
    n, d = rnd.choice([1, 3, 40, 300]), rnd.choice([1, 2, 8])
    width = rnd.choice([1, 3, 100, 3_000_000_000])
    rows = rnd.integers(-width, width + 1, (n, d))
    ids = rnd.permutation(n) if seed % 3 else rnd.integers(0, n, n)
    lists = topk.SortedLists(rows)
    queries, own = rows[:20] * (1 if width < 1000 else -1), ids[:20]
    found = lists.best(queries, ids, own, 5)
    for q in range(len(queries)):
        assert [(s, int(ids[c])) for p, c, s in found if p == q] == plain(ids, rows, queries[q], own[q], 5)


def test_query_matches_sql(spark, con, small):
    ok, text = compare(spark, con, small, "op3_topk", *registered()["op3_topk"])
    assert ok, text


def test_odd_rows_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [0.1, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]),
            (6, [0.5, 0.5]), (7, [1.0]), (None, [9.0, 9.0]), (8, [-0.1, 0.2]), (50, [0.25, -0.25]), (0, [0.5, 0.5]), (100, []), (9, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    for blocks in ({}, {"candidate_block": 2, "query_block": 1}):
        vectors = topk.usable(frame)
        out = topk.top_k(vectors, topk.query_rows(vectors).dropDuplicates(["vec_id"]), **blocks)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())
        s = 128 * 128 * 2
        assert got == [(0, 1, 5, s), (0, 2, 6, s), (0, 3, 6, s), (0, 4, 8, (-26 + 51) * 128), (0, 5, 50, 0),
                       (50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 5, 0), (50, 4, 6, 0), (50, 5, 6, 0), (100, 1, 9, 0)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []
