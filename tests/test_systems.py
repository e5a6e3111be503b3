import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from polyweave import CUBE, SQUARE, TRIANGLE, AssemblySystem
from polyweave.functions.vertices import bond_edges
from polyweave.operators.paths import connected, simple_paths

S1 = [[1, 1, 2, 1], [2, 3, 3, 1]]
SYSTEMS = {
    "s1": S1, "s2": [[3, 3, 2, 2], [2, 4, 1, 1]], "s3": [[3, 3, 2, 3], [2, 4, 1, 1]],
    "s4": S1 + [[1, 3, 1, 3]], "s5": S1 + [[1, 1, 1, 1]], "s6": S1 + [[1, 2, 1, 2]], "s7": S1 + [[1, 2, 1, 3]],
    "s8": [[1, 1, 1, 1]], "s9": [[1, 1, 1, 2]],
}


def test_system_hash_pattern(spark):
    key = {n: AssemblySystem(spark, b, SQUARE).rhash().first().rhash for n, b in SYSTEMS.items()}
    assert key["s1"] == key["s2"]
    for a, bs in (("s1", "s3 s4 s5 s6 s7"), ("s4", "s5 s6 s7"), ("s8", "s9")):
        for b in bs.split():
            assert key[a] != key[b], (a, b)


def test_mirror_image_has_the_same_hash(spark):
    left = AssemblySystem(spark, [[1, 1, 2, 1], [1, 2, 2, 4]], SQUARE)
    right = AssemblySystem(spark, [[1, 1, 2, 1], [1, 4, 2, 2]], SQUARE)
    assert left.rhash().first().rhash == right.rhash().first().rhash


def test_sizes_and_rules(spark):
    a = AssemblySystem(spark, [[1, 3, 2, 3], [2, 3, 1, 3], [1, 1, 1, 1]], TRIANGLE)
    assert a.size() == (2, 2) and repr(a) == "AssemblySystem{2}[n=2, k=2]"
    assert sorted((r.label_i, r.label_j) for r in a.bond_rules().collect()) == [(1, 1), (3, 6), (6, 3)]
    assert a.sites().count() == 6


def test_matrix_source(spark):
    m = [[0] * 6 for _ in range(6)]
    m[2][5] = m[5][2] = m[0][0] = 1
    a = AssemblySystem.from_matrix(spark, m, [TRIANGLE, TRIANGLE])
    assert a.size() == (2, 2)
    m[1][2] = 1
    with pytest.raises(PySparkException):
        AssemblySystem.from_matrix(spark, m, [TRIANGLE, TRIANGLE]).size()


def test_unknown_site_fails(spark):
    with pytest.raises(PySparkException):
        AssemblySystem(spark, [[1, 4, 1, 1]], TRIANGLE).size()


def test_system_without_rules_has_its_blocks(spark):
    from polyweave import polygen
    assert polygen(AssemblySystem(spark, [], [TRIANGLE, SQUARE])).count() == 2


def test_system_graph(spark):
    a = AssemblySystem(spark, [[1, 1, 1, 2]], TRIANGLE)
    assert sorted((r.src, r.dst) for r in a.anatomy().collect()) == [
        (1, 2), (1, 4), (2, 3), (2, 4), (3, 1), (4, 1), (4, 2)]
    with pytest.raises(ValueError):
        AssemblySystem(spark, [[1, 1, 1, 1]], CUBE).anatomy()


def test_bond_edges(spark):
    want = {(1, 1): [(1, 1)], (4, 4): [(1, 4), (2, 3), (3, 2), (4, 1)], (2, 4): [(1, 3), (2, 1)],
            (4, 2): [(1, 2), (3, 1)], (3, 2): [(1, 1)], (4, 1): [(1, 1)]}
    rows = spark.createDataFrame(list(want), "a int, b int").selectExpr("a", "b", f"{bond_edges('a', 'b')} AS e")
    for r in rows.collect():
        assert [(e.i, e.j) for e in r.e] == want[r.a, r.b]


def test_simple_paths_and_reachability(spark):
    # a four-cycle with a chord, in both directions, next to a graph with an unreachable end
    both = [(a, b) for a, b in ((1, 2), (2, 3), (3, 4), (4, 1), (1, 3))]
    edges = [(0, a, b) for a, b in both] + [(0, b, a) for a, b in both] + [(1, 1, 2), (1, 3, 2)]
    df = spark.createDataFrame(edges, "graph bigint, src int, dst int")
    ends = spark.createDataFrame([(0, 2, 4), (1, 1, 3)], "graph bigint, v int, w int")
    got = sorted(tuple(r.path) for r in simple_paths(df, ends).collect())
    assert got == [(2, 1, 3, 4), (2, 1, 4), (2, 3, 1, 4), (2, 3, 4)]
    starts = ends.select("graph", F.col("v").alias("vertex"))
    targets = ends.select("graph", F.col("w").alias("vertex"))
    assert {r.graph: r.connected for r in connected(df, starts, targets).collect()} == {0: True, 1: False}
    wall = spark.createDataFrame([(0, 1), (0, 3)], "graph bigint, vertex int")
    assert not any(r.connected for r in connected(df, starts, targets, wall).collect())


def test_keys_against_all_relabellings():
    import random
    from itertools import permutations, product
    from polyweave.operators import system_graph as g
    rnd, turns = random.Random(3), [(0, 1, 2), (1, 2, 0), (2, 0, 1)]

    def plain(n, pairs):
        return min(tuple(sorted(tuple(sorted(((p[a], t[a].index(s)), (p[b], t[b].index(u))))) for (a, s), (b, u) in pairs))
                   for p in permutations(range(n)) for t in product(turns, repeat=n))

    seen, back = {}, {}
    for _ in range(400):
        n = rnd.choice([1, 2, 3])
        nodes = [(k, s) for k in range(n) for s in range(3)]
        pairs = list({tuple(sorted(rnd.choices(nodes, k=2))) for _ in range(rnd.choice([1, 2, 3, 4]))})
        form, want = g.smallest_form([(0, turns)] * n, pairs), (n, plain(n, pairs))
        assert seen.setdefault(want, form) == form and back.setdefault(form, want) == want


def test_many_species_that_look_alike():
    import time
    from polyweave.operators import system_graph as g
    turns, n, start = [(0, 1, 2, 3), (1, 2, 3, 0), (2, 3, 0, 1), (3, 0, 1, 2)], 12, time.time()
    ring = [((k, 0), ((k + 1) % n, 2)) for k in range(n)]
    moved = [(((5 * a + 3) % n, (s + 1) % 4), ((5 * b + 3) % n, (t + 1) % 4)) for (a, s), (b, t) in ring]
    star = [((0, 0), (k, 1)) for k in range(1, n)]
    kinds = [(0, turns)] * n
    assert g.smallest_form(kinds, ring) == g.smallest_form(kinds, moved) != g.smallest_form(kinds, star)
    assert g.smallest_form(kinds, []) == ((((0,), ()),) * n)
    assert time.time() - start < 20


@pytest.mark.parametrize("seed", range(4))
def test_least_images_agree_with_the_search(seed):
    """Systems get equal keys by all images exactly when they do by refinement and search."""
    import random

    import numpy as np
    from polyweave import SQUARE, TRIANGLE
    from polyweave.operators import system_graph as g
    rnd = random.Random(seed)
    shapes = [[TRIANGLE] * 3, [SQUARE, TRIANGLE, SQUARE], [SQUARE] * 2, [TRIANGLE]][seed]
    offsets = np.cumsum([0, *[s.n_sites for s in shapes]]).tolist()
    actions = {s: g.site_actions(s) for s in shapes}
    n = len(shapes)
    lists = [sorted({tuple(sorted(rnd.choices(range(1, offsets[n] + 1), k=2))) for _ in range(rnd.randrange(5))}) for _ in range(60)]
    both = [sorted({*ps, *((j, i) for i, j in ps)}) for ps in lists]
    row = np.repeat(np.arange(len(both)), [len(b) for b in both])
    first, second = (np.array([p[k] for b in both for p in b], np.int64) for k in (0, 1))
    keys = g.ImageKeys(shapes, actions, offsets, n)(row, first, second, len(both))
    found = [g.system_key(shapes, actions, offsets, n, b) for b in both]
    assert [[a == b for b in keys] for a in keys] == [[a == b for b in found] for a in found]
    assert 1 < len(set(keys)) < len(keys)


def _reached(edges, starts, walls=()):
    out, todo = set(starts), list(starts)
    nexts = {}
    for g, a, b in edges:
        nexts.setdefault((g, a), []).append((g, b))
    while todo:
        for v in nexts.get(todo.pop(), ()):
            if v not in out and v not in walls:
                out.add(v)
                todo.append(v)
    return out


def test_long_paths_are_reached_in_few_rounds(spark, monkeypatch):
    from polyweave.operators import paths
    made = []

    class Counted(paths.Rounds):
        def save(self, df):
            made.append(1)
            return super().save(df)

    monkeypatch.setattr(paths, "Rounds", Counted)
    line = [(g, k, k + 1) for g in (0, 1) for k in range(1000)]
    edges = line + [(0, b, a) for g, a, b in line if g == 0] + [(2, k, (k + 1) % 50) for k in range(50)]
    df = spark.createDataFrame(edges, "graph bigint, src int, dst int")
    starts = [(0, 500), (1, 3), (2, 7)]
    walls = [(0, 900), (1, 990)]
    got = paths.reachable(df, spark.createDataFrame(starts, "graph bigint, vertex int"), spark.createDataFrame(walls, "graph bigint, vertex int")).collect()
    assert len(got) == len(set(got))
    assert {(r.graph, r.vertex) for r in got} == _reached(edges, starts, set(walls))
    assert len(made) < 60  # three tables a round


def test_reached_vertices_of_random_graphs(spark, monkeypatch):
    import random
    from polyweave.operators import paths
    from polyweave.operators.paths import reachable
    monkeypatch.setattr(paths, "PLAIN_STEPS", 2)  # contract small graphs as well
    rnd, edges, starts, walls = random.Random(5), [], [], []
    for g in range(120):
        n = rnd.choice([2, 8, 25, 60])
        for _ in range(int(n * rnd.choice([0.9, 1.1, 1.5]))):
            a, b = rnd.randrange(n), rnd.randrange(n)
            edges += [(g, a, b)] * rnd.choice([1, 2]) + [(g, b, a)] * (rnd.random() < rnd.choice([0, 0.9]))
        starts += [(g, rnd.randrange(n)) for _ in range(rnd.choice([1, 1, 3]))]
        walls += [(g, rnd.randrange(n)) for _ in range(rnd.choice([0, 2]))]
    pairs = "graph bigint, vertex int"
    got = reachable(spark.createDataFrame(edges + [(None, 1, 2), (0, None, 1)], "graph bigint, src int, dst int"),
                    spark.createDataFrame(starts, pairs), spark.createDataFrame(walls, pairs)).collect()
    assert len(got) == len(set(got))
    assert {(r.graph, r.vertex) for r in got} == _reached(edges, starts, set(walls))
    assert reachable(spark.createDataFrame([], "graph bigint, src int, dst int"), spark.createDataFrame([], pairs)).count() == 0


def test_no_path_is_grown_into_dead_ends(spark, monkeypatch):
    from polyweave.operators import paths
    from polyweave.operators.paths import _leading, simple_paths
    monkeypatch.setattr(paths, "WORTH", 0)  # prune to the end, however little a round removes
    both = [(0, 1), (1, 2), (2, 3), (3, 0)]
    tree = [(1, 10)] + [(k // 2 + 5, k) for k in range(11, 40)]  # hangs on 1
    hub = [(2, k) for k in range(100, 130)] + [(k, 3) for k in range(100, 130)]
    one_way = [(0, 500)] + [(k, k + 1) for k in range(500, 520)]
    edges = [(0, a, b) for a, b in both + tree + hub] + [(0, b, a) for a, b in both + tree] + [(0, a, b) for a, b in one_way]
    df = spark.createDataFrame(edges, "graph bigint, src int, dst int")
    ends = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "graph bigint, v int, w int")
    used = {(r.src, r.dst) for r in _leading(df, ends).where("v = 0").collect()}
    assert used == {(0, 1), (1, 2), (2, 3), (0, 3)} | set(hub)
    monkeypatch.undo()
    want = [(0, 1, 2, 3), (0, 3), (1,)] + [(0, 1, 2, k, 3) for k in range(100, 130)]
    assert sorted(tuple(r.path) for r in simple_paths(df, ends).collect()) == sorted(want)


def test_graphs_in_rows_as_by_joins(spark, monkeypatch):
    import random
    from polyweave.operators import paths
    monkeypatch.setattr(paths, "SMALL", 90)
    monkeypatch.setattr(paths, "GROWN", 7)
    monkeypatch.setattr(paths, "GIVEN", 20)
    rnd, rows = random.Random(5), []
    for g in range(24):
        n = rnd.choice((4, 6, 7))
        edges = {(rnd.randrange(n) * 10 ** 9, rnd.randrange(n) * 10 ** 9) for _ in range(rnd.randrange(1, 3 * n))}
        edges |= {(10 ** 9, k) for k in range(100 if g == 3 else 80 if g == 4 else 0)} | {(k, 0) for k in range(100 if g == 3 else 80 if g == 4 else 0) if k}
        rows.append((g, rnd.choice((0, 10 ** 9)), 0 if g % 8 == 1 else 2 * 10 ** 9, len(edges) + 30 * (g % 6 == 5) * len(edges),
                     sorted(edges), [0, 10 ** 9][:g % 3], [3 * 10 ** 9] * (g % 2)))
    df = spark.createDataFrame(rows, "graph bigint, v bigint, w bigint, n_edges int, edges array<struct<src: bigint, dst: bigint>>, "
                                     "targets array<bigint>, forbidden array<bigint>")
    edges, ends = df.selectExpr("graph", "inline(edges)"), df.select("graph", "v", "w")
    got, want = (sorted((r.graph, tuple(r.path)) for r in t.collect()) for t in (paths.simple_paths_rows(df), simple_paths(edges, ends)))
    assert got == want and len(got) > 100
    starts = df.select("graph", F.col("v").alias("vertex"))
    slow = connected(edges, starts, df.selectExpr("graph", "explode(targets) AS vertex"), df.selectExpr("graph", "explode(forbidden) AS vertex"))
    fast = paths.connected_rows(df.withColumnRenamed("v", "start"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and {r.connected for r in fast.collect()} == {True, False}


def test_vertices_are_listed_for_different_blocks_only(spark):
    import re
    from polyweave.suite import structures
    for query in (structures.vertex_index, structures.vertex_inverse, structures.vertex_lookup):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:re.search(r"Aggregate \[[^\]]*species#\d+", plan).start()]
        assert above.count("Generate") >= 1  # the vertices are generated after structures with the same blocks are counted
