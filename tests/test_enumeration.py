import pytest
from pyspark.sql import functions as F

from polyweave import CUBE, HEXAGON, PENTAGON, SQUARE, TRIANGLE, AssemblySystem, polyenum, polygen
from polyweave.operators import composition as comp
from polyweave.plans.enumerate import enumerate_levels

SIXTEEN = [[1, 3, 2, 3], [2, 1, 4, 1], [2, 2, 3, 2], [3, 1, 4, 1]]
LARGE = [[1, 2, 2, 1], [1, 3, 3, 1], [1, 3, 3, 2], [1, 3, 4, 3], [2, 1, 3, 3], [3, 2, 4, 2], [3, 1, 4, 2], [1, 2, 5, 1]]
CYCLIC = [[1, 3, 2, 3], [2, 2, 3, 2], [3, 3, 1, 1], [3, 3, 4, 3], [4, 2, 1, 1]]
same = lambda n: [[1, s, 1, s] for s in range(1, n + 1)]

# bonds, shape, face labels, size limit, new structures per size
GOLDEN = {
    "sixteen": (SIXTEEN, TRIANGLE, None, None, [4, 4, 4, 3, 1]),
    "large": (LARGE, TRIANGLE, None, None, [5, 8, 16, 26, 33, 29, 16, 4]),
    "cyclic": (CYCLIC, TRIANGLE, None, None, [4, 5, 6, 7, 9, 11, 13, 16, 20, 24, 29, 29, 32, 21, 22, 15, 16, 4]),
    "polyomino": (same(4), SQUARE, [1] * 4, 9, [1, 1, 2, 7, 18, 60, 196, 704, 2500]),
    "polyiamond": (same(3), TRIANGLE, [1] * 3, 10, [1, 1, 1, 4, 6, 19, 43, 120, 307, 866]),
    "polycube": (same(6), CUBE, [1] * 24, 7, [1, 1, 2, 8, 29, 166, 1023]),
    "ring": ([[1, 1, 1, 2]], TRIANGLE, None, None, [1, 1, 1, 1, 1, 1]),
    "chain": ([[1, 1, 2, 1], [1, 2, 2, 2]], TRIANGLE, None, 8, [2] * 8),
    "closing": ([[1, 1, 2, 1], [1, 2, 2, 3]], TRIANGLE, None, 7, [2, 2, 2, 2, 2, 1]),
    "branching": ([[1, 1, 1, 2], [1, 3, 1, 3]], TRIANGLE, None, 7, [1, 2, 3, 8, 18, 51, 125]),
}


@pytest.mark.parametrize("strategy", ["levels", "reverse_search"])
@pytest.mark.parametrize("name", GOLDEN)
def test_golden_counts(spark, name, strategy):
    bonds, shape, labels, size, counts = GOLDEN[name]
    run = enumerate_levels(AssemblySystem(spark, bonds, shape, labels), strategy, size)
    assert [c for _, c in sorted(run.counts.items()) if c] == counts
    assert run.n_structures == sum(counts) and run.largest == len(counts)
    assert run.structures.count() == sum(counts)


@pytest.mark.parametrize("shapes, bonds", [
    ([PENTAGON], [[1, 1, 1, 2], [1, 3, 1, 3]]),
    ([HEXAGON], [[1, 1, 1, 4], [1, 2, 1, 5]]),
    ([TRIANGLE, SQUARE], [[1, 1, 2, 1], [1, 2, 2, 3], [2, 2, 2, 4]]),
    ([CUBE, CUBE], [[1, 1, 2, 2], [1, 3, 2, 3]]),
], ids=["pentagon", "hexagon", "mixed", "cubes"])
def test_both_strategies_agree(spark, shapes, bonds):
    asys = AssemblySystem(spark, bonds, shapes)
    a, b = (enumerate_levels(asys, s, 4) for s in ("levels", "reverse_search"))
    assert a.counts == b.counts and a.counts[2]
    keyed = comp.isomorphic(asys.library, *[r.structures.select("sys", "n", "species", "partner") for r in (a, b)])
    assert keyed.count() == a.n_structures


def test_partial_rules_on_alike_sites(spark):
    """Only one face may bind although all look the same: two blocks are the end."""
    asys = AssemblySystem(spark, [[1, 1, 1, 1]], SQUARE, [1] * 4)
    assert polygen(asys, max_size=4).count() == 2


def test_limits(spark):
    asys = AssemblySystem(spark, LARGE, TRIANGLE)
    assert polygen(asys, max_size=0).count() == 5
    assert polygen(asys, max_strs=3).count() == 5
    assert polygen(asys, max_strs=20).count() == 20
    assert tuple(polyenum(asys, max_strs=20))[0] == 20
    assert tuple(polyenum(asys, max_size=0, max_strs=0)) == (137, 8)


def test_callbacks(spark):
    asys = AssemblySystem(spark, LARGE, TRIANGLE)
    out = polyenum(asys, reducer=lambda df: df["n"], reduce_op="max",
                   aggregator=lambda df: (F.col("n") == 3, F.col("species")))
    assert out.reduced == 8 and out.collected.count() == 16
    assert polyenum(asys, max_size=2, reducer=lambda df: df["n"], reduce_op=lambda a, b: a + b).reduced == 5 + 16
    no_four = lambda df: F.when(F.array_contains("species", F.lit(4).cast("smallint")), 2).otherwise(0)
    kept = polyenum(asys, rejector=no_four).n_structures
    assert kept == polygen(asys).where("NOT array_contains(species, 4S)").count() < 137
    leaf = polyenum(asys, rejector=lambda df: F.when(F.col("n") == 2, 1).otherwise(0))
    assert tuple(leaf) == (13, 2) and not leaf.broke
    stop = polyenum(asys, rejector=lambda df: F.when(F.col("n") == 2, 3).otherwise(0))
    assert stop.broke and stop.largest == 2
    assert polygen(asys, callback=lambda df: df.select("n"), max_size=1).columns == ["n"]


def test_compositions_and_symmetry(spark):
    asys = AssemblySystem(spark, [[1, 1, 1, 2]], TRIANGLE)
    rows = comp.compositions(comp.with_symmetry(polygen(asys), asys.library), asys.library).orderBy("n").collect()
    assert [r.composition for r in rows] == [[1, 0], [2, 1], [3, 2], [4, 3], [5, 4], [6, 6]]
    assert [r.sigma for r in rows] == [1, 1, 1, 1, 1, 6]


def test_bond_type_order(spark):
    """Types are ordered by the larger label, then the smaller."""
    asys = AssemblySystem(spark, [[1, 1, 2, 1], [1, 2, 1, 3], [1, 3, 1, 3]], TRIANGLE)
    pair = polygen(asys, max_size=2).where("n = 2 AND array_contains(species, 2S)")
    assert [r.bond_counts for r in comp.composition(pair, asys.library).collect()] == [[0, 0, 1]]
    assert asys.library.n_labels == 6


def test_cube_symmetry_numbers(spark):
    asys = AssemblySystem(spark, same(6), CUBE, [1] * 24)
    rows = comp.with_symmetry(polygen(asys, max_size=3), asys.library).collect()
    assert sorted((r.n, r.sigma) for r in rows) == [(1, 24), (2, 8), (3, 2), (3, 8)]


ALIKE = [1, 1, 1, 1]


@pytest.mark.parametrize("rule", ["color", "site"])
@pytest.mark.parametrize("shape, labels, bonds, counts", [
    (SQUARE, ALIKE, [[1, 2, 1, 2]], [1, 1]),
    (SQUARE, [1, 2, 1, 2], [[1, 3, 1, 3]], [1, 1]),
    (TRIANGLE, [1, 1, 2], [[1, 3, 1, 3]], [1, 1]),
    (TRIANGLE, [5, 6, 7], [[1, 3, 1, 3]], [1, 1]),
    (TRIANGLE, [70000, 6, 40000], [[1, 3, 1, 3]], [1, 1]),
    (TRIANGLE, None, [[1, 3, 1, 3]], [1, 1]),
    (SQUARE, ALIKE, [[1, 1, 1, 2]], None),
    (SQUARE, [1, 2, 1, 2], [[1, 1, 1, 1], [1, 3, 1, 3], [1, 1, 1, 3]], None),
    (TRIANGLE, [1, 1, 2], [[1, 1, 1, 3], [1, 2, 1, 2]], None),
    (HEXAGON, [1, 2, 3, 1, 2, 3], [[1, 1, 1, 1], [1, 2, 1, 5], [1, 3, 1, 4]], None),
])
def test_face_labels_and_partial_rules(spark, shape, labels, bonds, counts, rule):
    asys = AssemblySystem(spark, bonds, shape, labels, contact_rule=rule)
    a, b = (enumerate_levels(asys, s, 5) for s in ("levels", "reverse_search"))
    found = [c for _, c in sorted(a.counts.items()) if c]
    assert found == [c for _, c in sorted(b.counts.items()) if c]
    assert found == plain_counts(shape.n_sites, labels, bonds, 5, rule)
    if counts:
        assert found == counts


def plain_counts(m, labels, bonds, size, rule):
    """Structures of one regular polygon that tiles, by plain growth of cells (x, y, turn).

    Structures are the same if a motion maps cells onto cells and each turn onto a turn of the
    same kind: turns are of one kind if the block looks the same and binds the same after them.
    """
    import cmath
    rules = {(i - 1, j - 1) for _, i, _, j in bonds} | {(j - 1, i - 1) for _, i, _, j in bonds}
    labels = labels or list(range(m))
    seen_as = {(labels[i], labels[j]) for i, j in rules}
    fits = (lambda i, j: (labels[i], labels[j]) in seen_as) if rule == "color" else (lambda i, j: (i, j) in rules)
    kinds = {s: labels[s] for s in range(m)}
    while True:  # symmetries of the block keep labels and, kind by kind, what sites bind
        turns = [t for t in range(m) if all(kinds[s] == kinds[(s + t) % m] for s in range(m))]
        orbit = {s: min((s + t) % m for t in turns) for s in range(m)}
        new = {s: (orbit[s], tuple(sorted({orbit[j] for i, j in rules if i == s}))) for s in range(m)}
        if len(set(new.values())) == len(set(orbit.values())):
            break
        kinds = new
    r, step = 0.5 / cmath.tan(cmath.pi / m).real, 2 * cmath.pi / m
    face = lambda turn, s: cmath.exp(1j * (turn - s * step))
    code = lambda z: (round(z.real, 3) + 0.0, round(z.imag, 3) + 0.0)

    def form(cells):
        out = []
        for z0, t0 in cells:
            for k in turns:
                back = cmath.exp(-1j * (t0 - k * step))
                out.append(tuple(sorted((code((z - z0) * back), min(code(cmath.exp(1j * (t - t0 + (k + u) * step))) for u in turns)) for z, t in cells)))
        return min(out)

    def grown(cells):
        for z, t in cells:
            for i, j in rules:
                z2 = z + 2 * r * face(t, i)
                t2 = cmath.phase(-face(t, i)) + j * step
                ok = True
                for y, u in cells:
                    gap = abs(y - z2)
                    if gap < 2 * r - 0.1:
                        ok = False
                    elif gap < 2 * r + 1e-6:
                        here = min(range(m), key=lambda s: abs(face(u, s) * 2 * r - (z2 - y)))
                        there = min(range(m), key=lambda s: abs(face(t2, s) * 2 * r - (y - z2)))
                        if abs(face(u, here) * 2 * r - (z2 - y)) < 1e-6 and not fits(here, there):
                            ok = False
                if ok:
                    yield (*cells, (z2, t2))

    level, out = {None: ((0j, 0.0),)}, []
    while level and len(out) < size:
        out.append(len(level))
        level = {form(g): g for cells in level.values() for g in grown(cells)}
    return out


def test_catalogs_refuse_rules_that_tell_alike_sites_apart(spark):
    from polyweave import BlockLibrary, SystemCatalog
    bonds = spark.createDataFrame([(0, 1, 2, 1, 2)], "sys long, species_i int, site_i int, species_j int, site_j int")
    with pytest.raises(Exception, match="differ between look-alike sites"):
        polygen(SystemCatalog.from_bonds(BlockLibrary([SQUARE], ALIKE), bonds), max_size=2).count()
    with pytest.raises(ValueError, match="site labels"):
        BlockLibrary.uniform(HEXAGON, 6000)


def test_written_levels_go_away(spark):
    import os
    run = enumerate_levels(AssemblySystem(spark, SIXTEEN, TRIANGLE), "levels", 2)
    folder = run.folder.removeprefix("file:")
    assert os.path.isdir(folder)
    run.close()
    assert not os.path.exists(folder)
    found = polyenum(AssemblySystem(spark, SIXTEEN, TRIANGLE), max_size=2, reducer=lambda df: df["n"], reduce_op=max)
    assert found.reduced == 2
    found.close()


# ----------------------------------------------------------------- structures shared by many systems

@pytest.mark.parametrize("name", ["polygen_triangles", "polyenum_triangles", "polygen_polyomino", "polyenum_polycube", "polygen_cubes", "polyenum_coarse_labels",
                                  "polygen_site_rule", "polyenum_renumbered", "polygen_mixed"])
def test_shared_structures_are_those_of_each_system(spark, monkeypatch, name):
    """The same rows whether structures are grown for every rule list or once for all of them; also with shuffled dictionaries."""
    from polyweave.plans import enumerate as plans
    from polyweave.suite import registered
    if name not in registered():
        pytest.skip("not registered")
    rows = {}
    for limit, bound in ((1 << 40, 1 << 40), (0, 1 << 40), (0, -1)):
        monkeypatch.setattr(plans, "SHARED_LISTS", limit)
        monkeypatch.setattr(plans, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(plans, "BROADCAST_SYSTEMS", bound)
        rows[limit, bound] = sorted(map(tuple, registered()[name][0](spark, "/root/testdata/sf0.001").collect()))
    assert len({str(r) for r in rows.values()}) == 1 and rows[0, -1]


def test_systems_with_equal_rules_are_grown_once_and_numbered_again_on_a_clash(spark, monkeypatch):
    from polyweave import TRIANGLE, SystemCatalog
    from polyweave.blocks import BlockLibrary
    from polyweave.plans import enumerate as plans
    rows = [(s, 1, 1 + s % 2, 2, 2) for s in range(6)] + [(s, 1, 3, 1, 3) for s in range(6)]
    catalog = SystemCatalog.from_bonds(BlockLibrary.uniform(TRIANGLE, 2), spark.createDataFrame(
        rows, "sys long, species_i int, site_i int, species_j int, site_j int"))
    monkeypatch.setattr(plans, "SHARED_LISTS", 0)
    clash = plans.SharedShapes.unique
    monkeypatch.setattr(plans.SharedShapes, "unique", lambda self, kept: self.seed > 0 and clash(self, kept))
    run = plans.enumerate_levels(catalog, "levels", 4)
    assert plans.RuleDictionary(catalog, plans.checkpoint_folder(spark)).different == 2
    per = {}
    for r in run.structures.collect():
        per.setdefault(r["sys"], []).append((r["n"], tuple(r["species"]), tuple(r["partner"]), tuple(r["allowed"])))
    assert set(per) == set(range(6)) and sorted(per[0]) == sorted(per[2]) == sorted(per[4]) and sorted(per[1]) == sorted(per[5])
    assert run.n_structures == sum(map(len, per.values()))
    run.close()


def test_limit_of_each_system_is_the_head_of_its_structures(spark, monkeypatch):
    """Both ways of growing, and two reads of one run, give the same rows: the first in order of size and arrays."""
    from polyweave.plans import enumerate as plans
    from polyweave.sources import tables
    catalog = tables.talk_systems(spark, "/root/testdata/sf0.001")
    flat = lambda df: sorted((r["sys"], r["n"], tuple(r["species"]), tuple(r["partner"])) for r in df.collect())
    whole = {}
    for row in flat(polygen(catalog, max_size=4)):
        whole.setdefault(row[0], []).append(row)
    assert max(map(len, whole.values())) > 20
    want = sorted(r for rows in whole.values() for k, r in enumerate(rows) if k < 20 or r[1] == 1)
    for limit in (0, 1 << 40):
        monkeypatch.setattr(plans, "SHARED_LISTS", limit)
        run = plans.enumerate_levels(catalog, "levels", 4, each_system=20)
        assert flat(run.structures) == flat(run.structures) == want and run.n_structures == len(want)
        few = plans.enumerate_levels(catalog, "levels", 4, each_system=1)
        assert few.largest == 1 and few.n_structures == sum(r[1] == 1 for rows in whole.values() for r in rows)


def test_folds_of_any_function_by_system(spark, monkeypatch):
    from polyweave.plans import enumerate as plans
    frame = spark.createDataFrame([(s, n, [1] * n, [0] * 3 * n, [1]) for s in range(40) for n in (1, 2, 3)],
                                  "sys long, n int, species array<smallint>, partner array<smallint>, allowed array<int>")
    monkeypatch.setattr(plans, "FOLDED", 3)
    got = plans.fold_table(frame, lambda df: F.col("sys") * 10 + F.col("n"), lambda a, b: a ^ b).collect()
    assert {r["sys"]: r["value"] for r in got} == {s: (s * 10 + 1) ^ (s * 10 + 2) ^ (s * 10 + 3) ^ (s * 10) for s in range(40)}
    assert plans.fold_table(frame, lambda df: F.col("n"), "max", ()).first()["value"] == 3
    assert plans.fold_table(frame.limit(0), lambda df: F.col("n") + 7, lambda a, b: a + b, ()).first()["value"] == 7


def test_a_stop_ends_its_own_system(spark):
    from polyweave.sources import tables
    catalog = tables.talk_systems(spark, "/root/testdata/sf0.001")
    count = lambda df: {(r["sys"], r["n"]): r["count"] for r in df.groupBy("sys", "n").count().collect()}
    whole = count(polyenum(catalog, max_size=4).structures)
    run = polyenum(catalog, max_size=4, rejector=lambda df: F.when(F.col("n") == F.col("sys") % 4 + 1, 3).otherwise(0))
    assert run.broke and count(run.structures) == {(s, n): c for (s, n), c in whole.items() if n <= s % 4 + 1}
    assert {n for _, n in whole} == {1, 2, 3, 4} and run.n_structures < sum(whole.values())


def test_steps_are_dealt_by_their_rows(spark, monkeypatch):
    """A level is grown in as many tasks as its rows ask for; dealt by list, or by structure as well if a list may have many."""
    from polyweave.plans import enumerate as plans
    from polyweave.sources import tables
    catalog = tables.order_systems(spark, "/root/testdata/sf0.001")
    flat = lambda df: sorted((r["sys"], r["n"], tuple(r["species"]), tuple(r["partner"])) for r in df.collect())
    monkeypatch.setattr(plans, "SHARED_LISTS", 0)
    step, tasks = plans.SharedShapes.step, []

    def watched(self, frontier, *rest):
        level = step(self, frontier, *rest)
        tasks.append((frontier.count(), level.rdd.getNumPartitions()))
        return level

    monkeypatch.setattr(plans.SharedShapes, "step", watched)
    found = {}
    for size, many in ((1 << 40, 1 << 40), (300, 300), (300, 1 << 40)):
        monkeypatch.setattr(plans, "ROWS_PER_STEP", size)
        monkeypatch.setattr(plans, "ROWS_PER_TASK", min(size, 20_000))
        if many > size:  # few structures, so that rows of a list meet
            monkeypatch.setattr(plans.SharedShapes, "count", property(lambda self: 64, lambda self, n: None), raising=False)
        tasks.clear()
        found[size, many] = flat(plans.enumerate_levels(catalog, "levels", 3).structures)
        assert size > 300 or all(number >= rows / size for rows, number in tasks) and max(rows for rows, _ in tasks) > 8 * size
    assert len({str(f) for f in found.values()}) == 1 and len(found[300, 300]) > 5000


def test_summaries_are_made_by_rule_list(spark, monkeypatch):
    """The rows to be summarised are those of the different rule lists; the result is the one system by system."""
    from polyweave.plans import enumerate as plans
    from polyweave.sources import tables
    catalog = tables.day_systems(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.collect()))
    size = lambda df: (F.col("n") * 8 + F.size(F.filter("species", lambda s: s == 1))).cast("bigint")
    either = lambda a, b: a ^ b
    for limit in (0, 1 << 40):
        monkeypatch.setattr(plans, "SHARED_LISTS", limit)
        for strategy, each in (("levels", None), ("reverse_search", None), ("reverse_search", 9)):
            run = plans.enumerate_levels(catalog, strategy, 3, each_system=each)
            assert rows(run.by_system(plans.counts_by_size)) == rows(plans.counts_by_size(run.structures))
            assert run.shared.count() < run.structures.count() == run.n_structures
        got = polyenum(catalog, max_size=3, fold_by=("sys",), fold_lists=True, reduce_op=either, reducer=size)
        assert rows(got.reduced) == rows(plans.fold_table(got.structures, size, either))
    cut = plans.enumerate_levels(catalog, "levels", 3, 500)
    assert rows(cut.by_system(plans.counts_by_size)) == rows(plans.counts_by_size(cut.structures))
    one = AssemblySystem(spark, CYCLIC, TRIANGLE)
    assert [r["structures"] for r in sorted(polygen(one, max_size=4, summary=plans.counts_by_size).collect())] == GOLDEN["cyclic"][4][:4]


def test_equal_whole_numbers_are_folded_by_doubling(spark):
    from polyweave.plans import enumerate as plans
    frame = spark.range(30_000).selectExpr("id % 3 AS sys", "CAST(2 AS INT) AS n", "array(1S, 1S) AS species", "array(0S) AS partner", "array(1) AS allowed")
    add = lambda a, b: a + b
    table = plans.fold_table(frame, lambda df: F.col("n") * 5 + 1, add)
    assert {r["sys"]: r["value"] for r in table.collect()} == {s: 10_000 * 11 + 1 for s in range(3)}
    assert "FlatMapGroupsInArrow" not in table._jdf.queryExecution().toString()  # groups go by in one call a task
    words = plans.fold_table(frame, lambda df: F.col("n") * 0.5, max, ())
    assert words.first()["value"] == 1.0
