"""Cubes bound by any two faces: rings, which may close in a twist that is not the standard one of the faces."""

from itertools import permutations

from compare import connect
from pyspark.sql import functions as F

from polyweave import polygen
from polyweave.oracle import TurnedCubes
from polyweave.suite import structures

FOLDER = "/root/testdata/sf0.001"


def least(blocks, bonds):
    """Least image of a bond graph under all orders of its blocks."""
    out = []
    for order in permutations(range(len(blocks))):
        at = {b: k for k, b in enumerate(order)}
        out.append((tuple(blocks[b] for b in order), tuple(sorted((at[a], i, at[b], j) for a, i, b, j in bonds))))
    return min(out)


def bonds_of(cells, cubes):
    """``(block, face, block, face)`` of every two cells that touch, both ways."""
    out = []
    for a, e in enumerate(cells):
        for b, f in enumerate(cells):
            delta = [f[i] - e[i] for i in range(3)]
            if delta in [list(s) for s in cubes.steps]:
                there = [-d for d in delta]
                face = lambda cell, d: cubes.facing[cell[3]][[list(s) for s in cubes.steps].index(d)]
                out.append((a, face(e, delta), b, face(f, there)))
    return out


def test_rings_by_their_bonds(spark):
    cubes = TurnedCubes()
    sql = structures.recursive(cubes, "day", 4, "SELECT sys, n, cells FROM forms WHERE n = 4")
    found = [(sys, [c[4] for c in cells], bonds_of(cells, cubes)) for sys, _, cells in connect(FOLDER).execute(sql).fetchall()]
    want = {(sys, least(blocks, bonds)) for sys, blocks, bonds in found if len(bonds) > 6}
    mine = polygen(structures.turned_cubes(spark, FOLDER), max_size=4)
    got = set()
    rows = mine.where((F.col("n") == 4) & (F.size(F.filter("partner", lambda p: p > 0)) > 6)).collect()
    for r in rows:
        bonds = [(s // 6, s % 6 + 1, (p - 1) // 6, (p - 1) % 6 + 1) for s, p in enumerate(r["partner"]) if p]
        got.add((r["sys"], least(r["species"], bonds)))
    assert len(rows) == len(got) and got == want and len(want) > 100
