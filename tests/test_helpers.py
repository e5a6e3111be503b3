"""The Arrow helpers against brute force on random structures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from polyweave import CUBE, SQUARE, TRIANGLE, BlockLibrary
from polyweave.operators import arrow_helpers as H

short = lambda rows: pa.array([list(map(int, r)) for r in rows], type=pa.list_(pa.int16()))


def random_tree(lib, n, rng):
    m = lib.stride
    species, partner = [rng.randint(1, lib.n_species)], [0] * m
    while len(species) < n:
        k, i = rng.randint(1, lib.n_species), rng.randrange(len(species))
        mine = [s for s in range(lib.shapes[species[i] - 1].n_sites) if not partner[i * m + s]]
        if not mine:
            continue
        a, b = i * m + rng.choice(mine), len(species) * m + rng.randrange(lib.shapes[k - 1].n_sites)
        species.append(k)
        partner += [0] * m
        partner[a], partner[b] = b + 1, a + 1
    return species, partner


def shuffled(lib, species, partner, rng):
    m, order = lib.stride, list(range(len(species)))
    rng.shuffle(order)
    to = {old: new for new, old in enumerate(order)}
    move = lambda p: 0 if p == 0 else to[(p - 1) // m] * m + (p - 1) % m + 1
    return ([species[o] for o in order],
            [move(partner[o * m + s]) for o in order for s in range(m)])


LIBS = [BlockLibrary([TRIANGLE, SQUARE, TRIANGLE]), BlockLibrary.uniform(SQUARE, 2, [1] * 4),
        BlockLibrary.uniform(CUBE, 2, [1] * 24), BlockLibrary([SQUARE, SQUARE], [[1, 2, 1, 2], [1, 1, 1, 1]])]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3), st.integers(1, 7), st.integers(0, 10 ** 6))
def test_canonical_form_ignores_block_order(which, n, seed):
    rng, lib = random.Random(seed), LIBS[which]
    base = random_tree(lib, n, rng)
    rows = [base] + [shuffled(lib, *base, rng) for _ in range(3)]
    out = H.canonical_batch(lib.tables, short([r[0] for r in rows]), short([r[1] for r in rows]), True, True).to_pylist()
    assert len({r["key"] for r in out}) == 1 and len({r["sigma"] for r in out}) == 1
    if lib.distinct_sites:
        assert len({(tuple(r["species"]), tuple(r["partner"])) for r in out}) == 1
    assert any(r["accepted"] for r in H.canonical_batch(
        lib.tables, *[short(v) for v in zip(*[rotate_last(lib, *base, i) for i in range(n)])], True, True).to_pylist())


def rotate_last(lib, species, partner, i):
    """The same structure with block i written last."""
    order = [k for k in range(len(species)) if k != i] + [i]
    m, to = lib.stride, {old: new for new, old in enumerate(order)}
    move = lambda p: 0 if p == 0 else to[(p - 1) // m] * m + (p - 1) % m + 1
    return [species[o] for o in order], [move(partner[o * m + s]) for o in order for s in range(m)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(0, 10 ** 6))
def test_removable_against_search(n, seed):
    rng, lib = random.Random(seed), LIBS[1]
    species, partner = random_tree(lib, n, rng)
    got = H.removable_batch(lib.tables, short([species]), short([partner])).to_pylist()[0]
    near = {i: {(p - 1) // 4 for p in partner[4 * i:4 * i + 4] if p} for i in range(n)}
    for gone in range(n):
        rest = set(range(n)) - {gone}
        seen, todo = set(), list(rest)[:1]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [w for w in near[v] if w != gone]
        assert got[gone] == (seen == rest)


def test_mixed_sizes_in_one_batch():
    rng, lib = random.Random(5), LIBS[0]
    rows = [random_tree(lib, n, rng) for n in (3, 1, 4, 3, 0 + 2)]
    out = H.canonical_batch(lib.tables, short([r[0] for r in rows]), short([r[1] for r in rows]), True, False)
    one = [H.canonical_batch(lib.tables, short([a]), short([b]), True, False).to_pylist()[0] for a, b in rows]
    assert out.to_pylist() == one
    assert len(H.place_batch(lib.tables, *[out.field(f) for f in ("species", "partner")])) == 5
    assert np.isclose(H.place_batch(lib.tables, *[out.field(f) for f in ("species", "partner")]).to_pylist()[0]["x"][0], 0)


def _random_structures(rnd, rows, n, m, extra):
    """Connected random bonds between n blocks of m sites, as partner slots."""
    out = np.zeros((rows, n, m), np.int64)
    for row in out:
        def link(i, j):
            a, b = np.flatnonzero(row[i] == 0), np.flatnonzero(row[j] == 0)
            if len(a) and len(b) and i != j:
                s, t = rnd.choice(a), rnd.choice(b)
                row[i, s], row[j, t] = j * m + t + 1, i * m + s + 1
                return True
        order = rnd.permutation(n)
        for k in range(1, n):
            while not link(order[rnd.integers(max(0, k - 3), k)], order[k]):
                pass
        for _ in range(extra):
            link(*rnd.integers(0, n, 2))
    return out.reshape(rows, -1).astype(np.int16)


@pytest.mark.parametrize("n,m,extra", [(1, 3, 0), (2, 3, 1), (5, 4, 1), (9, 6, 5), (30, 6, 12), (200, 6, 60)])
def test_removable_blocks_against_deleting_each(n, m, extra):
    from polyweave.operators.arrow_helpers import removable
    rnd = np.random.default_rng(n)
    partner = _random_structures(rnd, 40 if n < 100 else 4, n, m, extra)
    got = removable(partner, n, m)
    for row, found in zip(partner, got):
        near = [{(int(p) - 1) // m for p in row[i * m:(i + 1) * m] if p} for i in range(n)]
        for gone in range(n):
            left = set(range(n)) - {gone}
            seen, todo = set(), list(left)[:1]
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += [j for j in near[i] if j != gone]
            assert found[gone] == (seen == left)
    assert n < 3 or (0 < got.sum() < got.size)


def test_a_structure_in_pieces_is_refused():
    from polyweave.operators.arrow_helpers import removable
    with pytest.raises(ValueError):
        removable(np.zeros((1, 6), np.int16), 2, 3)
