"""The graph of a binding-rule system and the invariant key of whole systems."""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..blocks import graph_symmetries
from ..sources.systems import SystemCatalog


def system_graph(catalog: SystemCatalog) -> DataFrame:
    """Directed edges ``(sys, src, dst)`` of all systems (planar blocks): see :func:`graph_rows`."""
    return graph_rows(catalog).selectExpr("sys", "inline(edges)")


def graph_rows(catalog: SystemCatalog) -> DataFrame:
    """``(sys, n_species, n_bonds, n_edges, edges)``: the directed edges ``src, dst`` of every system (planar blocks), in one row.

    Vertices are the site labels of the system's species, then one vertex per allowed bond in
    row order of the interaction matrix; sites of a block form its directed cycle, and a bond
    vertex is linked both ways with the sites it joins.
    """
    lib = catalog.library
    if lib.dim != 2:
        raise ValueError("the system graph is defined for planar blocks")
    ends = "array(" + ",".join(str(o + s.n_sites) for o, s in zip(lib.offsets, lib.shapes)) + ")"
    once = "array_sort(filter(rules, r -> r.i <= r.j))"
    both = lambda end: f"named_struct('src', CAST(r.{end} AS INT), 'dst', top + b + 1), named_struct('src', top + b + 1, 'dst', CAST(r.{end} AS INT))"
    link = f"flatten(transform(once, (r, b) -> IF(r.i = r.j, array({both('i')}), array({both('i')}, {both('j')}))))"
    arcs = "array(" + ",".join("array(" + ",".join(
        f"named_struct('src', {o + a}, 'dst', {o + b})" for a, b in s.edges) + ")"
        for o, s in zip(lib.offsets, lib.shapes)) + ")"
    own = "array(" + ",".join(str(sum(len(s.edges) for s in lib.shapes[:k + 1])) for k in range(len(lib.shapes))) + ")"
    rows = catalog.rows.selectExpr("sys", "n_species", f"{ends}[n_species - 1] AS top", f"{once} AS once",
                                   f"{own}[n_species - 1] + 2 * size(rules) AS n_edges")
    return rows.selectExpr("sys", "n_species", "size(once) AS n_bonds", "n_edges", f"concat(flatten(slice({arcs}, 1, n_species)), {link}) AS edges")


# --------------------------------------------------------------------- invariant key

def site_actions(shape) -> tuple[list, list]:
    """Site permutations of a block: its own rotations, and those followed by a reflection."""
    site_of = [i for i, v in enumerate(shape.site_vertices) for _ in range(v)]
    firsts = [site_of.index(i) for i in range(shape.n_sites)]
    to_sites = lambda h: tuple(site_of[h[f]] for f in firsts)
    arcs = {(a - 1, b - 1) for a, b in shape.edges}
    back = [(b + 1, a + 1) for a, b in arcs]
    turns = sorted({to_sites(h) for h in graph_symmetries(shape.n_vertices, shape.edges)})
    return turns, sorted({to_sites(h) for h in _isomorphisms(shape.n_vertices, arcs, {(b - 1, a - 1) for b, a in back})})


def _isomorphisms(n: int, arcs: set, other: set) -> list[tuple]:
    out = []

    def extend(image):
        v = len(image)
        if v == n:
            out.append(tuple(image))
            return
        for w in range(n):
            if w not in image and all(((v, u) in arcs) == ((w, image[u]) in other) and
                                      ((u, v) in arcs) == ((image[u], w) in other) for u in range(v)):
                extend(image + [w])

    extend([])
    return out


def refined(kinds, pairs, marks) -> dict:
    """Site colours that no relabelling which keeps ``marks`` can change (colour refinement)."""
    nodes = [(k, s) for k, (_, turns) in enumerate(kinds) for s in range(len(turns[0]))]
    near = {v: [] for v in nodes}
    for a, b in pairs:
        near[a].append((b, a == b))
        if a != b:
            near[b].append((a, False))
    color = {v: (kinds[v[0]][0], marks.get(v, 0)) for v in nodes}
    count = 0
    while True:
        names = {c: i for i, c in enumerate(sorted(set(color.values())))}
        color = {v: names[color[v]] for v in nodes}
        if len(names) == count:
            return color
        count = len(names)
        # the colours of the block seen from a site, over all rotations that move it first
        color = {(k, s): (color[k, s],
                          min(tuple(color[k, t[i]] for i in range(len(t))) for t in kinds[k][1] if t[0] == s)
                          if any(t[0] == s for t in kinds[k][1]) else (),
                          tuple(sorted((color[b], same) for b, same in near[k, s]))) for k, s in nodes}


def smallest_form(kinds, pairs) -> tuple:
    """Canonical rule list: the sorted forms of the connected parts of the system."""
    part = list(range(len(kinds)))
    for (a, _), (b, _) in pairs:
        low, high = sorted((part[a], part[b]))
        part = [low if x == high else x for x in part]
    forms = []
    for name in sorted(set(part)):
        members = [k for k, x in enumerate(part) if x == name]
        at = {k: i for i, k in enumerate(members)}
        own = [((at[a], s), (at[b], t)) for (a, s), (b, t) in pairs if part[a] == name]
        forms.append(connected_form([kinds[k] for k in members], own, {}))
    return tuple(sorted(forms))


def connected_form(kinds, pairs, marks) -> tuple:
    """Least rule list of a connected system over all that refinement leaves open.

    Species that refinement can't tell apart are marked one after another, then the rotations
    of a block likewise, and refined again; every choice that is not a mere exchange of twins is
    followed, and the least list wins.
    """
    color = refined(kinds, pairs, marks)
    views = []
    for k, (kind, turns) in enumerate(kinds):
        seen = [(tuple(color[k, t[i]] for i in range(len(t))), t) for t in turns]
        best = min(v for v, _ in seen)
        views.append(((kind, best), k, [t for v, t in seen if v == best]))
    views.sort(key=lambda v: v[0])
    step = len(marks) + 1
    for sign in dict.fromkeys(v[0] for v in views):
        alike = [k for other, k, _ in views if other == sign]
        if len(alike) > 1:
            chosen = [k for i, k in enumerate(alike) if not any(twins(pairs, marks, j, k) for j in alike[:i])]
            return min(connected_form(kinds, pairs, marks | {(k, s): step for s in range(len(kinds[k][1][0]))}) for k in chosen)
    for _, k, ts in views:
        if len(ts) > 1:
            return min(connected_form(kinds, pairs, marks | {(k, s): step + i for i, s in enumerate(t)}) for t in ts)
    at = {(k, s): (place, i) for place, (_, k, ts) in enumerate(views) for i, s in enumerate(ts[0])}
    return tuple(v[0][0] for v in views), tuple(sorted((min(at[a], at[b]), max(at[a], at[b])) for a, b in pairs))


def twins(pairs, marks, j, k) -> bool:
    """Whether exchanging two species changes neither the rules nor the marks."""
    swap = {j: k, k: j}
    turned = {tuple(sorted((swap.get(a, a), s) for a, s in pair)) for pair in pairs}
    return turned == {tuple(sorted(pair)) for pair in pairs} and all(marks.get((swap[a], s), 0) == m for (a, s), m in marks.items() if a in swap)


def system_key(shapes, actions, offsets, n_species, rules) -> str:
    where = {}
    for k in range(n_species):
        for s in range(shapes[k].n_sites):
            where[offsets[k] + s + 1] = (k, s)
    pairs = [(where[i], where[j]) for i, j in rules if i <= j]
    names = {s: i for i, s in enumerate(dict.fromkeys(shapes))}
    kinds = [(names[shapes[k]], actions[shapes[k]][0]) for k in range(n_species)]
    forms = [smallest_form(kinds, pairs)]
    if all(actions[shapes[k]][1] for k in range(n_species)):
        flip = {k: actions[shapes[k]][1][0] for k in range(n_species)}
        turned = [((a, flip[a].index(s)), (b, flip[b].index(t))) for (a, s), (b, t) in pairs]
        forms.append(smallest_form(kinds, turned))
    return repr(sorted(forms))


#: images of a rule list under all exchanges of species and turns of blocks, up to which the least is taken of all of them
IMAGES = 4096


class ImageKeys:
    """Least image of rule lists of ``n_species`` blocks, whole batches at a time.

    A list is a set of unordered label pairs, one bit each.  The order of species of one shape, the turns of every
    block and a mirror image of everything move the bits; each of these images is looked up byte by byte in tables.
    """

    def __init__(self, shapes, actions, offsets, n_species: int):
        # species in order of their shapes, so that the order of a library does not matter
        order = sorted(range(n_species), key=lambda k: (shapes[k].name, shapes[k].n_sites))
        self.names = ",".join(shapes[k].name for k in order)
        start, at = np.cumsum([0, *[shapes[k].n_sites for k in order]]), {}
        self.place = np.zeros(offsets[n_species - 1] + shapes[n_species - 1].n_sites + 1, np.int64)
        for i, k in enumerate(order):
            at[k] = int(start[i])
            self.place[offsets[k] + 1:offsets[k] + shapes[k].n_sites + 1] = start[i] + np.arange(shapes[k].n_sites)
        self.labels = int(start[-1])
        rows, columns = np.triu_indices(self.labels)
        self.number = np.zeros((self.labels, self.labels), np.int64)
        self.number[rows, columns] = self.number[columns, rows] = np.arange(len(rows))
        self.bytes = -(-len(rows) // 8)
        self.words = -(-self.bytes // 8)
        self.tables = np.array([self._table(self.number[image[rows], image[columns]]) for image in self._images(shapes, actions, order, at)])

    @staticmethod
    def count(shapes, actions, n_species: int) -> int:
        own = shapes[:n_species]
        orders = math.prod(math.factorial(own.count(s)) for s in set(own))
        return orders * sum(math.prod(len(actions[s][side]) for s in own) for side in (0, 1))

    def _images(self, shapes, actions, order, at):
        kinds = list(dict.fromkeys(shapes[k] for k in order))
        groups = [[k for k in order if shapes[k] == kind] for kind in kinds]
        found = set()
        for moved in product(*[permutations(g) for g in groups]):
            to = {a: b for g, m in zip(groups, moved) for a, b in zip(g, m)}
            for side in (0, 1):
                for turns in product(*[actions[shapes[k]][side] for k in order]):
                    image = np.empty(self.labels, np.int64)
                    for k, turn in zip(order, turns):
                        image[at[k]:at[k] + len(turn)] = at[to[k]] + np.array(turn)
                    found.add(tuple(image.tolist()))
        return [np.array(i) for i in sorted(found)]

    def _table(self, moved: np.ndarray) -> np.ndarray:
        """``[byte, value, word]``: the bits that a byte of the list sets in the image."""
        bit = np.zeros((self.bytes * 8, self.words), np.uint64)
        bit[np.arange(len(moved)), moved // 64] = np.uint64(1) << (moved % 64).astype(np.uint64)
        value = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
        return np.where(value[None, :, :, None], bit.reshape(self.bytes, 1, 8, self.words), np.uint64(0)).sum(2, dtype=np.uint64)

    def __call__(self, row: np.ndarray, first: np.ndarray, second: np.ndarray, rows: int) -> list[str]:
        """Keys of ``rows`` lists, given as label pairs with the number of their row."""
        bits = np.zeros((rows, self.bytes * 8), bool)
        bits[row, self.number[self.place[first], self.place[second]]] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        best = np.full((rows, self.words), np.iinfo(np.uint64).max, np.uint64)
        for table in self.tables:
            image = np.zeros((rows, self.words), np.uint64)
            for k in range(self.bytes):
                image |= table[k, packed[:, k]]
            less, same = np.zeros(rows, bool), np.ones(rows, bool)
            for w in range(self.words):
                less |= same & (image[:, w] < best[:, w])
                same &= image[:, w] == best[:, w]
            best[less] = image[less]
        return [f"{self.names}:" + "-".join(f"{x:x}" for x in words) for words in best.tolist()]


def system_keys(catalog: SystemCatalog) -> DataFrame:
    """``(sys, system_key, rhash)``: equal keys for systems that differ only by the order of
    species, the rotation of blocks, or a mirror image of everything."""
    shapes, offsets = catalog.library.shapes, catalog.library.offsets
    actions = {s: site_actions(s) for s in dict.fromkeys(shapes)}

    tabled = {}

    def keys(n_species: pa.Array, rules: pa.Array) -> pa.Array:
        sizes, count = n_species.to_numpy(zero_copy_only=False), np.diff(rules.offsets.to_numpy())
        pairs = rules.flatten()
        first, second = (pairs.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("i", "j"))
        row, out = np.repeat(np.arange(len(sizes)), count), np.empty(len(sizes), object)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            if ImageKeys.count(shapes, actions, n) <= IMAGES:  # the same way for all systems of n species, so keys agree
                if n not in tabled:
                    tabled[n] = ImageKeys(shapes, actions, offsets, n)
                rank = np.full(len(sizes), -1)
                rank[own] = np.arange(len(own))
                at = rank[row] >= 0
                out[own] = tabled[n](rank[row[at]], first[at], second[at], len(own))
            else:
                for i in own:
                    at = row == i
                    out[i] = system_key(shapes, actions, offsets, n, list(zip(first[at].tolist(), second[at].tolist())))
        return pa.array(out.tolist(), type=pa.string())

    # many systems have the same rules: each distinct list is named once
    rows = catalog.rows.select("sys", "n_species", "rules")
    distinct = rows.select("n_species", "rules").distinct()
    named = distinct.withColumn("system_key", arrow_udf(keys, "string")("n_species", "rules"))
    return rows.join(named, ["n_species", "rules"]).select("sys", "system_key", F.xxhash64("system_key").alias("rhash"))
