"""Graph-vertex numbering of a structure: (block, site) <-> vertices, as SQL expressions.

Every function takes SQL text for its arguments and works on a row with a ``species`` array.
Blocks, sites, vertices and labels are numbered from 1.
"""

from __future__ import annotations

from ..blocks import BlockLibrary


def _ints(values) -> str:
    return "array(" + ",".join(map(str, values)) + ")"


def _nested(rows) -> str:
    return "array(" + ",".join(_ints(r) for r in rows) + ")"


def _firsts(library: BlockLibrary) -> str:
    return _nested([[sum(s.site_vertices[:i]) for i in range(s.n_sites)] for s in library.shapes])


def vertex_count(library: BlockLibrary, blocks: str = "species") -> str:
    """Number of graph vertices of the listed blocks."""
    sizes = _ints(s.n_vertices for s in library.shapes)
    return f"aggregate({blocks}, 0, (n, k) -> n + {sizes}[k - 1])"


def first_vertex(library: BlockLibrary, block: str, site: str = "1") -> str:
    before = vertex_count(library, f"slice(species, 1, {block} - 1)")
    return f"(1 + {before} + {_firsts(library)}[species[{block} - 1] - 1][{site} - 1])"


def site_first_vertices(library: BlockLibrary, block: str) -> str:
    """First vertex of each site of a block."""
    before = vertex_count(library, f"slice(species, 1, {block} - 1)")
    return f"transform({_firsts(library)}[species[{block} - 1] - 1], f -> 1 + {before} + f)"


def site_vertices(library: BlockLibrary, block: str, site: str) -> str:
    """All vertices of one site, ascending."""
    sizes = _nested(s.site_vertices for s in library.shapes)
    start = first_vertex(library, block, site)
    return f"sequence({start}, {start} + {sizes}[species[{block} - 1] - 1][{site} - 1] - 1)"


def block_vertices(library: BlockLibrary, block: str) -> str:
    """All vertices of a block, ascending."""
    sizes = _ints(s.n_vertices for s in library.shapes)
    start = first_vertex(library, block)
    return f"sequence({start}, {start} + {sizes}[species[{block} - 1] - 1] - 1)"


def vertex_table(library: BlockLibrary) -> str:
    """``array<struct<particle, site, label>>`` in vertex order: the inverse of the maps above."""
    sites = _nested([[i + 1 for i, v in enumerate(s.site_vertices) for _ in range(v)] for s in library.shapes])
    offsets = _ints(library.offsets)
    return (f"flatten(transform(species, (k, i) -> transform({sites}[k - 1], s -> named_struct("
            f"'particle', i + 1, 'site', s, 'label', {offsets}[k - 1] + s))))")


def bond_edges(size_i: str, size_j: str) -> str:
    """``array<struct<i, j>>``: vertices (1-based within each site) joined by one bond."""
    step_i = f"IF({size_i} > {size_j}, {size_i} DIV {size_j}, 1)"
    step_j = f"IF({size_j} > {size_i}, {size_j} DIV {size_i}, 1)"
    pairs = (f"arrays_zip(sequence(1, {size_i}, {step_i}), reverse(sequence(1, {size_j}, {step_j})))")
    uneven = f"greatest({size_i}, {size_j}) % least({size_i}, {size_j}) <> 0"
    first = "array(named_struct('i', 1, 'j', 1))"
    return f"IF({uneven}, {first}, transform({pairs}, p -> named_struct('i', p['0'], 'j', p['1'])))"
