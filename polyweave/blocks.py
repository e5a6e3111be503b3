"""Building blocks: shapes, the block library, and its small lookup tables.

A :class:`Shape` is pure geometry.  A :class:`BlockLibrary` lists the block types (species)
a family of binding-rule systems may use.  The library is definition-sized, never data-sized;
its tables are what the Arrow helpers carry in their closures, and ``MAX_LABELS`` checks it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import cos, pi, sin, sqrt, tan
from types import SimpleNamespace

import numpy as np

MAX_LABELS = 32767

# Slack of the overlap test and tolerance of two faces that coincide.
OVERLAP_SLACK = 0.1
FACE_TOLERANCE = 1e-2


def turn_z(half_turns: float) -> tuple:
    """Planar rotation written as a quaternion about z."""
    return (cos(pi * half_turns / 2), 0.0, 0.0, sin(pi * half_turns / 2))


def qmul(p, q):
    """Hamilton product over the last axis of two arrays."""
    pw, px, py, pz = np.moveaxis(np.asarray(p, float), -1, 0)
    qw, qx, qy, qz = np.moveaxis(np.asarray(q, float), -1, 0)
    return np.stack([pw * qw - px * qx - py * qy - pz * qz,
                     pw * qx + px * qw + py * qz - pz * qy,
                     pw * qy + py * qw + pz * qx - px * qz,
                     pw * qz + pz * qw + px * qy - py * qx], axis=-1)


def qrot(x, q):
    """Rotate points (last axis 3) by unit quaternions (last axis 4)."""
    x, q = np.asarray(x, float), np.asarray(q, float)
    t = 2 * np.cross(q[..., 1:], x)
    return x + q[..., :1] * t + np.cross(q[..., 1:], t)


@dataclass(frozen=True)
class Shape:
    """Rigid block. ``edges`` is the directed template graph on the block's vertices (1-based)."""

    name: str
    dim: int
    sites: tuple            # centre -> binding site, (x, y, z); z = 0 in the plane
    refs: tuple             # quaternion turning site i into reference position
    turns: tuple            # quaternion applied to a block attached at site i
    corners: tuple
    site_vertices: tuple    # graph vertices per site
    edges: tuple
    r_min: float = field(default=0.0)
    r_max: float = field(default=0.0)

    def __post_init__(self):
        if self.dim not in (2, 3):
            raise ValueError("blocks are two- or three-dimensional")
        if not len(self.sites) == len(self.refs) == len(self.turns) == len(self.site_vertices):
            raise ValueError("one rotation pair and vertex count is needed per site")
        norms = lambda ps: [sqrt(sum(c * c for c in p)) for p in ps]
        if not self.r_min:
            object.__setattr__(self, "r_min", min(norms(self.sites)))
        if not self.r_max:
            object.__setattr__(self, "r_max", max(norms(self.corners)))

    @property
    def n_sites(self) -> int:
        return len(self.sites)

    @property
    def n_vertices(self) -> int:
        return sum(self.site_vertices)


def polygon(n: int, side: float = 1.0, name: str | None = None) -> Shape:
    """Regular polygon. Site 1 points down, numbering is clockwise."""
    r_in, r_out = side / (2 * tan(pi / n)), side / (2 * sin(pi / n))
    steps = [2 * i / n for i in range(n)]
    at = lambda r, half_turns: (r * cos(pi * half_turns), r * sin(pi * half_turns), 0.0)
    return Shape(
        name or f"polygon{n}", 2,
        sites=tuple(at(r_in, -s - 0.5) for s in steps),
        refs=tuple(turn_z(s) for s in steps),
        turns=tuple(turn_z(1 - s) for s in steps),
        corners=tuple(at(r_out, s + 1 / n) for s in steps),
        site_vertices=(1,) * n,
        edges=tuple((i, i % n + 1) for i in range(1, n + 1)),
        r_min=r_in, r_max=r_out)


# Site directions, reference and attachment quaternions (in units of 1 and
# sqrt(1/2)), and the links between the six four-vertex face cycles of the cube.
CUBE_SITES = ((1, 0, 0), (0, 0, -1), (0, 1, 0), (0, 0, 1), (0, -1, 0), (-1, 0, 0))
CUBE_REFS = ((1, 0, 0, 0), (1, 0, -1, 0), (1, 0, 0, -1), (1, 0, 1, 0), (1, 0, 0, 1), (0, 0, 0, 1))
CUBE_TURNS = ((0, 0, 0, 1), (0, 1, 0, 1), (1, 0, 0, -1), (0, -1, 0, 1), (1, 0, 0, 1), (1, 0, 0, 0))
CUBE_LINKS = ((1, 7), (2, 20), (3, 13), (4, 10), (5, 21), (6, 17),
              (8, 9), (11, 16), (12, 22), (14, 19), (15, 23), (18, 24))


def cube(half_edge: float = 1.0, name: str = "cube") -> Shape:
    """Axis-aligned cube with a binding site on each face; the edge is twice ``half_edge``."""
    unit = lambda q: tuple(c / sqrt(sum(v * v for v in q)) for c in q)
    cycles = [(4 * f + k + 1, 4 * f + (k + 1) % 4 + 1) for f in range(6) for k in range(4)]
    links = list(CUBE_LINKS) + [(b, a) for a, b in CUBE_LINKS]
    return Shape(
        name, 3,
        sites=tuple(tuple(half_edge * c for c in s) for s in CUBE_SITES),
        refs=tuple(map(unit, CUBE_REFS)),
        turns=tuple(map(unit, CUBE_TURNS)),
        corners=tuple((half_edge * i, half_edge * j, half_edge * k)
                      for k in (-1, 1) for j in (-1, 1) for i in (-1, 1)),
        site_vertices=(4,) * 6,
        edges=tuple(cycles + links))


#: relative difference of lengths that still count as equal
SAME_LENGTH = 1e-6


def polygon_of(corners, name: str = "corners") -> Shape:
    """Convex polygon with the given corners, in either sense of rotation; its centroid becomes the centre.

    Site i is the middle of the edge from corner i to the next.  A block attached there turns its own edge
    against it, so the middles of the two edges meet; edges of different lengths may be joined.
    """
    c = np.array([tuple(p)[:2] for p in corners], float)
    if len(c) < 3 or not np.isfinite(c).all():
        raise ValueError(f"shape {name} needs at least three corners with finite coordinates")
    after = np.roll(c, -1, axis=0)
    edge, size = after - c, np.abs(c - c.mean(axis=0)).max()
    bend = edge[:, 0] * np.roll(edge, -1, axis=0)[:, 1] - edge[:, 1] * np.roll(edge, -1, axis=0)[:, 0]
    sense = np.sign(bend.sum())
    outer = np.arctan2(edge[:, 1], edge[:, 0]) / pi - sense / 2   # half-turns, direction of the outward normal
    swept = np.mod(sense * np.diff(outer, append=outer[:1]), 2).sum()
    if not size or (sense * bend <= SAME_LENGTH * size * size).any() or abs(swept - 2) > 0.5:
        raise ValueError(f"the corners of shape {name} are not those of a convex polygon, in order")
    area = c[:, 0] * after[:, 1] - c[:, 1] * after[:, 0]
    c = c - ((c + after) * area[:, None]).sum(axis=0) / (3 * area.sum())
    middle, n = (c + np.roll(c, -1, axis=0)) / 2, len(c)
    spatial = lambda points: tuple((float(x), float(y), 0.0) for x, y in points)
    forward = [(i, i % n + 1) for i in range(1, n + 1)]
    return Shape(
        name, 2, sites=spatial(middle),
        refs=tuple(turn_z(-0.5 - u) for u in outer),
        turns=tuple(turn_z(1.5 + u) for u in outer),
        corners=spatial(c), site_vertices=(1,) * n,
        edges=tuple(forward if sense < 0 else [(b, a) for a, b in forward]),   # always clockwise
        r_min=float((middle[:, 0] * np.cos(pi * outer) + middle[:, 1] * np.sin(pi * outer)).min()))


def box(half_x: float, half_y: float, half_z: float, name: str = "box") -> Shape:
    """Axis-aligned box with a binding site on each face, numbered, turned and linked as those of the cube."""
    half, unit = (float(half_x), float(half_y), float(half_z)), cube()
    if not all(0 < h < float("inf") for h in half):
        raise ValueError(f"shape {name} needs positive, finite edges")
    scaled = lambda points: tuple(tuple(h * c for h, c in zip(half, p)) for p in points)
    return Shape(name, 3, sites=scaled(unit.sites), refs=unit.refs, turns=unit.turns, corners=scaled(unit.corners),
                 site_vertices=unit.site_vertices, edges=unit.edges)


def box_of(corners, name: str = "corners") -> Shape:
    """The box with the given eight corners, in any order; its edges must lie along the axes."""
    c = np.array([tuple(p) for p in corners], float)
    if c.shape != (8, 3) or not np.isfinite(c).all():
        raise ValueError(f"shape {name} needs eight corners with finite coordinates")
    low, high = c.min(axis=0), c.max(axis=0)
    upper = c > (low + high) / 2
    if np.abs(c - np.where(upper, high, low)).max() > SAME_LENGTH * (high - low).max() or len(set(map(tuple, upper))) < 8:
        raise ValueError(f"the corners of shape {name} are not those of a box along the axes")
    return box(*((high - low) / 2), name=name)


def polyhedron(kind: str, size: float = 1.0) -> Shape:
    if kind != "cube":
        raise ValueError(f"shape {kind} is not supported")
    return cube(size)


TRIANGLE = polygon(3, 1.0, "triangle")
SQUARE = polygon(4, 1.0, "square")
PENTAGON = polygon(5, 1.0, "pentagon")
HEXAGON = polygon(6, 1.0, "hexagon")
CUBE = cube()
UNIT_SHAPES = (TRIANGLE, SQUARE, PENTAGON, HEXAGON, CUBE)


def graph_symmetries(n_vertices: int, edges) -> list[tuple]:
    """All vertex permutations (0-based) that preserve a small directed template graph."""
    arcs = {(a - 1, b - 1) for a, b in edges}
    found = []

    def fits(image, v, w):
        return all(((v, u) in arcs) == ((w, image[u]) in arcs) and
                   ((u, v) in arcs) == ((image[u], w) in arcs) for u in range(v))

    def extend(image):
        v = len(image)
        if v == n_vertices:
            found.append(tuple(image))
            return
        for w in range(n_vertices):
            if w not in image and fits(image, v, w):
                extend(image + [w])

    extend([])
    return found


def block_symmetries(shape: Shape) -> list[tuple]:
    """The symmetries of a block's template graph that a rotation of the block carries out: its rotation group.

    Of a square all four turns of the graph are, of another rectangle two, of an irregular polygon one.
    """
    sites, corners = (np.array(p, float)[:, :shape.dim] for p in (shape.sites, shape.corners))
    owner = np.repeat(np.arange(shape.n_sites), shape.site_vertices)
    firsts = np.cumsum([0, *shape.site_vertices[:-1]])
    slack, found = 1e-6 + SAME_LENGTH * shape.r_max, []
    for h in graph_symmetries(shape.n_vertices, shape.edges):
        image = sites[owner[np.array(h)[firsts]]]
        u, _, v = np.linalg.svd(sites.T @ image)
        u[:, -1] *= np.linalg.det(u @ v)                     # the nearest rotation, never a mirror image
        moved = corners @ (u @ v)
        near = np.abs(moved[:, None] - corners[None]).max(axis=2).min(axis=1)
        if np.abs(sites @ (u @ v) - image).max() < slack and near.max() < slack:
            found.append(h)
    return found


class BlockLibrary:
    """Ordered block types with their site labels, colours and symmetry tables.

    ``face_labels`` is one list for every species, or one list per species; entries are per
    site or per graph vertex.  Sites with equal face labels are indistinguishable when
    structures are compared.  Without it all sites of a species are distinct.  ``classes`` (one
    list of site numbers per species) tells sites of one face label apart, see ``split_by_rules``.
    """

    def __init__(self, shapes, face_labels=None, classes=None):
        self.shapes, self.face_labels = list(shapes), face_labels
        if not self.shapes:
            raise ValueError("a library needs at least one block")
        if sum(s.n_sites for s in self.shapes) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} site labels, the most that SMALLINT columns hold")
        if len({s.dim for s in self.shapes}) != 1:
            raise ValueError("all blocks of a library must have the same dimension")
        self.dim = self.shapes[0].dim
        self.n_species = len(self.shapes)
        self.stride = max(s.n_sites for s in self.shapes)
        per_species = face_labels is not None and len(face_labels) > 0 and not np.isscalar(face_labels[0])
        self.vertex_colors, self.site_colors, self.offsets = [], [], []
        last_color = last_label = 0
        for k, shape in enumerate(self.shapes):
            labels = face_labels[k] if per_species else face_labels
            labels = list(range(1, shape.n_sites + 1)) if labels is None else [int(v) for v in labels]
            if len(labels) == shape.n_sites and shape.n_vertices != shape.n_sites:
                labels = [c for c, v in zip(labels, shape.site_vertices) for _ in range(v)]
            if len(labels) != shape.n_vertices:
                raise ValueError(f"species {k + 1} needs {shape.n_sites} or {shape.n_vertices} face labels")
            dense = {c: i for i, c in enumerate(sorted(set(labels)), last_color + 1)}  # only equality of face labels matters
            colors = [dense[c] for c in labels]
            firsts = np.cumsum([0, *shape.site_vertices[:-1]])
            self.vertex_colors.append(colors)
            self.site_colors.append([colors[f] for f in firsts])
            self.offsets.append(last_label)
            last_color, last_label = max(colors), last_label + shape.n_sites
        self.n_labels = last_label
        self.classes = classes or [[0] * s.n_sites for s in self.shapes]
        self.tables = self._tables()
        #: sites are pairwise distinguishable
        self.distinct_sites = all(len(r) == 1 for r in self.tables.roots)
        #: two bonds that fill the same place may leave a block in different orientations: in space, unless all look alike
        self.twists = self.dim == 3 and any(len(r) < s.n_vertices for r, s in zip(self.tables.roots, self.shapes))
        #: canonical arrays are their own exact key: nothing looks alike, or every site is one vertex and can be renumbered
        self.exact_arrays = self.distinct_sites or self.tables.fan == 1
        flat = [c for row in self.site_colors for c in row]
        #: face labels name single sites, in the order of the sites
        self.plain_colors = flat == list(range(1, self.n_labels + 1))
        alike = self.label_classes()
        #: sites of one face label are always turned into each other by a symmetry of their block
        self.colors_are_classes = len(set(flat)) == len(set(alike))

    def label_classes(self) -> list[int]:
        """Per label, the smallest label of the same species its block's symmetries reach."""
        t, out = self.tables, []
        for k, shape in enumerate(self.shapes):
            for s in range(shape.n_sites):
                out.append(self.offsets[k] + min(int(t.canon_site[frame, s]) for frame in t.roots[k]) + 1)
        return out

    def split_by_rules(self, rules) -> "BlockLibrary":
        """This library, with look-alike sites told apart where the rules treat them differently.

        Sites stay alike only while each can bind the same kinds of sites: kinds are split until
        all labels of a kind have partners of the same kinds.  ``rules`` are label pairs, both ways.
        """
        library = self
        while True:
            kinds = library.label_classes()
            met = [sorted({kinds[j - 1] for i, j in rules if i == label}) for label in range(1, self.n_labels + 1)]
            names = {}
            signs = [names.setdefault((kind, *near), len(names)) for kind, near in zip(kinds, met)]
            if len(names) == len(set(kinds)):
                return library
            classes = [signs[at:at + s.n_sites] for at, s in zip(self.offsets, self.shapes)]
            library = BlockLibrary(self.shapes, self.face_labels, classes)

    @classmethod
    def uniform(cls, shape: Shape, n_species: int, face_labels=None) -> "BlockLibrary":
        return cls([shape] * n_species, face_labels)

    def site_rows(self):
        """One row per (species, site); the literal form of the library's site table."""
        for k, shape in enumerate(self.shapes):
            for s in range(shape.n_sites):
                yield (k + 1, s + 1, shape.name, self.offsets[k] + s + 1, self.site_colors[k][s],
                       shape.site_vertices[s], shape.sites[s], shape.refs[s], shape.turns[s],
                       shape.r_min, shape.r_max)

    def _tables(self) -> SimpleNamespace:
        """Dense lookup arrays (0-based inside, padded to the stride) for the Arrow helpers."""
        m, k = self.stride, self.n_species
        t = SimpleNamespace(stride=m, width=max(s.n_vertices for s in self.shapes),
                            fan=max(max(s.site_vertices) for s in self.shapes), dim=self.dim)
        t.sites, t.refs, t.turns = np.zeros((k, m, 3)), np.zeros((k, m, 4)), np.zeros((k, m, 4))
        t.label, t.color = np.zeros((k, m), np.int16), np.zeros((k, m), np.int16)  # colours as dense numbers
        t.r_min, t.r_max = np.zeros(k), np.zeros(k)
        t.first, t.fan_of = np.zeros((k, m), int), np.zeros((k, m), int)
        t.species_of, t.site_of = np.zeros(self.n_labels + 1, int), np.zeros(self.n_labels + 1, int)
        for i, s in enumerate(self.shapes):
            n = s.n_sites
            t.sites[i, :n], t.refs[i, :n], t.turns[i, :n] = s.sites, s.refs, s.turns
            t.label[i, :n] = self.offsets[i] + np.arange(1, n + 1)
            t.species_of[t.label[i, :n]], t.site_of[t.label[i, :n]] = i, np.arange(n)
            t.color[i, :n] = self.site_colors[i]
            t.r_min[i], t.r_max[i] = s.r_min, s.r_max
            t.fan_of[i, :n] = s.site_vertices
            t.first[i, :n] = np.cumsum([0, *s.site_vertices[:-1]])

        # Vertex pairing of two touching sites: reversed, strided when one side is a multiple
        # of the other, first with first otherwise.  -1 marks a vertex left unpaired.
        t.pairing = np.full((t.fan + 1, t.fan + 1, t.fan), -1)
        for a in range(1, t.fan + 1):
            for b in range(1, t.fan + 1):
                for i, j in paired_positions(a, b):
                    t.pairing[a, b, i] = j

        # Colour-preserving block symmetries ("frames"), numbered across the library.
        canon_vertex, site_at, canon_site, entry = [], [], [], []
        t.roots, t.frame_at = [], np.zeros((k, t.width), int)
        cache: dict = {}
        for i, s in enumerate(self.shapes):
            if s not in cache:
                cache[s] = block_symmetries(s)
            colors = list(zip(self.vertex_colors[i], np.repeat(self.classes[i], s.site_vertices).tolist()))
            group = [h for h in cache[s] if all(colors[v] == colors[h[v]] for v in range(s.n_vertices))]
            site_of = np.repeat(np.arange(s.n_sites), s.site_vertices)
            base = len(canon_vertex)
            t.roots.append(np.arange(base, base + len(group)))
            for h in group:
                back = np.argsort(h)
                canon_vertex.append(np.pad(h, (0, t.width - len(h))))
                where = [site_of[back[t.first[i, j]]] for j in range(s.n_sites)]
                site_at.append(np.pad(where, (0, m - s.n_sites), constant_values=-1))
                canon_site.append(np.pad(np.argsort(where), (0, m - s.n_sites)))
                # vertex of the actual site that carries the bond, per partner vertex count
                slot = np.zeros((m, t.fan + 1, 2), int)
                for j in range(s.n_sites):
                    for b in range(1, t.fan + 1):
                        for step in range(s.site_vertices[j]):
                            at = back[t.first[i, j] + step] - t.first[i, where[j]]
                            if t.pairing[s.site_vertices[j], b, at] >= 0:
                                slot[j, b] = at, step
                                break
                entry.append(slot)
            for v in range(s.n_vertices):
                images = [h[v] for h in group]
                if images.count(min(images)) > 1:
                    raise ValueError(f"template graph of {s.name} has a symmetry that fixes a vertex")
                t.frame_at[i, v] = base + int(np.argmin(images))
        t.canon_vertex, t.site_at = np.array(canon_vertex), np.array(site_at)
        t.canon_site, t.entry = np.array(canon_site), np.array(entry)
        width = max(map(len, t.roots))
        t.root_table = np.array([np.pad(r, (0, width - len(r)), constant_values=-1) for r in t.roots])
        return t


def paired_positions(a: int, b: int) -> list[tuple[int, int]]:
    """0-based vertex pairs joined when a site with ``a`` vertices meets one with ``b``."""
    if (a == b == 1) or max(a, b) % min(a, b):
        return [(0, 0)]
    step = max(a, b) // min(a, b)
    left = range(a) if a <= b else range(0, a, step)
    right = range(b) if b <= a else range(0, b, step)
    return list(zip(left, reversed(right)))
