"""Plain SQL (DuckDB dialect) that recounts structures as sets of lattice cells.

Nothing here is shared with the engine but fixed values: structures are sorted cell lists on integer lattices
and two structures are the same when a lattice rotation and a shift make the lists equal.
A cell is ``[a, b, (c,) orientation, species]``.
"""

from __future__ import annotations

from .blocks import CUBE_REFS, CUBE_TURNS
from .sources.tables import CUSTOMER_BOND, DAY_BOND, ORDER_BOND, TALK_BOND

HEX_STEPS = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]
SQUARE_STEPS = [(0, -1), (1, 0), (0, 1), (-1, 0)]
CUBE_STEPS = [(1, 0, 0), (0, 0, -1), (0, 1, 0), (0, 0, 1), (0, -1, 0), (-1, 0, 0)]


def bonds_sql(table: str, columns: dict) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


def hex_turn(r: int) -> tuple:
    a, b = (1, 0), (0, 1)
    for _ in range(r):
        a, b = (-b[0], -b[1]), (a[0] + b[0], a[1] + b[1])
    return a, b


def square_turn(r: int) -> tuple:
    a, b = (1, 0), (0, 1)
    for _ in range(r):
        a, b = (-b[0], -b[1]), a
    return a, b


def cube_turns() -> list:
    """All 24 proper signed permutation matrices."""
    from itertools import permutations, product
    out = []
    for p in permutations(range(3)):
        sign = 1 if p in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1
        for s in product((1, -1), repeat=3):
            if s[0] * s[1] * s[2] * sign == 1:
                out.append(tuple(tuple(s[i] if j == p[i] else 0 for j in range(3)) for i in range(3)))
    return out


def linear(row, cell: str = "e") -> str:
    return "(" + " + ".join(f"({c}) * {cell}[{j + 1}]" for j, c in enumerate(row) if c) + ")"


class Lattice:
    """``sites`` faces per block; ``alike`` makes all faces of a block interchangeable.  With
    ``colors``, a face label per site, contacts are allowed by these labels."""

    def __init__(self, shape: str, alike: bool = False, colors=None):
        self.shape, self.alike, self.colors = shape, alike, colors
        self.sites = {"triangle": 3, "square": 4, "hexagon": 6, "cube": 6}[shape]
        self.steps = {"triangle": HEX_STEPS, "hexagon": HEX_STEPS, "square": SQUARE_STEPS, "cube": CUBE_STEPS}[shape]
        self.dim = 3 if shape == "cube" else 2
        self.k, self.s = self.dim + 1, self.dim + 2      # list positions of orientation, species
        self.turns = len(self.steps) if shape != "cube" else 4
        self.per = 2 if shape == "triangle" else 1      # lattice turns per site

    # -- one cell

    def position(self, m: str, cell: str) -> list[str]:
        """Cell next to ``cell`` across face ``m``."""
        pick = lambda i, at: f"[{', '.join(str(s[i]) for s in self.steps)}][{at}]"
        if self.shape == "cube":
            return [f"({cell}[{i + 1}] + {self.sign(i, cell)} * {pick(i, m)})" for i in range(3)]
        d = f"(({cell}[{self.k}] + 12 - {self.per} * ({m} - 1)) % {self.turns} + 1)"
        return [f"({cell}[{i + 1}] + {pick(i, d)})" for i in range(2)]

    def sign(self, i: int, cell: str) -> str:
        """Cube orientation bits: 1 turns about z, 2 turns about x (both by 180 degrees)."""
        z, x = f"({cell}[4] % 2)", f"({cell}[4] // 2)"
        return {0: f"(1 - 2 * {z})", 1: f"(1 - 2 * (({z} + {x}) % 2))", 2: f"(1 - 2 * {x})"}[i]

    def orientation(self, i: str, j: str, cell: str) -> str:
        if self.alike:
            return f"(1 - {cell}[{self.k}])" if self.shape == "triangle" else "0"
        if self.shape == "cube":
            return f"xor({cell}[4], [1, 2, 1, 2, 1, 1][{i}])"
        return (f"(({cell}[{self.k}] + 12 - {self.per} * ({i} - 1) + {self.per} * ({j} - 1) + {self.turns // 2})"
                f" % {self.turns})")

    def face(self, cell: str, delta: list[str]) -> str:
        """Face number of ``cell`` in direction ``delta``, NULL when not a neighbour."""
        if self.shape == "cube":
            body = ", ".join(f"({delta[i]}) * {self.sign(i, cell)}" for i in range(3))
            return f"list_position({[list(s) for s in self.steps]}, [{body}])"
        d = f"list_position({[list(s) for s in self.steps]}, [{', '.join(delta)}])"
        if self.shape == "triangle":
            return f"(({cell}[{self.k}] - {d} + 1 + 12) % 6 // 2 + 1)"
        return f"(({cell}[{self.k}] - {d} + 1 + 12) % {self.turns} + 1)"

    # -- whole structures

    def images(self) -> list[str]:
        """Cell list under every lattice rotation."""
        if self.shape == "cube":
            if self.alike:
                maps = [([linear(r) for r in m], "0") for m in cube_turns()]
            else:
                maps = [([f"({s} * e[{i + 1}])" for i, s in enumerate(signs)], f"xor(e[4], {bits})")
                        for bits, signs in ((0, (1, 1, 1)), (1, (-1, -1, 1)), (2, (1, -1, -1)), (3, (-1, 1, -1)))]
        else:
            turn = square_turn if self.shape == "square" else hex_turn
            mod = 2 if self.alike and self.shape == "triangle" else 1 if self.alike else self.turns
            maps = [([linear(r) for r in turn(t)], f"((e[3] + {t}) % {mod})") for t in range(self.turns)]
        return [f"[[{', '.join(pos)}, {k}, e[{self.s}]] for e in cells]" for pos, k in maps]

    def variants(self) -> str:
        """List of the cell list's images, each sorted and shifted to put its first cell at 0."""
        shift = ", ".join(f"e[{i + 1}] - q[1][{i + 1}]" for i in range(self.dim))
        images = ", ".join(f"list_sort({im})" for im in self.images())
        return f"[[[{shift}, e[{self.k}], e[{self.s}]] for e in q] for q in [{images}]]"

    def enumeration(self, bonds: str, max_size: int) -> str:
        """CTEs ending in ``forms(sys, n, cells)``: one row per distinct structure."""
        m, s = self.sites, self.s
        if self.alike:
            pairs = ("SELECT DISTINCT sys, a AS li, b AS lj, a AS si, b AS sj, t AS ti, t AS tj FROM ("
                     "SELECT sys, species_i AS a, species_j AS b FROM bonds UNION SELECT sys, species_j, species_i "
                     f"FROM bonds) p, range(1, {m + 1}) f(t)")
        else:
            pairs = ("SELECT DISTINCT sys, (a - 1) * {m} + i AS li, (b - 1) * {m} + j AS lj, a AS si, b AS sj, i AS ti, "
                     "j AS tj FROM (SELECT sys, species_i AS a, site_i AS i, species_j AS b, site_j AS j FROM bonds UNION "
                     "SELECT sys, species_j, site_j, species_i, site_i FROM bonds) p").replace("{m}", str(m))
        # code of a face for contacts: its label, or its face label where these are given
        top = max(self.colors or [m])
        code = lambda species, face: f"(({species}) - 1) * {top} + {f'{list(self.colors)}[{face}]' if self.colors else face}"
        new = [*self.position("r.ti", "c"), self.orientation("r.ti", "r.tj", "c"), "r.sj"]
        if self.alike and self.shape == "triangle":
            open_face = f"(c[{self.k}] + 12 - 2 * (r.ti - 1)) % 6 % 2 = c[{self.k}] % 2"
        else:
            open_face = "true"
        delta = lambda a, b: [f"{a}[{i + 1}] - {b}[{i + 1}]" for i in range(self.dim)]
        taken = " AND ".join(f"e[{i + 1}] = f[{i + 1}]" for i in range(self.dim))
        if self.alike:
            near = f"list_contains({[list(x) for x in self.steps]}, [{', '.join(delta('f', 'e'))}])"
            bad = f"{near} AND NOT list_contains(codes, e[{s}] * 100 + f[{s}])"
        else:
            here, there = self.face("e", delta("f", "e")), self.face("f", delta("e", "f"))
            bad = (f"{here} IS NOT NULL AND NOT list_contains(codes, ({code(f'e[{s}]', here)}) * 100 "
                   f"+ {code(f'f[{s}]', there)})")
        codes = f"({code('si', 'ti')}) * 100 + {code('sj', 'tj')}" if self.colors else "li * 100 + lj"
        zero = "[" + ", ".join(["0"] * (self.dim + 1)) + ", k]"
        return f"""
bonds AS ({bonds}),
top AS (SELECT sys, max(greatest(species_i, species_j)) AS n_species FROM bonds GROUP BY sys),
pairs AS ({pairs}),
rules AS (SELECT sys, list(DISTINCT {codes}) AS codes FROM pairs GROUP BY sys),
lv(sys, n, cells) AS (
  SELECT sys, 1, [{zero}] FROM (SELECT sys, unnest(range(1, n_species + 1)) AS k FROM top)
  UNION
  SELECT sys, n + 1, list_min({self.variants()}) FROM (
    SELECT sys, n, list_append(cells, f) AS cells FROM (
      SELECT o.sys, o.n, o.cells, o.codes, [{', '.join(new)}] AS f
      FROM (SELECT lv.sys, n, cells, codes, unnest(cells) AS c FROM lv JOIN rules ON rules.sys = lv.sys
            WHERE n < {max_size}) o
      JOIN pairs r ON r.sys = o.sys AND r.si = o.c[{s}] AND {open_face})
    WHERE len([1 for e in cells if {taken}]) = 0 AND len([1 for e in cells if {bad}]) = 0)
),
forms AS (SELECT sys, n, cells FROM lv)"""

    def sigma(self) -> str:
        """Number of lattice rotations that keep ``cells``."""
        return f"len([1 for z in {self.variants()} if z = cells])"


def rotation_matrix(q) -> tuple:
    """Integer matrix of a quaternion, of any length, that turns the axes into each other."""
    w, x, y, z = q
    n = w * w + x * x + y * y + z * z
    rows = ((w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)),
            (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)),
            (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z))
    return tuple(tuple(v // n for v in row) for row in rows)


class TurnedCubes(Lattice):
    """Cubes whose faces are all different and which may be bound by any two of them, so that a block can stand in
    any of 24 ways; an orientation is the place of its matrix in :func:`cube_turns`."""

    def __init__(self):
        super().__init__("cube")
        times = lambda a, b: tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))
        apply = lambda m, p: tuple(sum(m[i][k] * p[k] for k in range(3)) for i in range(3))
        one = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
        self.matrices = all_turns = [one, *[m for m in cube_turns() if m != one]]   # a single block has orientation 0
        number = {m: k for k, m in enumerate(all_turns)}
        turned = [[times(rotation_matrix(t), rotation_matrix(r)) for r in CUBE_REFS] for t in CUBE_TURNS]
        #: step across each face, number of the block bound there, face in each direction, product of turns
        self.across = [[list(apply(m, p)) for p in self.steps] for m in all_turns]
        self.bound = [[[number[times(m, d)] for d in row] for row in turned] for m in all_turns]
        self.facing = [[1 + [apply(m, p) for p in self.steps].index(d) for d in self.steps] for m in all_turns]
        self.product = [[number[times(g, m)] for m in all_turns] for g in all_turns]

    def position(self, m, cell):
        return [f"({cell}[{i + 1}] + {self.across}[{cell}[4] + 1][{m}][{i + 1}])" for i in range(3)]

    def orientation(self, i, j, cell):
        return f"{self.bound}[{cell}[4] + 1][{i}][{j}]"

    def face(self, cell, delta):
        return f"{self.facing}[{cell}[4] + 1][list_position({[list(p) for p in self.steps]}, [{', '.join(delta)}])]"

    def images(self):
        return [f"[[{', '.join(linear(r) for r in m)}, {row}[e[4] + 1], e[5]] for e in cells]" for m, row in zip(self.matrices, self.product)]


def boxes(bonds: str, axis_of_site: list[int], max_size: int) -> str:
    """CTEs ending in ``forms(sys, n, cells)`` for boxes (rectangles with two axes) whose edges differ and whose
    opposite faces are alike.  A bond row lets two species touch across the axis of ``site_i``; a cell is
    ``[a, b, (c,) species]`` and structures are the same up to half-turns of the box and shifts."""
    dim = max(axis_of_site)
    steps = [[s * (i == axis) for i in range(dim)] for axis in range(dim) for s in (1, -1)]   # two a axis, in order
    s = dim + 1
    delta = ", ".join(f"f[{i + 1}] - e[{i + 1}]" for i in range(dim))
    axis = f"(list_position({steps}, [{delta}]) + 1) // 2"
    signs = [(1, 1), (-1, -1)] if dim == 2 else [(1, 1, 1), (-1, -1, 1), (1, -1, -1), (-1, 1, -1)]
    images = ", ".join(f"list_sort([[{', '.join(f'{v} * e[{i + 1}]' for i, v in enumerate(sg))}, e[{s}]] for e in cells])" for sg in signs)
    shift = ", ".join(f"e[{i + 1}] - q[1][{i + 1}]" for i in range(dim))
    moved = ", ".join(f"c[{i + 1}] + {steps}[d][{i + 1}]" for i in range(dim))
    return f"""
bonds AS ({bonds}),
top AS (SELECT sys, max(greatest(species_i, species_j)) AS n_species FROM bonds GROUP BY sys),
pairs AS (SELECT sys, {axis_of_site}[site_i] AS axis, species_i AS a, species_j AS b FROM bonds
          UNION SELECT sys, {axis_of_site}[site_i], species_j, species_i FROM bonds),
rules AS (SELECT sys, list(axis * 10000 + a * 100 + b) AS codes FROM pairs GROUP BY sys),
lv(sys, n, cells) AS (
  SELECT sys, 1, [[{', '.join(['0'] * dim)}, k]] FROM (SELECT sys, unnest(range(1, n_species + 1)) AS k FROM top)
  UNION
  SELECT sys, n + 1, list_min([[[{shift}, e[{s}]] for e in q] for q in [{images}]]) FROM (
    SELECT sys, n, list_append(cells, f) AS cells FROM (
      SELECT o.sys, o.n, o.cells, o.codes, [{moved}, r.b] AS f
      FROM (SELECT lv.sys, n, cells, codes, unnest(cells) AS c FROM lv JOIN rules ON rules.sys = lv.sys WHERE n < {max_size}) o
      JOIN pairs r ON r.sys = o.sys AND r.a = o.c[{s}], range(1, {2 * dim + 1}) t(d) WHERE (d + 1) // 2 = r.axis)
    WHERE len([1 for e in cells if [{delta}] = {[0] * dim}]) = 0
      AND len([1 for e in cells if list_contains({steps}, [{delta}]) AND NOT list_contains(codes, {axis} * 10000 + e[{s}] * 100 + f[{s}])]) = 0)
),
forms AS (SELECT sys, n, cells FROM lv)"""


SOURCES = {
    "order": ("lineitem", ORDER_BOND),
    "customer": ("orders", CUSTOMER_BOND),
    "talk": ("conversations", TALK_BOND),
    "day": ("events", DAY_BOND),
}


def source(name: str) -> str:
    return bonds_sql(*SOURCES[name])
