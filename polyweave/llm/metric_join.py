"""Exact cosine range join: pivots partition unit vectors, boundaries are replicated, cells join alone.

Where pivots save too little for the replicas they make, the cell stays whole: pairs of its tiles are read from the one written table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components

COSINE = 0.95
#: rows of a cell that is not split by pivots; rows of a tile of a cell that stays larger
CELL_ROWS, TILE_ROWS = 8192, 8192
#: rounds of splitting, pivots of all cells of a round, and vectors that these are fitted on
LEVELS, PIVOTS, SAMPLE = 4, 4096, 16384
#: a cell is split only if the comparisons it would take fall to this share and its rows grow at most to this multiple, as its sample shows
WORTH, COPIES = 0.7, 1.25
#: parts that the tiles are read in, at least if there are as many tiles, and rows of a part of a larger table
PARTS, PART_ROWS = 8, 131072
#: cosines this close to the threshold are computed again from the vectors themselves
CLOSE = 1e-9
#: more than the error of a bound in single precision
ROUGH = 1e-5
#: rows and columns whose products are made at once
BLOCK, WIDE = 128, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors in double precision; components are first scaled by a power of two."""
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    return float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b)))


# --------------------------------------------------------------------------------- pivots

def pivots(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """``k`` points in the middle of groups of the sample; each starts as the sample's vector farthest from those before."""
    points, far = [sample[0]], ((sample - sample[0]) ** 2).sum(1)
    while len(points) < k and far.max() > 0:
        points.append(sample[far.argmax()])
        far = np.minimum(far, ((sample - points[-1]) ** 2).sum(1))
    points = np.array(points)
    for _ in range(rounds):
        at = (sample @ points.T - (points ** 2).sum(1) / 2).argmax(1)
        points = np.array([sample[at == c].mean(0) if (at == c).any() else points[c] for c in range(len(points))])
    return points


def _distances(u: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (u * u).sum(1)[:, None] + (points ** 2).sum(1) - 2 * u @ points.T))


def reach(u: np.ndarray, points: np.ndarray, radii: np.ndarray | None, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector, and a mask of the cells that it has to be compared in.

    A vector within ``radius`` that is at home at pivot j is no farther from j than from i.  By the triangle
    inequality, then, d(x, j) is at most d(x, i) + 2 radius, and in Euclidean space x is within ``radius`` of the
    plane between them; and d(x, j) is at most ``radius`` more than the greatest distance of the cell's own
    vectors.  Of two cells only one, chosen by their numbers, gets the other's vectors.
    """
    d = _distances(u, points)
    home = d.argmin(1)
    own = d[np.arange(len(u)), home]
    between = np.sqrt(np.maximum(0, ((points[:, None] - points) ** 2).sum(2))) if len(points) else np.zeros((0, 0))
    near = (d ** 2 - own[:, None] ** 2 <= 2 * radius * between[home] + 1e-7) & (d <= own[:, None] + 2 * radius + 1e-7)
    if radii is not None:
        near &= d <= radii + radius + 1e-7
    cells = np.arange(len(points))
    gets = (home[:, None] < cells) ^ ((home[:, None] + cells) % 2 == 1)
    near &= gets
    near[np.arange(len(u)), home] = True
    return home, near


def _work(home: np.ndarray, near: np.ndarray) -> float:
    """Comparisons within the cells as a share of those of all pairs."""
    own, all_rows = np.bincount(home, minlength=near.shape[1]).astype(float), near.sum(0)
    return float((own * (all_rows - own / 2)).sum() / (len(home) ** 2 / 2))


def _split(rows: DataFrame, level: int, radius: float, cell_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """``rows(cell, mask, node, w, v)`` of the large cells that are divided, dealt to their parts, and the rows of all others;
    None if none is divided.

    ``mask`` has a bit for each level at which the row is a replica.  Two rows of a cell are compared there
    unless both are replicas of the same level, so every pair within ``radius`` meets exactly once.  A cell is divided
    if a sample shows that this saves comparisons and makes few replicas; so a level adds at most ``COPIES`` rows for one.
    """
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    large = sizes.orderBy(F.desc("n"), "cell").limit(PIVOTS // 2).collect()
    if not large:
        return None
    each = SAMPLE // len(large)
    rate = F.element_at(F.create_map(*[F.lit(x) for r in large for x in (r["cell"], each / r["n"])]), F.col("cell"))
    chance = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(chance < rate).select("cell", "v").limit(2 * SAMPLE).toArrow()
    names = np.array(drawn.column("cell").to_pylist())
    models = {}
    for r in large:
        part = drawn.filter(pa.array(names == r["cell"])) if len(names) else drawn
        k = min(-(-r["n"] // cell_rows), PIVOTS // len(large), max(1, len(part) // 8))
        if k > 1:
            sample = units(_matrix(part.column("v").combine_chunks()))
            points = pivots(sample, k)
            if len(points) > 1:
                at, near = reach(sample, points, None, radius)
                if _work(at, near) < WORTH and near.sum() <= COPIES * len(sample):
                    models[r["cell"]] = points
    if not models:
        return None

    def home(batches):
        most = {c: np.full(len(p), -1.0) for c, p in models.items()}
        for batch in batches:
            for cell, at in _parts(batch.column(0)):
                if cell in models:
                    d = _distances(units(_matrix(batch.column(1).take(pa.array(at)))), models[cell])
                    np.maximum.at(most[cell], d.argmin(1), d.min(1))
        found = [(c, i, float(x)) for c, m in most.items() for i, x in enumerate(m) if x >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.float64()))],
                                         ["cell", "at", "d"])

    radii = {c: np.full(len(p), -9.0) for c, p in models.items()}
    inside = rows.where(F.col("cell").isin(*models))
    for cell, at, d in inside.select("cell", "v").mapInArrow(home, "cell string, at int, d double").groupBy("cell", "at").agg(F.max("d")).collect():
        radii[cell][at] = d

    def deal(batches):
        for batch in batches:
            for cell, at in _parts(batch.column(0)):
                part = batch.take(pa.array(at))
                own, near = reach(units(_matrix(part.column(4))), models[cell], radii[cell], radius)
                row, to = np.nonzero(near)
                part = part.take(pa.array(row))
                mask = part.column(1).to_numpy() | ((own[row] != to).astype(np.int64) << level)
                yield pa.RecordBatch.from_arrays([pa.array([f"{cell}/{c}" for c in to], pa.string()), pa.array(mask), *part.columns[2:]],
                                                 ["cell", "mask", "node", "w", "v"])

    return inside.mapInArrow(deal, rows.schema), rows.where(~F.col("cell").isin(*models))


def _parts(cells: pa.Array):
    """Each value of the column with the positions of its rows."""
    code = cells.dictionary_encode()
    numbers = code.indices.to_numpy(zero_copy_only=False)
    for k, cell in enumerate(code.dictionary.to_pylist()):
        yield cell, np.flatnonzero(numbers == k)


# ---------------------------------------------------------------------------------- cells

@lru_cache(maxsize=8)
def _axes(d: int, k: int) -> np.ndarray:
    """``k`` perpendicular directions without regard to the axes."""
    return np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0][:, :k]


def heads(u: np.ndarray) -> np.ndarray | None:
    """Columns in single precision whose products bound the cosines of unit vectors from above: a third of the turned coordinates
    and the length of the rest.  None for short vectors."""
    k = u.shape[1] // 3
    if k < 8:
        return None
    turned = u @ _axes(u.shape[1], k)
    rest = np.sqrt(np.maximum(0, 1 - (turned * turned).sum(1)))
    return np.column_stack([turned, rest]).astype(np.float32)


def _near(a: np.ndarray, b: np.ndarray, head_a, head_b, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two blocks of unit vectors whose cosine may be ``least``, and these cosines."""
    if head_a is not None:
        r, c = np.divmod(np.flatnonzero(head_a @ head_b.T >= least - ROUGH), len(b))
        if len(r) <= len(a) * len(b) // 32:
            cos = np.einsum("ij,ij->i", a[r], b[c])
            hit = cos >= least - CLOSE
            return r[hit], c[hit], cos[hit]
    cos = a @ b.T
    r, c = np.nonzero(cos >= least - CLOSE)
    return r, c, cos[r, c]


def compare(v: np.ndarray, nodes: np.ndarray, weights: np.ndarray, masks: np.ndarray, least: float, split: int = 0):
    """Of the rows of a task: how many vectors each links to, and the least node of its group here.

    With ``split`` only rows before it are compared with those from there on, else all with each other.
    """
    u, n = units(v), len(v)
    head = heads(u)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, split or n, BLOCK):
        end = min(at + BLOCK, split or n)
        for low in range(split or at, n, WIDE):
            high = min(low + WIDE, n)
            r, c, cos = _near(u[at:end], u[low:high], *((None, None) if head is None else (head[at:end], head[low:high])), least)
            r, c = r + at, c + low
            fits = ((masks[r] & masks[c]) == 0) & (r < c)
            for k in np.flatnonzero(fits & (np.abs(cos - least) <= CLOSE)):
                fits[k] = cosine(v[r[k]], v[c[k]]) >= least
            r, c = r[fits], c[fits]
            np.add.at(counts, r, weights[c])
            np.add.at(counts, c, weights[r])
            for i, near in zip(np.unique(r), np.split(c, np.flatnonzero(np.diff(r)) + 1)):
                found = np.unique(root[np.append(near, i)])
                if len(found) > 1:
                    root[np.isin(root, found)] = found[0]
    least_node = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least_node, root, nodes)
    return counts, least_node[root]


def _linked(nodes: np.ndarray, counts: np.ndarray, top: np.ndarray) -> list[pa.Array]:
    hit = counts > 0
    return [pa.array(nodes[hit]), pa.array(counts[hit]), pa.array(top[hit])]


def _tiled(rows: DataFrame, tasks: int, tile_rows: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``rows(cell, mask, node, w, v, ...)`` in tiles: a row ``(cell, mask, tile, node, w, v, ...)`` for up to ``tile_rows`` rows of a
    cell and mask.  Numbers are packed, ``also`` are lists.  Without a node, rows are numbered.  The table is written once."""
    single = _element(rows) == "float"
    numbered = "node" not in rows.columns

    def run(batches):
        held, next_node = {}, TaskContext.get().partitionId() << 33

        def tile(key, table):
            nonlocal next_node
            first = next_node
            next_node += len(table)
            node = np.arange(first, next_node) if numbered else table.column("node").to_numpy()
            values = _matrix(table.column("v").combine_chunks()).astype(np.float32 if single else np.float64)
            packed = [node.astype(np.int64).tobytes(), table.column("w").to_numpy().astype(np.int64).tobytes(), values.tobytes()]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in also]
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()),
                                               *(pa.array([x], pa.binary()) for x in packed), *lists], ["cell", "mask", "tile", "node", "w", "v", *also])

        for batch in batches:
            for cell, at in _parts(batch.column(0)):
                part = batch.take(pa.array(at))
                masks = part.column(1).to_numpy()
                for mask in np.unique(masks).tolist():
                    key, more = (cell, mask), pa.Table.from_batches([part.filter(pa.array(masks == mask))])
                    more = pa.concat_tables([held[key], more]) if key in held else more
                    while len(more) >= tile_rows:
                        yield tile(key, more.slice(0, tile_rows))
                        more = more.slice(tile_rows)
                    held[key] = more
        for key, more in held.items():
            if len(more):
                yield tile(key, more)

    lists = "".join(f", {c} array<{rows.schema[c].dataType.simpleString()}>" for c in also)
    tiles = settle(rows.coalesce(tasks).mapInArrow(run, f"cell string, mask long, tile long, node binary, w binary, v binary{lists}"))
    return tiles if tiles.rdd.getNumPartitions() >= tasks else tiles.repartition(tasks)


def _tasks(n: int, tile_rows: int) -> int:
    return max(1, min(-(-n // tile_rows), PARTS), -(-n // PART_ROWS))


def _element(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.elementType.simpleString()


def _untiled(tiles: DataFrame, element: str) -> DataFrame:
    """``(cell, mask, node, w, v)`` of the rows of tiles."""
    dtype = np.float32 if element == "float" else np.float64

    def run(batches):
        for batch in batches:
            for cell, mask, node, w, v in zip(*(batch.column(c) for c in ("cell", "mask", "node", "w", "v"))):
                node, w, v = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((node, np.int64), (w, np.int64), (v, dtype)))
                n, d = len(node), len(v) // len(node)
                for at in range(0, n, 4096):
                    m = min(4096, n - at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell.as_py()] * m, pa.string()), pa.array([mask.as_py()] * m, pa.int64()), pa.array(node[at:at + m]), pa.array(w[at:at + m]),
                         pa.ListArray.from_arrays(np.arange(0, m * d + 1, d, dtype=np.int32), pa.array(v[at * d:(at + m) * d]))], ["cell", "mask", "node", "w", "v"])

    return tiles.select("cell", "mask", "node", "w", "v").mapInArrow(run, f"cell string, mask long, node long, w long, v array<{element}>")


def _met(tiles: DataFrame, element: str, least: float) -> DataFrame:
    """``(node, n, top)`` of the rows that link to anything, by pairs of tiles of a cell.

    Tasks read two parts of the written tiles each and nothing is dealt out again, so rows aren't copied on disk
    however many tiles they meet.
    """
    dtype = np.float32 if element == "float" else np.float64
    one, two = (tiles.select(*[F.col(c).alias(f"{c}{k}") for c in ("cell", "mask", "tile", "node", "w", "v")]) for k in (1, 2))
    even = (F.xxhash64("tile1").bitwiseXOR(F.xxhash64("tile2"))).bitwiseAND(F.lit(1)) == 0
    meet = ((F.col("cell1") == F.col("cell2")) & (F.col("mask1").bitwiseAND(F.col("mask2")) == 0)
            & ((F.col("tile1") == F.col("tile2")) | ((F.col("tile1") < F.col("tile2")) == even) & (F.col("tile1") != F.col("tile2"))))
    pairs = one.hint("shuffle_replicate_nl").join(two, meet).select("tile1", "node1", "w1", "v1", "mask1", "tile2", "node2", "w2", "v2", "mask2")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in pairs_columns}
                parts = [[np.frombuffer(at[f"{c}{k}"].as_buffer(), kind) for c, kind in (("node", np.int64), ("w", np.int64), ("v", dtype))] for k in (1, 2)]
                same = at["tile1"].as_py() == at["tile2"].as_py()
                parts = parts[:1] if same else parts
                node, w, v = (np.concatenate(x) for x in zip(*parts))
                masks = np.repeat([at["mask1"].as_py(), at["mask2"].as_py()][:len(parts)], [len(p[0]) for p in parts])
                found = compare(v.reshape(len(node), -1).astype(np.float64), node, w, masks, least, 0 if same else len(parts[0][0]))
                yield pa.RecordBatch.from_arrays(_linked(node, *found), ["node", "n", "top"])

    pairs_columns = pairs.columns
    return pairs.mapInArrow(run, "node long, n long, top long")


def _whole(rows: DataFrame, least: float) -> DataFrame:
    """``(node, n, top)`` of the rows that link to anything; each cell is compared in one task."""
    def join(table):
        node, w, mask = (table.column(c).to_numpy() for c in ("node", "w", "mask"))
        return pa.table(_linked(node, *compare(_matrix(table.column("v").combine_chunks()), node, w, mask, least)), ["node", "n", "top"])

    return rows.groupBy("cell").applyInArrow(join, "node long, n long, top long")


def range_join(tiles: DataFrame, element: str, n: int, least: float = COSINE, cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(node, n, root)`` for each of the distinct nodes of ``tiles`` (of ``n`` rows in all) with a link:
    the total ``w`` of the nodes it links to, and the least node of its component."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    rows, parts = _untiled(tiles, element), []
    for level in range(LEVELS):
        found = _split(rows, level, radius, cell_rows)
        if found is None:
            break
        rows = settle(found[0])
        parts.append(found[1])
    if parts:
        for other in parts:
            rows = rows.unionByName(other)
        large = settle(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile_rows))
        n = int(large.agg(F.sum("n")).first()[0] or 0)
        found = _whole(rows.join(F.broadcast(large.select("cell")), "cell", "left_anti").select("cell", "mask", "node", "w", "v"), least)
        if n:
            inside = rows.join(F.broadcast(large.select("cell")), "cell", "left_semi").select("cell", "mask", "node", "w", "v")
            found = found.unionByName(_met(_tiled(inside, _tasks(n, tile_rows), tile_rows), element, least))
    else:
        found = _met(tiles, element, least)
    found = settle(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")))
    return found.groupBy("node").agg(F.sum("n").alias("n")).join(roots, "node")


def near_duplicates(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Two vectors are linked if their cosine in double precision is ``least`` or more.  Vectors that are null, empty, zero or
    hold a null, NaN or infinite component link with nothing and are their own component; so do vectors of different
    length with each other.  Repeated rows are vectors of their own, linked with each other; ties of ids
    therefore keep each row.  A null id keeps its row, is never the smallest and never kept.  Other columns are
    ignored; an empty table gives no row.

    Equal vectors are compared once and counted by their number.  Every other pair within the range meets in one cell,
    where links are counted, not listed; a forest of them gives the components.  Vectors go through one shuffle, that finds
    equal ones, and are written once, in tiles; cells that are divided by pivots add their rows once more.
    """
    x, element = F.col(vector_col), vectors.schema[vector_col].dataType.elementType.simpleString()
    element = element if element == "float" else "double"
    ok = F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                    & F.exists(x, lambda c: c != 0), F.lit(False))
    zero = F.lit(0.0).cast(element)  # minus zero is made zero
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, F.transform(x, lambda c: c.cast(element) + zero)).alias("v"))
    keyed = rows.where("v is not null").select("vec_id", "v", F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("key"))
    counted = keyed.groupBy("key", "v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first"))
    tile_rows = options.get("tile_rows", TILE_ROWS)
    n = vectors.count()
    tiles = _tiled(counted.select(F.size("v").cast("string").alias("cell"), F.lit(0).cast("long").alias("mask"), "w", "v", "key", "first"),
                   _tasks(n, tile_rows), tile_rows, ("key", "first"))
    linked = range_join(tiles, element, n, least, **options)

    def facts(batches):
        for batch in batches:
            for node, w, key, first in zip(*(batch.column(c) for c in ("node", "w", "key", "first"))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (node, w)] + [key.values, first.values],
                                                 ["node", "w", "key", "first"])

    nodes = tiles.select("node", "w", "key", "first").mapInArrow(facts, "node long, w long, key binary, first long")
    groups = settle(nodes.select("node", "first").join(linked, "node").select("node", "n", "root", "first"))
    ids = groups.groupBy("root").agg(F.min("first").alias("least"))
    of = groups.join(ids, "root").select("node", "n", "least")
    known = nodes.join(of, "node", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                                                  F.when(F.col("n").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    with_links = keyed.select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
