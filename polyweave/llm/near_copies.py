"""Near copies by word shingles: min-hash blocks, exact similarity decided inside the blocks, forests of links."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_slices, free_names, settle, text_bytes
from .components import components
from .simhash import row_key

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: blocks of ROWS of HASHES minima: a pair at similarity 0.8 shares none of them with probability 0.0002
HASHES, ROWS = 64, 4
#: minima that a pair has to share to be looked at; at similarity 0.8 fewer are shared with probability below 0.0001
LOW = 38
#: bands of the first round, which joins most near copies; the second looks at what is left between components
FIRST_BANDS = 2
#: texts of one block whose minima a task compares; larger blocks are compared as pairs of tiles
BLOCK_ROWS = 4096
#: bytes of shingle hashes that a task decides on at once; more are dealt into pairs of parts
PART_BYTES = 16 << 20
#: rows whose products are made at once
BLOCK = 64
#: shingles whose hashes are mixed at once
SLICE = 1 << 12

_random = np.random.default_rng(SEED)
FACTORS, OFFSETS = _random.integers(0, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, words as in ``simhash``; fewer
    words than a shingle form one shingle, no word forms none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + shingle]), SEED) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray) -> bytes:
    """The least of each of HASHES mixtures of the hashes; a set without hashes has the largest values."""
    least = np.full(HASHES, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), SLICE):
        mixed = hashes[at:at + SLICE, None] * FACTORS + OFFSETS >> np.uint64(32)
        least = np.minimum(least, mixed.min(0))
    return least.astype(np.uint32).tobytes()


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, row_key, set, sig, size)`` of every row; texts have the same ``set``, a SHA-256, if they have the same set of shingles."""
    kind = pa.struct([("set", pa.binary()), ("sig", pa.binary()), ("size", pa.int64())])

    def one(text):
        hashes = shingles(text, shingle)
        return {"set": sha256(hashes.tobytes()).digest(), "sig": signature(hashes), "size": hashes.nbytes}

    def run(batches):
        for batch in batches:
            values = by_slices(one, kind, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *values.flatten()], ["doc_id", "row_key", "set", "sig", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key binary, set binary, sig binary, size long")


# ----------------------------------------------------------------------- blocks of minima

def open_parts(roots: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, part_bytes: int = PART_BYTES) -> list[tuple[int, int]]:
    """``(part, row)`` for the rows of a block that may be near a row of another component: that share LOW minima.

    Rows that may be near each other always have a part in common, and a part has about ``part_bytes``
    at most, or two rows.  Only rows are listed, never pairs.
    """
    n = len(roots)
    group = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(((sigs[i + 1:] == sigs[i]).sum(1) >= LOW) & (roots[i + 1:] != roots[i])) + i + 1
        if len(near):
            found = np.unique(group[np.append(near, i)])
            if len(found) > 1:
                group[np.isin(group, found)] = found[0]
    order = np.argsort(group, kind="stable")
    groups = [g for g in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(g) > 1] if n else []
    out, part, held = [], 0, 0
    for g in groups:
        size = int(sizes[g].sum())
        if size <= part_bytes:  # several small groups share a part
            if held + size > part_bytes:
                part, held = part + 1, 0
            held += size
            out += [(part, int(i)) for i in g]
            continue
        at = (np.cumsum(sizes[g]) - 1) // max(1, part_bytes // 2)
        pieces = [g[at == k] for k in np.unique(at)]
        for k, a in enumerate(pieces):
            for b in pieces[k + 1:]:
                part += 1
                out += [(part, int(i)) for i in np.append(a, b)]
        part, held = part + 1, 0
    return out


def _open(keyed: DataFrame, part_bytes: int) -> DataFrame:
    """``(task, node, root)``: the open parts of every block, named by a hash.  Blocks are read in order, so a Spark task
    holds one at a time."""
    def run(batches):
        key, held = None, []

        def close():
            if len(held) < 2:
                return []
            ids, roots, sizes = (np.array([r[i] for r in held], np.int64) for i in (0, 1, 3))
            if (roots == roots[0]).all():
                return []
            sigs = np.frombuffer(b"".join(r[2] for r in held), np.uint32).reshape(-1, HASHES)
            name = ",".join(map(str, key))
            return [(xxhash.xxh64_intdigest(f"{name},{part}", SEED) - (1 << 63), int(ids[i]), int(roots[i])) for part, i in open_parts(roots, sigs, sizes, part_bytes)]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["task", "node", "root"])

        for batch in batches:
            out = []
            for *now, node, root, sig, size in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    out += close()
                    key, held = now, []
                held.append((node, root, sig, size))
            yield rows(out)
        yield rows(close())

    by = ["band", "block", "tile", "tile2"]
    ordered = keyed.repartition(*by).sortWithinPartitions(*by, "node")
    return ordered.mapInArrow(run, "task long, node long, root long")


def _keyed(nodes: DataFrame, bands: range, block_rows: int) -> DataFrame:
    """``(band, block, tile, tile2, node, root, sig, size)`` for each of the bands of each node, where a block has
    nodes of several components; blocks of more than ``block_rows`` are dealt into pairs of tiles."""
    width = 4 * ROWS
    split = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring("sig", k * width + 1, width)).alias("block")) for k in bands])
    rows = nodes.select("node", "root", F.explode(split).alias("k")).select("node", "root", "k.band", "k.block")
    sizes = rows.groupBy("band", "block").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").drop("r", "s")
    dealt = rows.drop("root").join(sizes, ["band", "block"]).withColumn("tiles", F.ceil(F.col("n") / F.lit(max(1, block_rows // 2))).cast("int"))
    dealt = dealt.withColumn("own", F.when(F.col("n") > block_rows, F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")).otherwise(F.lit(0)))
    others = F.when(F.col("n") > block_rows, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
    dealt = dealt.select("node", "band", "block", "own", F.explode(others).alias("other"))
    return dealt.join(nodes, "node").select("band", "block", F.least("own", "other").alias("tile"), F.greatest("own", "other").alias("tile2"),
                                            "node", "root", "sig", "size")


# ------------------------------------------------------------------------- exact decision

def forest(sets: list[np.ndarray], roots: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the components of all pairs of ``sets`` (sorted distinct hashes) with the similarity, where
    ``roots`` are joined already; a row that links to nothing new gives none.

    Two sets with the similarity share the part ``least`` of each.  So, elements in order of how many sets hold them,
    they share one of the first, rarest (1 - least) of either: only sets that do are counted against each other.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    _, code, held = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    order = np.lexsort((code, held[code], row)) if n else row
    code, start = code[order], np.concatenate([[0], np.cumsum(size)])
    by_code = np.argsort(code, kind="stable")
    holders, first = row[by_code], np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
    # elements that many sets hold are counted as a matrix product, at most 16 cells an element of the sets
    heavy = np.flatnonzero(held > max(1, n // 16))
    number = np.full(len(held), -1)
    number[heavy] = np.arange(len(heavy))
    cells = np.zeros((n, len(heavy)), np.float32)
    at = number[code] >= 0
    cells[row[at], number[code[at]]] = 1
    root, links, block, shared = roots.copy(), [], -1, None

    def sharing(codes):
        """Rows that hold each of the codes, with repeats."""
        count = held[codes]
        at = np.repeat(first[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return holders[at]

    for i in range(n):
        own = code[start[i]:start[i + 1]]
        rare = own[:len(own) - int(np.ceil(least * len(own))) + 1]
        near = np.unique(sharing(rare[held[rare] > 1])) if len(own) else np.flatnonzero(size == 0)
        near = near[(near > i) & (root[near] != root[i])]
        near = near[(np.minimum(size[near], size[i]) >= least * np.maximum(size[near], size[i]))]
        if not len(near):
            continue
        if block != i // BLOCK:
            block = i // BLOCK
            shared = cells[block * BLOCK:(block + 1) * BLOCK] @ cells.T
        light = own[(number[own] < 0) & (held[own] > 1)]
        both = shared[i - block * BLOCK, near].astype(np.int64) + np.bincount(sharing(light), minlength=n)[near]
        for j in near[both >= least * (size[i] + size[near] - both)]:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def _decided(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: for the rows of every task a forest of the pairs with the similarity."""
    def decide(table):
        ids, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        links = forest([np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()], roots, least)
        return pa.table([pa.array([int(ids[pair[i]]) for pair in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return found.join(sets, "node").groupBy("task").applyInArrow(decide, "a long, b long")


def _hashes(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(node, hashes)`` for each of the nodes ``asked(node, key)``, from one of its rows."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), by_slices(lambda t: shingles(t, shingle).tobytes(), pa.binary(), batch.column(1))], ["node", "hashes"])

    rows = docs.select(row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    once = rows.join(asked, "key").groupBy("node").agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "node long, hashes binary")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY,
            block_rows: int = BLOCK_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(node, root, first)`` of the distinct sets of shingles: the component's least node, and the least
    (is null, doc_id, row_key) of the rows of the node.

    Blocks of equal minima first list the nodes that may be near another; only these have their texts read again, once,
    and keep their hashes.  The hashes go to the tasks of the blocks, which decide exactly and hand on
    forests of links, at most one a node.  The first bands join most near copies; the others then look only at what
    may be near across components.  So components are those of all pairs that share a block and LOW minima.
    """
    marked = settle(_signed(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    sets = marked.groupBy("set").agg(first.alias("first"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = settle(sets.select(F.monotonically_increasing_id().alias("node"), "first", "sig", "size"))
    every, bands = nodes.withColumn("root", F.col("node")), HASHES // ROWS
    near = settle(_open(_keyed(every, range(bands), block_rows), part_bytes).select("node").distinct())
    asked = nodes.join(near, "node").select("node", F.col("first.row_key").alias("key"))
    sets = settle(_hashes(docs, asked, id_col, text_col, shingle))
    now, links = settle(every.join(near, "node").select("node", "root", "sig", "size")), None
    for part in (range(FIRST_BANDS), range(FIRST_BANDS, bands)):
        found = settle(_decided(_open(_keyed(now, part, block_rows), part_bytes), sets, least))
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        now = settle(now.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return nodes.join(now.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` (columns unchanged) of each group of near copies: that of the smallest doc_id.

    A null doc_id stays only where its group has no other; of texts with the same doc_id in a
    group one stays, and rows that repeat both doc_id and text are merged.  Null texts are empty ones, and all
    texts without words are one group.  An empty table gives no row.
    """
    key, name, n = free_names(docs, "key", "id", "n")
    kept = grouped(docs, id_col, text_col, **options).groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.row_key").alias(key), _named(F.col("first.doc_id")).alias(name))
    rows = docs.withColumn(key, row_key(id_col, text_col)).withColumn(name, _named(F.col(id_col).cast("long")))
    once = Window.partitionBy(key, name).orderBy(key)
    return (rows.join(kept, [key, name], "left_semi").withColumn(n, F.row_number().over(once))
            .where(F.col(n) == 1).select(*docs.columns))


def _named(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-1))
