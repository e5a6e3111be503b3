"""Source divergence audit: group pairs are compared on k-squared quadtrees of their term counts."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, text_bytes

PARTS_PER, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: groups and terms of a tile of the matrix; a task holds two tiles of the same terms
TILE_GROUPS, TILE_TERMS = 64, 16384
#: side of the quadrants at which the tree ends, and leaf pairs that are priced at once
LEAF, AT_ONCE = 8, 2048
#: entries that a task counts before it hands them on
COUNTED = 300_000
#: rows of a table that may be broadcast; larger ones are joined by salted keys
BROADCAST_ROWS, SALTS = 100_000, 16

#: bytes of terms as they are, A-Z as a-z, all others as spaces
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of A-Z, a-z and characters from U+0080 on, of which only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split()


# ------------------------------------------------------------------------------- counting

def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in each group, and how many texts of the
    group have it.  Every task counts its own rows first."""
    def run(batches):
        n, in_docs, entries = defaultdict(Counter), defaultdict(Counter), 0

        def out():
            rows = [(*key, t.decode("utf-8", "replace"), c, in_docs[key][t]) for key, found in n.items() for t, c in found.items()]
            n.clear()
            in_docs.clear()
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*batch.columns):
                words = terms(text.as_py())
                key = (lang.as_py(), source.as_py())
                entries -= len(n[key])
                n[key].update(words)
                in_docs[key].update(set(words))
                entries += len(n[key])
                if entries > COUNTED:
                    yield out()
                    entries = 0
        yield out()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    found = docs.select(*named, text_bytes(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _attach(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, whose keys are unique.  A table of few rows is broadcast; otherwise every
    key is dealt over SALTS partitions, since one language or source may have most of the rows."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _price(n: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in whole numbers of any size."""
    whole = "decimal(38,0)"
    return (F.lit(1) + F.call_function("div", F.lit(PARTS_PER).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms_).cast(whole))).cast("long")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


# ------------------------------------------------------------------------------- the tree

class QuadTree:
    """The nonzero entries of a matrix as a k-squared tree with k = 2.

    ``bits[l]`` holds, for each nonzero quadrant of level l in order of discovery, one bit for each of its
    four parts; the part that has its bit set is the quadrant of level l + 1 whose number is the rank of the bit.
    Parts without entries are not stored.  The last level's quadrants are blocks of ``LEAF`` rows and columns.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, levels: int):
        self.levels, self.bits, self.rank = levels, [], []
        node = np.zeros(len(row), np.int64)
        for level in range(levels):
            shift = levels - level - 1
            part = 2 * (row // LEAF >> shift & 1) + (column // LEAF >> shift & 1)
            filled, where = np.unique(4 * node + part, return_inverse=True)
            bits = np.zeros(4 * (node.max(initial=-1) + 1), bool)
            bits[filled] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            node = where
        self.leaves = np.zeros((node.max(initial=-1) + 1, LEAF, LEAF), np.int64)
        self.leaves[node, row % LEAF, column % LEAF] = value

    def child(self, level: int, node: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Number of a part of each quadrant, -1 if the part or the quadrant has no entries."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + part
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def joint(one: QuadTree, two: QuadTree, zero_one: np.ndarray, zero_two: np.ndarray, width: int) -> np.ndarray:
    """Sum over ``width`` columns of divergence(p, q) for each row p of one tree and row q of the other.

    Both trees are walked together.  Where both quadrants are empty the columns all have the price of
    a count of zero, so their number is enough; only leaves that hold an entry of either are looked at.
    """
    levels = one.levels
    g, h = len(zero_one), len(zero_two)
    blocks = -(-g // LEAF), -(-h // LEAF)
    pad = [np.concatenate([z, np.ones(b * LEAF - len(z), np.int64)]).reshape(b, LEAF) for z, b in zip((zero_one, zero_two), blocks)]
    total = np.zeros((*blocks, LEAF, LEAF), np.int64)
    blank = np.zeros((blocks[0] + 1, blocks[1] + 1), np.int64)  # empty columns: corners of rectangles, then summed up
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not len(one.leaves):
        a[0] = -1
    if not len(two.leaves):
        b[0] = -1
    ra, rb, c = (np.zeros(1, np.int64) for _ in range(3))

    def price_empty(level):
        nonlocal a, b, ra, rb, c
        empty = (a < 0) & (b < 0)
        side = 1 << levels - level
        columns = np.clip(width - c[empty] * side * LEAF, 0, side * LEAF)
        top, left = ra[empty] * side, rb[empty] * side
        bottom, right = np.minimum(top + side, blocks[0]), np.minimum(left + side, blocks[1])
        for r, k, sign in ((top, left, 1), (bottom, left, -1), (top, right, -1), (bottom, right, 1)):
            np.add.at(blank, (r, k), sign * columns)
        a, b, ra, rb, c = (x[~empty] for x in (a, b, ra, rb, c))

    price_empty(0)
    for level in range(levels):
        i, j, k = (np.tile(x, len(a)) for x in np.indices((2, 2, 2)).reshape(3, -1))
        a, b, ra, rb, c = (np.repeat(x, 8) for x in (a, b, ra, rb, c))
        a, b = one.child(level, a, 2 * i + k), two.child(level, b, 2 * j + k)
        ra, rb, c = 2 * ra + i, 2 * rb + j, 2 * c + k
        side = 1 << levels - level - 1
        inside = (ra * side < blocks[0]) & (rb * side < blocks[1]) & (c * side * LEAF < width)
        a, b, ra, rb, c = (x[inside] for x in (a, b, ra, rb, c))
        price_empty(level + 1)
    for at in range(0, len(a), AT_ONCE):
        x, y, r, s, k = (z[at:at + AT_ONCE] for z in (a, b, ra, rb, c))
        p = np.where(x[:, None, None] >= 0, one.leaves[x] if len(one.leaves) else 0, 0)
        q = np.where(y[:, None, None] >= 0, two.leaves[y] if len(two.leaves) else 0, 0)
        p, q = np.where(p > 0, p, pad[0][r][:, :, None]), np.where(q > 0, q, pad[1][s][:, :, None])
        priced = divergence(p[:, :, None, :], q[:, None, :, :])
        real = k[:, None] * LEAF + np.arange(LEAF) < width
        np.add.at(total, (r, s), (priced * real[:, None, None, :]).sum(3))
    blank = blank.cumsum(0).cumsum(1)[:-1, :-1]
    total += blank[:, :, None, None] * divergence(pad[0][:, None, :, None], pad[1][None, :, None, :])
    return total.transpose(0, 2, 1, 3).reshape(blocks[0] * LEAF, blocks[1] * LEAF)[:g, :h]


def pair_values(table: pa.Table, width: int) -> list[tuple[str, str, int]]:
    """``(group, other, value)`` for the pairs of groups of a task: rows of ``table(side, source, term, p)``
    with term null carry the price of a count of zero.  With both sides, pairs within a side are left out."""
    side = table.column("side").to_numpy()
    source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    all_names, source = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
    n_seen, price, blank = len(term.dictionary), table.column("p").to_numpy(), term.is_null().to_numpy(zero_copy_only=False)
    term = term.indices.fill_null(0).to_numpy(zero_copy_only=False)
    sides, names, zero, entries = sorted(set(side.tolist())), {}, {}, {}
    for s in sides:
        row, cell = (side == s) & blank, (side == s) & ~blank
        number = np.empty(len(all_names), np.int64)
        number[source[row]] = np.arange(row.sum())
        names[s], zero[s] = [all_names[i] for i in source[row]], price[row]
        entries[s] = number[source[cell]], term[cell], price[cell]
    # terms that the same groups have stand together, so that empty quadrants are large
    pattern = np.zeros((n_seen, sum(map(len, names.values()))), bool)
    start = 0
    for s in sides:
        pattern[entries[s][1], entries[s][0] + start] = True
        start += len(names[s])
    place = np.empty(n_seen, np.int64)
    if n_seen:
        place[np.lexsort(np.packbits(pattern, axis=1).T[::-1])] = np.arange(n_seen)
    levels = (-(-max(width, n_seen, *map(len, names.values())) // LEAF) - 1).bit_length()
    trees = {s: QuadTree(entries[s][0], place[entries[s][1]], entries[s][2], levels) for s in sides}
    out = []
    for s, t in ((sides[0], sides[-1]), (sides[-1], sides[0]))[:len(sides)]:
        value = joint(trees[s], trees[t], zero[s], zero[t], width)
        out += [(g, h, int(value[i, j])) for i, g in enumerate(names[s]) for j, h in enumerate(names[t]) if g != h]
    return out


# ---------------------------------------------------------------------------------- audit

def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, tile_groups: int = TILE_GROUPS, tile_terms: int = TILE_TERMS, **columns) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each (lang, source) group's use of terms is from others'.

    A language keeps the terms of at least ``min_docs`` of its documents.  Part ``pair`` has a row for each other
    source of the language, with the divergence summed over all kept terms; part ``term`` has the ``top`` kept terms that
    the group uses more than its language.  Ties are ranked by item.  Null text, lang and source count as empty
    ones; a group without terms, or a language without kept terms, still has its pairs (0 without kept terms).  Repeated
    rows count as often as they occur, other columns are ignored, an empty table gives no row.  Arithmetic is exact.

    Terms are counted within tasks first.  The matrix of a language is dealt into tiles of groups and terms; a
    task holds two tiles of the same terms, and sums of pairs are added over the term tiles.
    """
    names = {k: columns.get(f"{k}_col", k) for k in ("lang", "source")}
    groups = settle(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in names.items()]).distinct())
    of_term = Window.partitionBy("lang", "term")
    counted = counts(docs, **columns).withColumns({"docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term)})
    entries = settle(counted.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "all_n"))
    of_term = entries.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    of_lang = of_term.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    none = F.lit(0).cast("long")
    langs = settle(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(of_lang, "lang", "left").select(
        "lang", F.coalesce("lang_n", none).alias("lang_n"), F.coalesce("v", none).alias("v"),
        F.ceil(F.col("sources") / tile_groups).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("v") / tile_terms)).cast("int").alias("stripes")))
    of_group = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    priced = settle(_attach(of_group.withColumn("group_n", F.coalesce("group_n", none)), langs, ["lang"]).withColumn(
        "p0", F.when(F.col("v") > 0, _price(none, F.col("group_n"), F.greatest("v", F.lit(1)))).otherwise(1)))
    entries = settle(_attach(entries, priced, ["lang", "source"]).withColumn("p", _price(F.col("n"), F.col("group_n"), F.col("v"))))

    excess = entries.withColumn("q", _price(F.col("all_n"), F.col("lang_n"), F.col("v"))).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_rows = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    term_rows = term_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pair_rows = _pairs(entries, priced).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return term_rows.unionByName(pair_rows.withColumn("rank", F.row_number().over(order)))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two different groups of a language."""
    tile = F.pmod(F.xxhash64("source", F.lit("tile")), F.col("tiles")).cast("int").alias("tile")
    stripe = F.pmod(F.xxhash64("term", F.lit("stripe")), F.col("stripes")).cast("int").alias("stripe")
    widths = entries.select("lang", "term", stripe).distinct().groupBy("lang", "stripe").agg(F.count(F.lit(1)).alias("width"))
    cells = entries.select("lang", "source", "term", "p", tile, stripe, "tiles")
    rows = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), tile,
                         F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), "tiles")
    every = cells.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.select("lang", "stripe", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"),
                         F.when(F.col("tile") <= F.col("other"), 1).otherwise(2).alias("side"), "source", "term", "p")

    def price(key, left, right):
        width = right.column("width")[0].as_py() if len(right) else 0
        found = pair_values(left, width) if len(left) else []
        lang = key[0].as_py()
        return pa.table([pa.array([lang] * len(found), pa.string()), pa.array([x[0] for x in found], pa.string()),
                         pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int64())], ["lang", "source", "item", "value"])

    # the width of a stripe goes to each of its tasks
    langs = groups.select("lang", "tiles").distinct()
    spread = widths.join(langs, "lang").withColumn("one", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn(
        "two", F.explode(F.sequence(F.col("one"), F.col("tiles") - 1)))
    key = ["lang", "stripe", "one", "two"]
    spread = spread.select(*[F.col(k).alias(f"{k}_of") for k in key], "width")
    found = every.groupBy(*key).cogroup(spread.groupBy(*[f"{k}_of" for k in key])).applyInArrow(price, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
