"""SimHash near-duplicate groups: pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_slices, free_names, settle, text_bytes
from .components import components

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 3, 42
#: fingerprints of one block that a task compares; larger blocks are split by further bits
BLOCK_ROWS = 4096
#: shingles whose bits are counted at once
SLICE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed long.

    A-Z is lower-cased, words are split at ASCII white space, and every word shingle counts as
    often as it occurs.  Fewer words than a shingle form one shingle; no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    first = (ends - sizes)[:n].tolist()
    last = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        pairs = zip(first[at:at + SLICE], last[at:at + SLICE])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, min(SLICE, n - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row; whole texts, null as empty.  Rows have the same ``row_key``
    if they have the same doc_id and text, and else never."""
    def run(batches):
        for batch in batches:
            values = by_slices(lambda t: fingerprint(t, shingle), pa.int64(), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key binary, fp long")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """40 bytes: a 64-bit hash, by which keys are ordered, and the SHA-256 of doc_id and text, which tells apart rows that share it."""
    doc_id = F.col(id_col).cast("long")
    short = F.xxhash64(doc_id, F.coalesce(text_col, F.lit(""))).bitwiseXOR(F.lit(-(1 << 63)))  # signed order by bytes
    name = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    whole = F.sha2(F.concat(name, F.lit(bytearray(1)), text_bytes(text_col)), 256)
    return F.unhex(F.concat(F.lpad(F.hex(short), 16, "0"), whole)).alias("row_key")


# ------------------------------------------------------------------ links between fingerprints

def _parts(mask: int, parts: int) -> list[int]:
    """Masks that add one part of the yet unused bits to ``mask``; each is a signed long."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    out = []
    for chunk in np.array_split(free, min(parts, len(free)) or 1):
        whole = mask | sum(1 << int(i) for i in chunk)
        out.append(whole - (1 << BITS) if whole >> (BITS - 1) else whole)
    return out


def _keyed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """``(mask, block, fp)`` for every mask that follows the row's ``mask``."""
    pairs = [x for old, more in masks.items() for x in (F.lit(old).cast("long"), F.array(*[F.lit(m).cast("long") for m in more]))]
    out = rows.select("fp", F.explode(F.element_at(F.create_map(*pairs), F.col("mask"))).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp")


def forest(block: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints of one block: n - 1 links at most, and
    two fingerprints within ``distance`` are always connected by them."""
    block = np.unique(block)
    left, links, front = block, [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        node = front.pop()
        near = np.bitwise_count((left ^ node).view(np.uint64)) <= distance
        if near.any():
            found = left[near]
            links += [(int(node), int(x)) for x in found]
            front += list(found)
            left = left[~near]
    return links


def _compare(keyed: DataFrame, distance: int, block_rows: int) -> DataFrame:
    """Forest links ``(null, a, b)`` of each block, and ``(mask, fp, null)`` for the rows of blocks
    that are too large.  Blocks are read in order, so a task holds ``block_rows`` rows at most."""
    def run(batches):
        out, key, held, over = ([], [], []), None, [], False

        def give(mask, a, b):
            for column, values in zip(out, (mask, a, b)):
                column.extend(values)

        def close():
            if not over and len(held) > 1:
                pairs = forest(np.array(held, np.int64), distance)
                give([None] * len(pairs), *(zip(*pairs) if pairs else ([], [])))

        def taken():
            rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["mask", "a", "b"])
            for column in out:
                column.clear()
            return rows

        for batch in batches:
            mask, block, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (block[1:] != block[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)] if len(fp) else []):
                now = (int(mask[start]), int(block[start]))
                if now != key:
                    close()
                    key, held, over = now, [], False
                held += fp[start:stop].tolist()
                if over or len(held) > block_rows:
                    over = True
                    give([now[0]] * len(held), held, [None] * len(held))
                    held = []
            yield taken()
        close()
        yield taken()

    ordered = keyed.repartition("mask", "block").sortWithinPartitions("mask", "block")
    return ordered.mapInArrow(run, "mask long, a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all of the distinct ``fps(fp)`` within ``distance`` bits.

    By the pigeonhole principle a pair that differs in at most ``distance`` of the unused bits
    shares one of ``distance + 1`` parts of them.  Fingerprints are blocked by each part; blocks
    of more than ``block_rows`` are blocked again by parts of the bits that are still unused, so
    no pair is lost and no task ever holds a larger block.  The depth follows the data.
    """
    keyed = _keyed(fps.select(F.lit(0).cast("long").alias("mask"), "fp"), {0: _parts(0, distance + 1)})
    found = None
    while True:
        seen = settle(_compare(keyed, distance, block_rows))
        part = seen.where("b is not null").select("a", "b")
        found = part if found is None else found.unionByName(part)
        large = seen.where("b is null").select("mask", F.col("a").alias("fp"))
        wide = [r[0] for r in large.select("mask").distinct().collect()]  # as many as masks of one depth
        if not wide:
            return found
        keyed = _keyed(large, {m: _parts(m & (1 << BITS) - 1, distance + 1) for m in wide}).distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
            distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row_key, fp)`` of the rows, and ``(fp, root, first)`` of the distinct fingerprints:
    the least fingerprint of the component, and the least (is null, doc_id, row_key) of the fingerprint."""
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    firsts = settle(marked.groupBy("fp").agg(first.alias("first")))
    roots = components(links(firsts.select("fp"), distance, block_rows))
    return marked, settle(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest doc_id
    that can be reached.  Null and empty texts have fingerprint zero and are linked like any
    other.  A null doc_id keeps its row and is never the smallest, unless a component has no
    other.  Repeated rows keep all their rows.  Other columns are ignored.
    """
    marked, rooted = grouped(docs, **options)
    least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` (columns unchanged) of each group: that of the smallest doc_id.

    A null doc_id stays only where its group has no other; of texts with the same doc_id in a
    group one stays, and rows that repeat both doc_id and text are merged.  The texts are
    shuffled once, by row key, which both the join and the merging use.
    """
    key, name, n = free_names(docs, "key", "id", "n")
    _, rooted = grouped(docs, id_col, text_col, **options)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.row_key").alias(key), F.coalesce("first.doc_id", F.lit(-1)).alias(name))
    rows = docs.withColumn(key, row_key(id_col, text_col)).withColumn(name, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))
    once = Window.partitionBy(key, name).orderBy(key)
    return (rows.join(kept, [key, name], "left_semi").withColumn(n, F.row_number().over(once))
            .where(F.col(n) == 1).select(*docs.columns))
