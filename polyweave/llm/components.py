"""Connected components of a link table, by alternating star operations on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: links that one task contracts; larger tables are contracted in several tasks
TASK_LINKS = 500_000


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """The links of each task as stars around the least node of each local component."""
    def run(batches):
        parent: dict[int, int] = {}

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = (top(x) if x in parent else parent.setdefault(x, x) for x in (a, b))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root) for x in list(parent) if (root := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    return links.repartition(tasks).mapInArrow(run, "a long, b long")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (near.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the component's least node.

    Rows that link a node to itself are ignored; an empty table gives an empty result.  Tasks
    first contract at most ``TASK_LINKS`` links each.  What one task could not see is joined by
    rounds of star operations, each written to the checkpoint folder; only two numbers a round
    reach the driver.  The table never outgrows the distinct links it starts from.
    """
    links = links.where("a <> b").select("a", "b")
    tasks = max(1, -(-links.count() // TASK_LINKS))
    now, before = settle(_contracted(links, tasks)), None
    while tasks > 1:
        now = settle(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    least = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(least)
