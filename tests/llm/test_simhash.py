import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from polyweave.llm import components, queries, simhash

SCHEMA = "doc_id long, text string, fp string, mask int"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    ids, root = sorted(fps), {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_query_against_all_pairs(spark, small, texts):
    got = queries.op2_simhash(spark, small).collect()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(fps)
    assert len(got) == len(fps) and len(set(groups.values())) < len(groups)
    assert all(r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == groups[r["doc_id"]] for r in got)


@pytest.mark.parametrize("block_rows, task_links", [(12, 10), (4096, 500_000)])
def test_blocks_of_any_size_lose_no_link(spark, monkeypatch, block_rows, task_links):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    rnd = random.Random(block_rows)
    fps = set()
    for _ in range(12):  # chains and clusters of close fingerprints
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 30])):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
            fps.add(x)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    rows = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = simhash.components(simhash.links(rows, block_rows=block_rows)).collect()
    want = plain_groups({s: f for s, f in signed.items()})
    got = {i: i for i in signed} | {r["node"]: r["root"] for r in found}
    assert len(found) == len({r["node"] for r in found})
    assert got == want


def test_forest_is_small_and_connects():
    block = np.array([0, 1, 3, 7, 15, 31 << 40, -1], np.int64)
    assert len(simhash.forest(block)) == 4


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (4, "", "x", 1), (3, " \t\n", "x", 1), (2, "One two", "y", 1), (1, "one  TWO", None, None),
            (None, "one two", "z", 2), (2, "One two", "y", 1), (9, "word " * 70000, "q", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(simhash.near_duplicates(docs).collect(), key=repr)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["component_id"] for i in (3, 4, 5)} == {3} and by[4]["fingerprint"] == "0" * 16
    assert {by[i]["component_id"] for i in (1, 2, None)} == {1}
    assert by[9]["component_id"] == 9
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 9]
    empty = spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
    assert simhash.near_duplicates(empty).collect() == [] == simhash.keep_one(empty).collect()
