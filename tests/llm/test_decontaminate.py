import random

import pytest
from compare import compare
from pyspark.sql import types as T

from polyweave.llm import decontaminate as dc
from polyweave.llm.queries import registered

ITEMS, DOCS = "item_id long, text string, spans int", "doc_id long, text string, n_chars long, items string"


def plain_hits(words, items, window):
    hit, names = set(), set()
    for name, text in items:
        item = dc.normal_words(text)
        n = min(window, len(item))
        wins = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(60))
def test_automaton_against_all_windows(seed):
    rnd = random.Random(seed)
    letters = [b"a", b"b", b"c"][:rnd.choice([1, 2, 3])]
    items = [(str(k), b" ".join(rnd.choices(letters, k=rnd.choice([0, 1, 3, 4, 7, 12])))) for k in range(rnd.choice([1, 2, 5]))]
    window = rnd.choice([2, 4, 10])
    machine = dc.ItemAutomaton(items, window)
    for _ in range(10):
        words = rnd.choices([*letters, b"z"], k=rnd.choice([0, 1, 5, 40]))
        spans, names = machine.hits(words)
        want, of = plain_hits(words, items, window)
        assert {i for a, b in spans for i in range(a, b)} == want and names == of
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_query_matches_sql(spark, con, small):
    ok, text = compare(spark, con, small, "op7_decontamination", *registered()["op7_decontamination"])
    assert ok, text


def odd(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Only-three words", 0), (3, "only three WORDS", 0),
                                   (None, long[-200:], 1), (4, " ".join(f"w{i}" for i in range(40, 60)), 1)], ITEMS)
    docs = spark.createDataFrame([(1, None, None, "a"), (2, "", 0, "a"), (3, "x only three, words!", 20, None), (3, "x only three, words!", 20, None),
                                  (4, long, len(long), "b"), (None, "clean text éé", 13, "c")], DOCS)
    return docs, items


@pytest.mark.parametrize("item_bytes", [1 << 20, 200])
def test_odd_rows(spark, item_bytes):
    docs, items = odd(spark)
    rows = dc.report(docs, items, item_bytes=item_bytes).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 6 and [got[i]["n_hit"] for i in (1, 2, 3, None)] == [0, 0, 3, 0]
    assert got[3]["n_items"] == 1 and got[4]["n_items"] == 2 and got[4]["n_words"] == 30000
    assert got[4]["n_hit"] == 20 + len(dc.normal_words(" ".join(f"w{i}" for i in range(30000))[-200:].encode())) - 1
    clean = dc.decontaminate(docs, items, item_bytes=item_bytes)
    kept = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and clean.count() == 4 and 3 not in kept
    assert kept[1]["text"] is None and kept[None]["text"] == "clean text éé"
    assert "w45 " not in kept[4]["text"] and kept[4]["n_chars"] == len(kept[4]["text"])
    assert dc.normal_words(kept[4]["text"].encode())[39:42] == [b"w39", b"w60", b"w61"]


def test_item_groups_are_bounded_and_whole(spark):
    """Also where one item is long and a third of all rows are copies of one."""
    rows = [(k, f"item {k} " + "word " * (k % 9), 0) for k in range(200)] + [(1000, "long " * 400, 0)] + [(7, "copy " * 5, 0)] * 100
    items = spark.createDataFrame(rows, ITEMS)
    n, groups = dc._groups(items, 1000)
    groups = list(groups)
    assert n == len(groups) and sorted(i for g in groups for i in g) == sorted({(str(k), t.encode()) for k, t, _ in rows})
    for group in groups:
        sizes = [len(t) + 64 for _, t in sorted(group)]
        assert sum(sizes[:-1]) < 1000
    assert n < 2 * sum(len(t) + 64 for _, t in {(k, t) for k, t, _ in rows}) / 1000
    assert dc._groups(items, 10 ** 6)[0] == 1


def test_empty_tables(spark):
    docs, items = odd(spark)
    no_items = spark.createDataFrame([], T._parse_datatype_string(ITEMS))
    assert not any(r["contaminated"] for r in dc.report(docs, no_items).collect())
    assert dc.decontaminate(docs, no_items).count() == 6
    none = spark.createDataFrame([], T._parse_datatype_string(DOCS))
    assert dc.report(none, items).collect() == [] == dc.decontaminate(none, items).collect()
