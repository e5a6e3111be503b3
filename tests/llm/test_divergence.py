import re
from collections import Counter

import numpy as np
import pytest
from compare import compare

from polyweave.llm import divergence
from polyweave.llm.queries import registered


def plain(rows, min_docs=3, top=200):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        seen = Counter(w for ws, g, _ in docs if g == lang for w in set(ws))
        kept = sorted(w for w, c in seen.items() if c >= min_docs)
        groups = {s: Counter() for _, g, s in docs if g == lang}
        for ws, g, s in docs:
            if g == lang:
                groups[s].update(w for w in ws if w in set(kept))

        def price(n):
            return {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(kept)) for w in kept}
        prices, whole = {s: price(n) for s, n in groups.items()}, price(sum(groups.values(), Counter()))
        for s, p in prices.items():
            pairs = [(o, sum((p[w] - q[w]) ** 2 // q[w] for w in kept)) for o, q in prices.items() if o != s]
            words = [(w, (p[w] - whole[w]) ** 2 // whole[w]) for w in kept if groups[s][w] and p[w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(seed, n=80):
    rnd = np.random.default_rng(seed)
    words = [f"{a}é{b}" if (ord(a) + ord(b)) % 5 == 0 else a + b.upper() for a in "abcdefg" for b in "abcdefgh"]
    share = rnd.dirichlet(np.ones(len(words)) * 0.2, 9)
    return [(" ".join(rnd.choice(words, rnd.integers(0, 30), p=share[k])) + ", 12", ("en", "de", None)[k % 3], f"s{k}")
            for k in rnd.integers(0, 9, n)]


@pytest.mark.parametrize("options", [{}, {"tile_groups": 2, "tile_terms": 5}, {"top": 2, "min_docs": 6}])
def test_against_plain_sums(spark, options):
    rows = made(len(options))
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), **options).collect()
    assert sorted(map(tuple, got)) == plain(rows, **{k: v for k, v in options.items() if k in ("top", "min_docs")})


@pytest.mark.parametrize("seed", range(12))
def test_joint_walk_against_dense_matrices(seed):
    rnd = np.random.default_rng(seed)
    g, h, width = rnd.choice([1, 3, 8, 21]), rnd.choice([1, 9, 40]), int(rnd.choice([1, 7, 8, 100, 300]))
    zero = [rnd.integers(1, 50, n) for n in (g, h)]
    dense, trees = [], []
    for z, n in zip(zero, (g, h)):
        filled = rnd.random((n, width)) < rnd.choice([0, 0.02, 0.7])
        value = rnd.integers(1, 10**9, (n, width))
        row, column = np.nonzero(filled)
        levels = (-(-max(width, 40) // divergence.LEAF) - 1).bit_length()
        trees.append(divergence.QuadTree(row, column, value[row, column], levels))
        dense.append(np.where(filled, value, z[:, None]))
    want = divergence.divergence(dense[0][:, None], dense[1][None]).sum(2)
    assert (divergence.joint(*trees, *zero, width) == want).all()


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("one 2 three", "en", "b"), ("One", "en", "b"), ("ONE one", "en", None), ("É é", "fr", "z"),
            ("word " * 300000, "en", "a"), ("word", "en", "b"), ("word x", "en", "b"), ("word", "en", "b"), ("word", "en", "b")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, value long, term string")
    assert sorted(map(tuple, divergence.audit(frame).collect())) == plain(rows)
    assert divergence.audit(frame.limit(0)).collect() == []


def test_query_matches_sql(spark, con, small):
    ok, text = compare(spark, con, small, "op11_divergence", *registered()["op11_divergence"])
    assert ok, text
