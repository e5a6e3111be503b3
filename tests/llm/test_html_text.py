import html
import random
import re

import numpy as np
import pytest

from polyweave.llm import html_text as ht
from polyweave.llm import queries


def article(page):
    """Plain version for the given pages, whose main text is what stands in their article element."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_blocks():
    page = ('<!DOCTYPE html><title>T &amp; U</title><script>var a="<p>no</p>"</script><style>p{}</style><!-- <p>no</p> --><nav class="Top-Menu x">'
            '<ul><li><a href="/a?b=1&amp;c">A</a><li>B</ul></nav><p>one <b>two<br>three</b>\n four&nbsp;&#233;<p>fi<i>v</i>e</div> six<table><tr><td>7<td>8</table>9 < 10')
    got = ht.blocks_of_page(page)
    assert [t for _, t, _ in got] == ["T & U", "A", "B", "one two three four é", "five six", "7", "8", "9 < 10"]
    assert got[1][0] == (("nav", ".top", ".menu", ".x"), ("ul",), ("li",)) and got[1][2] == 1.0 and got[3][2] == 0.0
    assert ht.blocks_of_page("") == ht.blocks_of_page("<div><p></p> <br></div><script>x") == []
    assert [t for _, t, _ in ht.blocks_of_page("<p>a<" + "b" * 500000)] == ["a"]  # a tag without end is markup


def test_gradients():
    rnd = random.Random(3)
    features = ht.Features()
    pages = [features(ht.blocks_of_page(ht.made_page(rnd, ["a b c", "d e"])[0])) for _ in range(3)]
    model = {k: v.astype(np.float64) for k, v in ht.initial(1).items()}
    x, real, where, _ = ht._padded(pages, model)
    aim = np.random.default_rng(0).normal(size=(*real.shape, 2 * ht.HIDDEN)) * real[..., None]

    def loss(x):
        return (ht._both(x, real, model) * aim).sum()
    trace = ([], [])
    ht._both(x, real, model, trace)
    dx = ht._back(aim[..., :ht.HIDDEN], trace[0], model["wf"])[0] + ht._back(aim[::-1, :, ht.HIDDEN:], trace[1], model["wb"])[0][::-1]
    for t, p, k in [(0, 0, 3), (1, 1, 20), (2, 2, 25)]:
        up, down = x.astype(np.float64).copy(), x.astype(np.float64).copy()
        up[t, p, k] += 1e-2
        down[t, p, k] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(dx[t, p, k], rel=0.05, abs=5e-3)


def test_query_against_articles_and_held_out_layouts(spark, small, con):
    pages = con.execute("SELECT page_id, url, html FROM pages").fetchall()
    got = {r["page_id"]: r for r in queries.op10_html(spark, small).collect()}
    assert len(got) == len(pages)
    right = sum(got[i]["text"] == article(page) and got[i]["url"] == url and got[i]["n_chars"] == len(article(page)) for i, url, page in pages)
    assert right >= 0.99 * len(pages)

    model = ht.unpacked(ht.fit(spark.read.parquet(f"{small}/pages.parquet")))
    rnd, wrong, total = random.Random(99), 0, 0
    for _ in range(200):  # layouts it has not seen
        page, labels = ht.made_page(rnd, ["Some other words here.", "x", "More of these words, and again more of them, as it goes."])
        found = ht.predict([ht.Features()(ht.blocks_of_page(page))], model)[0] > 0.5
        wrong += int((found != np.array(labels, bool)).sum())
        total += len(labels)
    assert wrong <= 0.02 * total


def test_odd_rows(spark, small):
    model = ht.fit(spark.read.parquet(f"{small}/pages.parquet"))
    long = "<article>" + "".join(f"<p>word{i} and more of it.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "v", "<nav>a</nav><script>b</script>", None), (5, "w", long, "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract(frame, model).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got[:4]] == [(1, "", 0), (2, "", 0), (2, "", 0), (None, "", 0)]
    assert got[4]["text"] == article(long)
    assert ht.extract(frame.limit(0)).collect() == []
