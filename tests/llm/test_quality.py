import numpy as np

from polyweave.llm import quality, queries


def test_em_finds_the_accuracies_of_its_labellers():
    rnd, accuracy, abstain, n = np.random.default_rng(2), [0.95, 0.8, 0.9, 0.7, 0.85], [0.1, 0.3, 0.0, 0.2, 0.5], 60000
    truth = rnd.random(n) < 0.8
    votes = np.array([np.where(rnd.random(n) < b, 2, np.where(rnd.random(n) < a, truth, ~truth)) for a, b in zip(accuracy, abstain)])
    codes, counts = np.unique((votes * 3 ** np.arange(4, -1, -1)[:, None]).sum(0), return_counts=True)
    model = quality.LabelModel(dict(zip(codes.tolist(), counts.tolist())), 5)
    assert abs(model.share - 0.8) < 0.03 and np.abs(model.accuracies() - accuracy).max() < 0.03


def test_query_keeps_clean_documents(spark, small, con, texts):
    label = dict(con.execute("SELECT doc_id, max(quality) FROM labels GROUP BY 1").fetchall())
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, small).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got.values())
    good, bad = ([got[i]["keep"] for i, y in label.items() if y == k and i in got] for k in (1, 0))
    assert sum(good) >= 0.93 * len(good)  # labels are noisy and were not used
    assert sum(bad) / len(bad) < sum(good) / len(good) - 0.25


def test_odd_rows(spark):
    fine = "This is a text of plain words. It has two sentences, and more of them.\nHere is a line that ends well. " * 8
    rows = [(1, None, 0), (2, "", 0), (None, fine, 1), (3, "x### y%%% z$$$ " * 40, 2), (3, "x### y%%% z$$$ " * 40, 2), (4, "word. " * 60000, 3)]
    rows += [(100 + i, fine + str(i), 0) for i in range(30)] + [(200 + i, f"a{i}### b%%% $$$ c*** " * 30, 0) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = quality.scores(frame)
    out = got.collect()
    by = {r["doc_id"]: r for r in out}
    assert got.columns == ["doc_id", "score", "keep", "posterior"] and len(out) == len(rows)
    assert by[None]["keep"] and not by[3]["keep"]
    assert quality.scores(frame.limit(0)).collect() == []
