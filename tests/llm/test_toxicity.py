import random
import zlib

from polyweave.llm import queries, toxicity

DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, toxic int, text string"


def test_query_on_held_out_labels(spark, small, con, texts):
    label = dict(con.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    rows = queries.op1_toxicity(spark, small).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(label[i], got[i]["predicted"]) for i in label if i in got and got[i]["held_out"]]
    toxic, clean = ([p for y, p in held if y == k] for k in (1, 0))
    assert sum(clean) <= 0.1 * len(clean) and sum(toxic) >= 0.4 * len(toxic)  # a few dozen toxic texts to learn from


def made(rnd, toxic, stems):
    words = ["".join(rnd.choices(["er", "on", "th", "an", "re", "ti"], k=rnd.choice([1, 2, 3]))) for _ in range(rnd.choice([30, 90]))]
    for _ in range(4 * toxic):
        words.insert(rnd.randrange(len(words)), rnd.choice(stems) + rnd.choice(["", "s", "en"]))
    return " ".join(words).encode()


def test_words_of_toxic_texts_are_learnt_and_copies_are_not():
    rnd, stems = random.Random(4), ["grobl", "snirk", "vutz", "plomf"]
    texts = [(made(rnd, k % 3 == 0, stems), int(k % 3 == 0)) for k in range(900)]
    copied = made(rnd, False, stems)
    model = toxicity.fit_texts(texts + [(copied, 1)] * 60)
    scorer = toxicity.Scorer(model["ordinary"], model["toxic"], model["weights"])
    held = [(made(rnd, k % 2 == 0, stems), k % 2 == 0) for k in range(300)]
    right = sum((scorer(t) >= 0.3) == y for t, y in held)
    assert right >= 0.93 * len(held)
    learnt = model["toxic"][len(model["ordinary"]):].split()
    assert learnt and all(any(w.startswith(s.encode()) for s in stems) for w in learnt)


def test_windows_cover_whole_texts():
    text = b"a b c d e f g h " * 50 + b"x" * 1000
    seen = {w for window in toxicity.windows(text) for w in window.split()}
    assert seen == set(toxicity.words_of(text)) and b"x" * 40 in seen
    assert toxicity.windows(b" \n") == [] and toxicity.windows(b"A") == [b" a "]


def test_odd_rows(spark):
    rnd, stems = random.Random(5), ["grobl", "snirk"]
    rows = [(k, made(rnd, k % 3 == 0, stems).decode(), "en", 0.1) for k in range(240)]
    rows += [(500, None, None, None), (501, "", "x", 1.0), (501, "", "x", 1.0), (None, made(rnd, True, stems).decode(), "x", 0.0), (502, "word " * 40000 + "snirk groblen snirks grobl", "x", 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), "t") for k in range(240)] + [(1, None, "t"), (None, 1, "t"), (3, 0, "t"), (7, 9, "t")], LABELS)
    out = toxicity.scores(docs, labels)
    got = out.collect()
    by = {r["doc_id"]: r for r in got}
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert by[500]["score"] == by[501]["score"] < 0.3 and by[None]["held_out"] is False
    assert by[None]["predicted"] == by[502]["predicted"] == 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in by.items() if r["predicted"] == 0}
    none = toxicity.scores(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r["predicted"] for r in none} == {0} and len({r["score"] for r in none}) == 1
    assert toxicity.scores(docs.limit(0), labels).collect() == []
