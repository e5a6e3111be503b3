from pyspark.sql import functions as F

from polyweave.llm import queries, secrets


def test_expression_is_the_forest_and_is_right_on_held_out_findings(spark):
    from pyspark.ml.classification import RandomForestClassifier  # noqa: F401
    rows = secrets.labelled_findings(spark, 4000)
    learn, held = rows.where(F.crc32(F.col("candidate").cast("binary")) % 4 > 0), rows.where(F.crc32(F.col("candidate").cast("binary")) % 4 == 0)
    forest = secrets.fit(learn)
    fields = ", ".join(f"'{n}', cast({s} as double)" for n, s in secrets._features("candidate", "before", "after", "path").items())
    out = held.withColumn("s", F.expr(f"named_struct({fields})")).withColumn("p", F.expr(forest))
    counts = out.groupBy("label", (F.col("p") >= 0.5).alias("found")).count().collect()
    right = sum(r["count"] for r in counts if bool(r["label"]) == r["found"])
    assert right >= 0.95 * sum(r["count"] for r in counts)
    assert out.where("p < 0 or p > 1 or p is null").count() == 0


def test_query_against_planted_forms(spark, small, texts):
    """In the given documents keys are what follows token = and password=, and AKIA keys."""
    import re
    want = {(i, m[1]) for i, t in texts.items()
            for m in re.finditer(r"""(?:token = "|password=|\b(?=AKIA))([A-Za-z0-9]{16,})""", t or "")}
    df = queries.op6_secrets(spark, small)
    got = {(r["doc_id"], r["candidate"]) for r in df.collect() if r["is_secret"]}
    assert want and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.05 * len(got)
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_odd_rows(spark):
    long = "word " * 60000 + 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(1, None, None, None, "x"), (2, "", 0, "s", "x"), (None, 'password=b7db7aa4a5fcc78305 and password=b7db7aa4a5fcc78305', 1, None, "y"),
            (3, long, 5, "s", "z"), (3, long, 5, "s", "z"), (4, "nothing here at all, internationalisationandmore", 7, "s", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, score string")
    got = secrets.scan(frame).collect()
    assert sorted((str(r["doc_id"]), r["candidate"]) for r in got if r["is_secret"]) == [
        ("3", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")] * 2 + [("None", "b7db7aa4a5fcc78305")]
    clean = secrets.redact(frame)
    by = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == frame.columns and by[1]["text"] is None and by[1]["n_chars"] is None
    assert by[None]["text"] == "password=[SECRET] and password=[SECRET]" and by[None]["n_chars"] == 39
    assert by[3]["text"].endswith('token = "[SECRET]"') and by[4]["text"] == rows[5][1] and by[4]["n_chars"] == 7
    assert secrets.scan(frame.limit(0)).collect() == []
    assert {r["score"] for r in secrets.scan(frame, secrets.labelled_findings(spark, 10).limit(0)).collect()} == {1.0}


def test_every_place_is_judged(spark):
    """A key that stands as a checksum first, or within a longer run, and is given to a secret's name later."""
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'see the sha256 checksum {key} of it, and so on. Later token = "{key}" and more', f'href /files/{key}/index of it. Then token = "{key}" and more',
             f"see the sha256 checksum {key} of the file."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["candidate"]) for r in secrets.scan(frame, path_col=None).collect() if r["is_secret"]}
    assert {(0, key), (1, key)} <= found and (2, key) not in found
    by = {r["doc_id"]: r["text"] for r in secrets.redact(frame, path_col=None).collect()}
    assert key not in by[0] and 'token = "[SECRET]"' in by[1] and by[2] == texts[2]
    again = secrets.scan(frame, path_col=None).groupBy("doc_id", "candidate").count().where("count > 1")
    assert again.count() == 0


def test_values_of_any_form_after_a_secrets_name(spark):
    """Short, all-letter, all-digit and marked values, found by a plain reading of name, sign and value."""
    secret = ["password=Tr0ub4dor3", 'pwd: "hunter2!hunter2"', 'token = "qkzvhtwpxjrmbgdnslcfyaeuoikqzx"', "secret_key: 90817263544536271809182736",
              "db_password='p4$$w0rd.Xy'"]
    plain = ["password: required", "token = get_token()", "the key: value of this", "secret = config.value.name", "password=${PASSWORD}", "password = none of it"]
    frame = spark.createDataFrame([(i, f"and so, {t} and more. ") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    found = {(r["doc_id"], r["candidate"]) for r in secrets.scan(frame, path_col=None).collect() if r["is_secret"]}
    want = {(i, t.replace(":", "=").split("=", 1)[1].strip(" \"'")) for i, t in enumerate(secret)}
    assert found == want
    by = {r["doc_id"]: r["text"] for r in secrets.redact(frame, path_col=None).collect()}
    for i, t in enumerate(secret + plain):
        value = dict(want).get(i)
        assert by[i] == f"and so, {t} and more. ".replace(value, "[SECRET]") if value else by[i] == f"and so, {t} and more. "


def test_a_text_of_many_candidates_takes_time_in_proportion(spark):
    import time
    words = [f"k{i}x{i * i}".ljust(20, "a") for i in range(16000)]
    took = {}
    for n in (16, 4000, 16000):
        frame = spark.createDataFrame([(1, " of ".join(words[:n]))], "doc_id long, text string")
        start = time.time()
        assert secrets.scan(frame, path_col=None).count() == n
        assert secrets.redact(frame, path_col=None).selectExpr("length(text)").first()[0] > 0
        took[n] = time.time() - start
    assert took[16000] - took[16] < 12 * max(0.5, took[4000] - took[16])


def test_columns_of_the_caller_stay(spark):
    frame = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "mine", 5, 3)], "doc_id long, text string, __secrets string, __clean int, n_chars int")
    out = secrets.redact(frame, path_col=None)
    assert out.schema == frame.schema and [tuple(r) for r in out.collect()] == [(1, 'token = "[SECRET]"', "mine", 5, 18)]
