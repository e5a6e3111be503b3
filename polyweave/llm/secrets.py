"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything on the main path is DataFrame and SQL functions.  The forest is fitted by Spark ML on
labelled findings and then written out as a SQL expression, so that a text is scanned, judged and
redacted within its own row: no shuffle, and nothing that grows with the texts leaves a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

#: what may be a secret: a run of key characters, long enough
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: and what a secret's name is given by = or :, of any length and with any marks; the value is group 1
ASSIGNED = (r"(?i)(?:key|token|secret|passwd|passw|password|pwd|auth|credentials?)[\w.-]{0,20}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?"
            r"([^\s\"',;<>]{5,}[^\s\"',;<>.)\]}])")
BEFORE, AFTER = 40, 12
TREES, DEPTH, THRESHOLD, MARK = 16, 6, 0.5, "[SECRET]"

# Words that identifiers, paths and placeholders are made of.
DICTIONARY = ("the and for this that with from are was example sample test dummy placeholder your insert change here none null true false "
              "file path data user name admin root home page index main item list table column value number version release build "
              "config default local server client http https www com org net html json yaml image static assets module package "
              "function class method object string model train batch epoch layer week month year date time "
              "password token secret required optional undefined environ self get env process hidden").split()
SECRET_WORDS = "key|token|secret|passw|pwd|auth|credential|bearer|private|apikey|access"
OTHER_WORDS = "sha|md5|hash|checksum|digest|commit|revision|uuid|guid|version|http|href|src|url|path|file|id|isbn|phone|card|serial|order"
KNOWN_STARTS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29|eyJ|npm_|pypi-|SG\\.)"
TEST_PATHS = "test|example|sample|fixture|mock|doc|demo|spec"
SECRET_PATHS = "env|config|settings|secret|credential|deploy|prod|properties"


# -------------------------------------------------------------------------- features

def _features(c: str, before: str, after: str, path: str) -> dict[str, str]:
    """SQL of each feature of a candidate ``c`` with its neighbours; all are numbers."""
    size = f"length({c})"
    classes = f"translate({c}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '{'a' * 26}{'A' * 26}{'0' * 10}')"
    share = lambda cls: f"({size} - length(regexp_replace({c}, '[{cls}]', ''))) / {size}"
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda value, pattern: f"cast(lower({value}) rlike '{pattern}' as double)"
    return {
        "length": f"cast({size} as double)",
        "digits": share("0-9"), "upper": share("A-Z"), "hex": share("0-9a-f"), "marks": share("+/_=-"),
        "other_marks": share("^A-Za-z0-9+/_=-"), "code": f"cast({c} rlike '[(){{}}$%]|^[A-Za-z_]+[.][A-Za-z_]+' as double)",
        "transitions": f"length(regexp_replace({classes}, '(.)\\\\1*', 'x')) / {size}",
        "distinct": f"size(array_distinct(split({c}, ''))) / {size}",
        "vowels": share("aeiouAEIOU"),
        "longest_letters": f"array_max(transform(split({c}, '[^A-Za-z]+'), w -> length(w))) / {size}",
        "coverage": f"({size} - length(regexp_replace(lower({c}), '{words}', ''))) / {size}",
        "known_start": f"cast({c} rlike '{KNOWN_STARTS}' as double)",
        "secret_word": flag(before, SECRET_WORDS), "other_word": flag(before, f"\\\\b({OTHER_WORDS})s?\\\\b"),
        "assigned": f"cast({before} rlike '[=:]\\\\s*[\"\\']?$' as double)", "quoted": f"cast({before} rlike '[\"\\']$' as double)",
        "goes_on": f"cast({after} rlike '^[./:@]\\\\w' as double)",
        "test_path": flag(path, TEST_PATHS), "secret_path": flag(path, SECRET_PATHS),
    }


NAMES = list(_features("c", "b", "a", "p"))


# ------------------------------------------------------------------- labelled findings

def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``(candidate, before, after, path, label)``: findings of known kinds, made by SQL functions.

    Half are secrets (keys with known starts, random hexadecimal and base64 values that are given
    to a secret's name), half are what scans wrongly report (digests, ids, paths, placeholders,
    long identifiers, card and phone numbers, values that are given to other names).
    """
    hexes = F.sha2(F.concat(F.lit("polyweave"), F.col("id").cast("string")).cast("binary"), 512)
    plain = F.regexp_replace(F.base64(F.unhex(hexes)), r"\s", "")
    frame = spark.range(rows).select(
        "id", hexes.alias("hex"), plain.alias("b64"), F.upper(F.translate(plain, "+/=0189", "ABCDEFG")).alias("caps"),
        F.pmod(F.xxhash64("id"), F.lit(997)).alias("r"), (F.col("id") % 2).cast("int").alias("label"))
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), F.pmod(by, F.lit(len(options))).cast("int") + 1)
    part = lambda text, low, spread: F.substring(text, F.lit(1), (F.lit(low) + F.col("r") % spread).cast("int"))
    word = lambda k: pick(DICTIONARY, F.pmod(F.hash("id", F.lit(k)), F.lit(10007)))
    secret = F.expr("cast(pmod(hash(id, 1), 9) as int)")
    good = (F.when(secret == 0, F.concat(F.lit("AKIA"), F.substring("caps", 1, 16)))
            .when(secret == 1, F.concat(pick(["ghp_", "glpat-", "sk-", "sk_live_", "xoxb-", "AIza", "npm_"], F.col("r")), F.translate(part("b64", 24, 16), "+/=", "xyz")))
            .when(secret == 2, part("b64", 20, 44)).when(secret == 3, F.substring("hex", 1, 40)).when(secret == 4, F.substring("hex", 1, 18))
            .otherwise(part("hex", 16, 49)))
    other = F.expr("cast(pmod(hash(id, 2), 10) as int)")
    bad = (F.when(other == 0, pick([32, 40, 64], F.col("r")).cast("int")).otherwise(F.lit(0)))
    fake = (F.when(other <= 1, F.substring(F.col("hex"), F.lit(1), F.when(bad > 0, bad).otherwise(F.lit(40))))
            .when(other == 2, F.concat_ws("-", *[F.substring("hex", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
            .when(other == 3, F.concat_ws("/", word(1), word(2), word(3), F.concat(word(4), (F.col("r") % 50).cast("string"))))
            .when(other == 4, F.concat_ws("_", word(5), word(6), word(7), word(8), (F.col("r") % 90).cast("string")))
            .when(other == 5, F.concat_ws("-", F.lit("your"), word(1), word(2), F.lit("key"), F.lit("here123")))
            .when(other == 6, F.substring(F.translate("hex", "abcdef", "012345"), 1, 16))
            .when(other == 7, F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), (F.col("r") % 9).cast("string")))
            .when(other == 8, F.rpad(F.concat(word(1), F.lit("xxxxxxxxxxxxxxxx0000")), 24, "x"))
            .otherwise(part("b64", 24, 30)))
    names = ["token", "api_key", "secret", "password", "access_token", "client_secret", "auth", "AWS_SECRET", "Authorization bearer", "private key", "passwd"]
    others = ["sha256", "commit", "checksum", "md5", "integrity sha", "href", "file", "uuid", "version", "image id", "order", "serial", "see", "of the", "url", "digest"]
    signs = [' = "', "=", ": ", ":", '": "', " ", "='"]
    after = pick(['"', " and", "", "'", "\n", ", then"], F.hash("id", F.lit(3)))
    said = F.concat(pick(["of the ", "", "x ", "\n", "export ", "let "], F.hash("id", F.lit(4))), F.when(F.col("label") == 1, pick(names, F.hash("id", F.lit(5))))
                    .otherwise(pick(others, F.hash("id", F.lit(6)))), pick(signs, F.hash("id", F.lit(7))))
    # keys of a known form stand alone as well; placeholders and identifiers also after a secret's name
    said = (F.when((F.col("label") == 1) & (secret <= 1) & (F.col("r") % 2 == 0), pick(["ation on ", "the ", "", "was: "], F.hash("id", F.lit(8))))
            .when((F.col("label") == 0) & other.isin(4, 5, 7, 8) & (F.col("r") % 2 == 0), F.concat(pick(names, F.col("r")), pick(signs, F.hash("id", F.lit(9))))).otherwise(said))
    # values of any form that are given to a secret's name: short passwords, letters or digits alone; and words, code and placeholders
    short = F.expr("cast(pmod(hash(id, 11), 3) as int) = 0")
    letters = F.translate("hex", "0123456789", "ghjkmpqrst")
    form = F.expr("cast(pmod(hash(id, 12), 6) as int)")
    mark = pick(["!", "@", "#", ".", "$", "&"], F.hash("id", F.lit(13)))
    good = F.when(~short, good).when(form == 0, F.concat(F.initcap(F.substring(letters, 1, 6)), F.substring(F.translate("hex", "abcdef", "012345"), 1, 2), mark)).when(
        form == 1, F.concat(word(1), F.substring(F.translate("hex", "abcdef", "012345"), 1, 3), mark, F.substring("b64", 1, 6))).when(
        form == 2, F.substring(letters, F.lit(1), (F.lit(18) + F.col("r") % 20).cast("int"))).when(
        form == 3, F.substring(F.translate("hex", "abcdef", "012345"), F.lit(1), (F.lit(16) + F.col("r") % 16).cast("int"))).when(
        form == 4, F.substring(F.translate("b64", "+/=", "!@#"), F.lit(3), (F.lit(8) + F.col("r") % 7).cast("int"))).otherwise(
        F.concat(F.initcap(F.translate(word(2), "oe", "03")), F.substring("hex", 1, 4), F.substring(letters, 9, 3)))
    fake = F.when(~short, fake).when(form == 0, word(1)).when(form == 1, F.concat_ws("_", word(1), word(2))).when(
        form == 2, F.concat(F.lit("get_"), word(3), F.lit("("), word(4))).when(form == 3, F.concat_ws(".", word(5), word(6), word(7))).when(
        form == 4, F.concat(pick(["${", "{{", "$", "%("], F.col("r")), F.upper(word(8)))).otherwise(F.concat_ws("-", word(1), word(2), word(3)))
    said = F.when(short, F.concat(pick(names, F.col("r")), pick([' = "', "=", ": ", ":", '": "', "='"], F.hash("id", F.lit(14))))).otherwise(said)
    path = (F.when(F.hash("id", F.lit(10)) % 3 == 0, pick(["config/prod.env", "deploy/settings.py", "app.properties", "src/main.py"], F.col("r")))
            .when((F.hash("id", F.lit(10)) % 3 == 1) & (F.col("label") == 0), pick(["tests/test_a.py", "docs/example.md", "fixtures/mock.json"], F.col("r"))).otherwise(F.lit("web")))
    return frame.select(F.when(F.col("label") == 1, good).otherwise(fake).alias("candidate"), said.alias("before"), after.alias("after"), path.alias("path"), "label")


# ---------------------------------------------------------------------------- forest

def _number(value: float) -> str:
    return f"{value!r}D"


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> str:
    """SQL of the forest's probability that a struct ``s`` of features is a secret.

    ``findings`` are as ``labelled_findings``; nulls count as empty, rows without label are left
    out.  Without both labels every candidate counts as a secret: nothing is known to be false.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = findings.where(F.col("label").isin(0, 1)).select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("candidate", "before", "after", "path")], F.col("label").cast("double").alias("label")).where("candidate <> ''")
    if known.agg(F.count_distinct("label")).first()[0] < 2:
        return "1.0D"
    rows = known.selectExpr("label", *[f"coalesce(cast({sql} as double), 0D) as {name}" for name, sql in _features("candidate", "before", "after", "path").items()])
    model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(
        VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("features", "label"))

    def written(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return _number(stats[1] / sum(stats))
        split = node.split()
        return f"CASE WHEN s.{NAMES[split.featureIndex()]} <= {_number(split.threshold())} THEN {written(node.leftChild())} ELSE {written(node.rightChild())} END"

    return "(" + " + ".join(written(tree._java_obj.rootNode()) for tree in model.trees) + f") / {len(model.trees)}D"


# ------------------------------------------------------------------------------ scan

def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(text: str, pattern: str, named: bool) -> str:
    """SQL struct of the matches of a pattern in a text, their values, and the gaps around them: gap, match, gap, ... gap."""
    pattern = _literal(pattern)
    group = lambda n: f"regexp_extract_all({text}, {pattern}, {n})"
    return f"named_struct('runs', {group(0)}, 'values', {group(1 if named else 0)}, 'gaps', split({text}, {pattern}, -1))"


def _places(pieces: str) -> str:
    """SQL array of (c, b, a): the values of ``_pieces`` with what stands before and after.  Three matches are longer than
    what is looked at, so every place is made from the pieces next to it and the whole takes time in proportion to the text."""
    piece = lambda name, i: f"right(coalesce(get(p.{name}, i - {i}), ''), {BEFORE})"
    earlier = ", ".join(piece(name, i) for i in (3, 2, 1) for name in ("gaps", "runs"))
    before = f"right(concat({earlier}, {piece('gaps', 0)}, substring(p.runs[i], 1, length(p.runs[i]) - length(c))), {BEFORE})"
    after = f"left(concat(left(p.gaps[i + 1], {AFTER}), left(coalesce(get(p.runs, i + 1), ''), {AFTER})), {AFTER})"
    # a match of a name ends with its value, or with a quote's value: the name and sign are what it begins with
    return f"transform(array({pieces}), p -> transform(p.values, (c, i) -> named_struct('c', c, 'b', {before}, 'a', {after})))[0]"


def _run_places(text: str) -> str:
    return f"filter({_places(_pieces(text, CANDIDATE, False))}, x -> x.c rlike '[0-9]' and x.c rlike '[A-Za-z]')"


def _assigned_places(text: str) -> str:
    """Places of the second form; what is of the first form as a whole is left to that."""
    none = "cast(array() as array<struct<c: string, b: string, a: string>>)"
    places = f"filter({_places(_pieces(text, ASSIGNED, True))}, x -> not (x.c rlike {_literal('^' + CANDIDATE + '$')} and x.c rlike '[0-9]' and x.c rlike '[A-Za-z]'))"
    return f"if({text} rlike {_literal(ASSIGNED)}, {places}, {none})"


def findings_of(text: str, path: str | None, forest: str) -> Column:
    """Array of (candidate, score) of the distinct candidates of a whole text, in order of the candidates.

    ``text`` and ``path`` are SQL of string columns.  Candidates are runs of 16 or more key characters with a digit and a
    letter, and values of six or more characters that a secret's name is given.  Every place is judged with its own
    neighbours, which are what stands between it and the candidates around it or further; a candidate has the
    largest score of its places.
    """
    text, path = f"coalesce({text}, '')", f"coalesce(cast({path} as string), '')" if path else "''"
    places = f"concat({_run_places(text)}, {_assigned_places(text)})"
    fields = ", ".join(f"'{name}', coalesce(cast({sql} as double), 0D)" for name, sql in _features("x.c", "x.b", "x.a", path).items())
    seen = f"transform({places}, x -> named_struct('candidate', x.c, {fields}))"
    judged = f"array_sort(transform({seen}, s -> named_struct('candidate', s.candidate, 'score', {forest})))"
    largest = "filter(j, (f, i) -> i = size(j) - 1 or get(j, i + 1).candidate <> f.candidate)"
    return F.expr(f"transform(array({judged}), j -> {largest})[0]")


def scan(docs: DataFrame, findings: DataFrame | None = None, path_col: str | None = "source") -> DataFrame:
    """``(doc_id, candidate, score, is_secret)`` for every distinct candidate of every row of ``docs``.

    Texts are scanned whole; null and empty texts have no candidates, repeated rows report again.
    ``findings`` train the forest (default: ``labelled_findings``).  Other columns are ignored.
    """
    forest = fit(labelled_findings(docs.sparkSession) if findings is None else findings)
    path = path_col if path_col in docs.columns else None
    rows = docs.select("doc_id", F.explode(findings_of("text", path, forest)).alias("f"))
    return rows.select("doc_id", F.col("f.candidate").alias("candidate"), F.col("f.score").alias("score"), (F.col("f.score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, path_col: str | None = "source") -> DataFrame:
    """``docs`` (columns unchanged) with every secret replaced by ``MARK``; ``n_chars`` follows.

    A text is put together again from its pieces: values that a secret's name is given, then runs of key
    characters, wherever the same run stands.  Rows without a secret keep text and ``n_chars`` as they are, null and
    empty ones too; repeated rows stay; other columns are never touched.
    """
    forest = fit(labelled_findings(docs.sparkSession) if findings is None else findings)
    path = path_col if path_col in docs.columns else None
    found, clean = free_names(docs, "secrets", "clean")
    secrets = F.transform(F.filter(findings_of("text", path, forest), lambda f: f["score"] >= THRESHOLD), lambda f: f["candidate"])

    def rebuilt(pieces: str, marked: str) -> str:
        """Gaps and matches in turn; a match whose value is a secret keeps what stands before the value."""
        kept = "substring(p.runs[i], 1, length(p.runs[i]) - length(c))"
        parts = f"transform(p.values, (c, i) -> concat(p.gaps[i], if({marked}, concat({kept}, '{MARK}'), p.runs[i])))"
        return f"transform(array({pieces}), p -> concat(array_join({parts}, ''), element_at(p.gaps, -1)))[0]"

    of_names = f"if(text rlike {_literal(ASSIGNED)}, {rebuilt(_pieces('text', ASSIGNED, True), f'array_contains(`{found}`, c)')}, text)"
    marked = docs.withColumn(found, secrets).withColumn(clean, F.when(F.size(found) > 0, F.expr(of_names)))
    of_runs = rebuilt(_pieces(f"`{clean}`", CANDIDATE, False), f"array_contains(`{found}`, c)")
    marked = marked.withColumn("text", F.when(F.size(found) > 0, F.expr(of_runs)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        marked = marked.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)
