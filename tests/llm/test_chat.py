import random
import re

import duckdb
import pytest
from compare import compare

from polyweave.llm import chat, queries

SCHEMA = "conv_id long, turn int, role string, text string, depth string"


def plain(rows):
    """The same links with plain loops."""
    def norm(s):
        return " ".join(re.findall(r"[^\W_]+", s.lower()))
    parsed = []
    for conv, turn, *_, text, _ in rows:
        lines = []
        for line in (text or "").split("\n"):
            lead = re.match(r"^\s*((>\s?)+)", line)
            level = lead[0].count(">") if lead else 0
            lines.append((level, norm(line[lead.end():] if lead else line)))
        parsed.append((conv, turn, lines))
    parents, linked = [], []
    for conv, turn, lines in parsed:
        found = {}
        for level, said in lines:
            if level and said:
                origin = max((t for c, t, ls in parsed if c == conv and t < turn and (0, said) in ls), default=None)
                if origin is not None:
                    found.setdefault(level, []).append(origin)
        linked.append(sum(map(len, found.values())))
        level = found[min(found)] if found else []
        parents.append(max(level, key=lambda t: (level.count(t), t)) if level else None)
    return parents, linked


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 2)])
def test_against_plain_loops(spark, monkeypatch, seed, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rnd, rows = random.Random(seed), []
    for conv in range(6):
        said = []
        for turn in range(rnd.choice([1, 4, 12])):
            lines = [rnd.choice(["yes", "no way", "I see.", "third thing"]) for _ in range(rnd.choice([0, 1, 2]))]
            for _ in range(rnd.choice([0, 1, 3])):
                lines.append(rnd.choice(["> ", ">> ", "> > ", " >"]) + rnd.choice(said + ["unknown", "YES", "I  see", "..."]))
            said += [x for x in lines if ">" not in x]
            rows.append((conv, turn, "user", "\n".join(lines), "x"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role TEXT, text TEXT, depth TEXT)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    ok, text = compare(spark, con, "", "chat", lambda *_: chat.conversations(spark.createDataFrame(rows, SCHEMA)), queries.SQL["op5_quotations"])
    assert ok, text
    parents, linked = plain(rows)
    for row, parent, n in zip(rows, parents, linked):
        r = got[row[0], row[1]]
        assert (r["parent_turn"], r["n_linked"]) == (parent, n)
        assert not any(re.match(r"\s*>", x) for x in r["text"].split("\n"))
        steps, at = 0, row[1]
        while got[row[0], at]["parent_turn"] is not None:
            steps, at = steps + 1, got[row[0], at]["parent_turn"]
        assert (r["depth"], r["thread_turn"]) == (steps, at)


def test_query_matches_sql(spark, small, con):
    ok, text = compare(spark, con, small, "op5_quotations", *queries.registered()["op5_quotations"])
    assert ok, text


def test_odd_rows(spark):
    rows = [(None, 0, "u", "> hi", None), (1, None, "u", "hi", None), (2, 0, None, None, None), (2, 1, "a", "", "x"), (2, 1, "a", "", "x"),
            (3, 0, "u", "hi\n" * 20000, "y"), (3, 1, "u", "> HI!", "y"), (3, 1, "u", "> HI!", "y")]
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert [(r["parent_turn"], r["n_linked"], r["depth"]) for r in got if r["conv_id"] == 3 and r["turn"] == 1] == [(0, 1, 1)] * 2
    assert all(r["parent_turn"] is None for r in got if r["conv_id"] != 3)
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).collect() == []
