"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_slices, settle, text_bytes

WINDOW = 10
#: share of a document's words from which the whole document goes, not only the spans
COVERAGE = 0.5
#: UTF-8 bytes of test items in one automaton; more items than that take more passes
ITEM_BYTES = 1_000_000

# words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z is lower-cased
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each window.

    A state stands for word sequences that end at the same places of the items.  The state that
    is reached and the matched length say which windows end at a word of a streamed text.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.step, self.link, self.length = [{}], [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words])
                     for name, text in items if (words := normal_words(text))]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self._mark(sequences)

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for exactly the sequences of ``state`` followed by ``word``."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # known from an earlier item
            return self._split(last, word)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _mark(self, sequences) -> None:
        """``holders``: items with the window of a state; ``whole``: short items that end there."""
        n, size = len(self.length), self.window
        home = [0] * n  # the state, among a state and those it links to, that stands for its last `size` words
        holders, whole = [set() for _ in range(n)], [[] for _ in range(n)]
        for s in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[s] >= size:
                home[s] = s if self.length[self.link[s]] < size else home[self.link[s]]
        for name, sequence in sequences:
            s = 0
            for i, word in enumerate(sequence):
                s = self.step[s][word]
                if i + 1 >= size:
                    holders[home[s]].add(name)
            if len(sequence) < size:
                while self.length[self.link[s]] >= len(sequence):
                    s = self.link[s]
                whole[s].append((len(sequence), name))
        for s in sorted(range(1, n), key=self.length.__getitem__):
            whole[s] = whole[s] + whole[self.link[s]]
        self.home, self.holders, self.whole = home, [frozenset(h) for h in holders], [tuple(w) for w in whole]
        self.least = min((min(size, len(s)) for _, s in sequences), default=None)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans ``[from, to)`` inside occurrences of windows, and the items they are of."""
        spans, found = [], set()
        if self.least is None or len(words) < self.least:
            return spans, found
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        gaps = np.flatnonzero(np.concatenate([[True], ids < 0, [True]]))  # a match can't go over an unknown word
        for g in np.flatnonzero(np.diff(gaps) > self.least):
            start = int(gaps[g])
            self._stream(ids[start:int(gaps[g + 1]) - 1].tolist(), start, spans, found)
        return spans, found

    def _stream(self, ids, start, spans, found) -> None:
        step, link, length, size = self.step, self.link, self.length, self.window
        state = matched = 0
        for i, word in enumerate(ids, start + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state][word]
            matched += 1
            reach = 0
            if matched >= size:
                reach = size
                found |= self.holders[self.home[state]]
            for n, name in self.whole[state]:
                if matched >= n:
                    reach = max(reach, n)
                    found.add(name)
            if reach:
                first = i - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))


def without(text: bytes, spans) -> bytes:
    """``text`` less the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_WORD_BYTES))]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at:places[first][0]])
        at = places[last - 1][1]
    return b"".join([*out, text[at:]])


#: bounds of item text that a task sorts to deal items to groups
DEALT = 4


def _groups(items: DataFrame, item_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """Number of groups of items, and the groups, each fetched when it is asked for.

    A group has less than ``item_bytes`` of text before its last item.  Repeated rows count once.  Items are dealt by hash to
    parts of a few bounds; within a part, running sums give every item its group.  Only the groups' numbers and the
    text of one group at a time are in the driver.
    """
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes("text").alias("text")).distinct()
    size = F.length("text") + 64
    total = rows.agg(F.sum(size)).first()[0] or 0
    read = lambda part: [(r["item"], bytes(r["text"])) for r in part.select("item", "text").toLocalIterator()]
    if total <= item_bytes:
        return 1, iter([read(rows)])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // (DEALT * item_bytes)))))
    before = F.sum(size).over(Window.partitionBy("part").orderBy("item", "text")) - size
    dealt = settle(dealt.withColumn("nth", F.floor(before / item_bytes)))
    names = [tuple(r) for r in dealt.select("part", "nth").distinct().orderBy("part", "nth").collect()]
    return len(names), (read(dealt.where((F.col("part") == part) & (F.col("nth") == nth))) for part, nth in names)


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
         item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word ranges that are hit) and ``items`` (item ids).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window.  A word inside any occurrence of a window is hit.  Null texts have no words;
    items without words hit nothing; items with a null id are named ''.  Rows are kept as they
    are, repeated or not, and columns that clash with the new ones are replaced.

    What goes to the tasks is at most ``item_bytes`` of item text and one item at a time (1 MB makes an automaton
    of about 130 MB); larger item tables are taken in several passes over the documents.
    """
    added = ("n_words", "spans", "items")
    out = docs.select(*[c for c in docs.columns if c not in (*added, "__text")],
                      (text_bytes(text_col) if text_col != "__text" else F.col("__text")).alias("__text"))
    kinds = {"n_words": "long", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    n_groups, groups = _groups(items, item_bytes)
    for g, group in enumerate(groups):
        shared, group = docs.sparkSession.sparkContext.broadcast(group), None
        kept = [f for f in out.schema if f.name not in added and (f.name != "__text" or g + 1 < n_groups)]

        def run(batches, shared=shared, kept=[f.name for f in kept]):  # noqa: B006
            automaton = ItemAutomaton(shared.value, window)
            for batch in batches:
                n, spans, found = [], [], []
                before = [batch.column(c).to_pylist() if c in batch.schema.names else [()] * batch.num_rows for c in ("spans", "items")]
                for text, old, names in zip(batch.column("__text").to_pylist(), *before):
                    words = normal_words(text)
                    hit, new = automaton.hits(words)
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in _merged([*hit, *((s["start"], s["end"]) for s in old)])])
                    found.append(sorted({*new, *names}))
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, kept), pa.array(n, pa.int64()), pa.array(spans, span_kind), pa.array(found, pa.list_(pa.string()))],
                    [*kept, *added])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} {k}" for c, k in kinds.items()]
        out = out.mapInArrow(run, ", ".join(fields))
        if g + 1 < n_groups:  # one automaton in a worker at a time, and no pass is run again
            out = settle(out)
            shared.destroy()
    return out


def _merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_words() -> Column:
    """Number of words in the (disjoint) ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: words, hit words, number and digest of the items found in it."""
    found = mark(docs.select("doc_id", text_bytes("text").alias("__text")), items, text_col="__text", **options)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
                  item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` (columns unchanged) without the spans of ``items``; ``n_chars`` follows the text.

    A document goes as a whole if more than ``coverage`` of its words are hit.  Windows are those
    of the text as it came; what stands before and after a span is not taken for a passage.  Null and empty texts
    and repeated rows stay as they are; other columns are never touched, whatever their names.
    """
    row, clean = "row", F.when(F.size("spans") > 0, _cut("row.text", "spans")).otherwise(F.col("row.text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), text_bytes("text").alias("__text"))
    seen = mark(whole, items, window, text_col="__text", item_bytes=item_bytes)
    cut = seen.where(hit_words() <= coverage * F.col("n_words")).withColumn("clean", clean)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return cut.select(*[out[c].alias(c) for c in docs.columns])


def _cut(text: str, spans: str):
    @F.arrow_udf("string")
    def cut(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        def one(t, spans):
            return t if t is None or not spans else without(t.encode(), _merged((s["start"], s["end"]) for s in spans)).decode()
        return by_slices(one, pa.string(), texts, all_spans)
    return cut(F.col(text), F.col(spans))
