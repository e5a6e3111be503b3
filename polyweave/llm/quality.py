"""Quality from weak labels: EM over heuristic labellers, posteriors train a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, settle, text_bytes

BAD, GOOD, NONE = 0, 1, 2
#: weights of the scorer; rows of its training sample and the longest text in it; where it keeps a text
BUCKETS, SAMPLE_ROWS, SAMPLE_CHARS, KEEP = 1 << 15, 8000, 20_000, 0.5


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with what the labellers look at, each counted once; null is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda chars: F.col("__chars") - F.length(F.regexp_replace("__text", f"[{chars}]", ""))
    lists = docs.withColumns({"__text": text, "__words": F.array_remove(F.split(text, r"\s+"), ""),
                              "__lines": F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), "__chars": F.length(text)})
    return lists.withColumns({
        "__n": F.size("__words"), "__kinds": F.size(F.array_distinct("__words")), "__n_lines": F.size("__lines"),
        "__line_kinds": F.size(F.array_distinct("__lines")), "__ends": F.size(F.filter("__lines", lambda s: F.rtrim(s).rlike("[.!?…]$"))),
        "__symbols": left(r"#%*$&|~\^<>{}"), "__digits": left("0-9"), "__stops": left(".!?…")}).drop("__text", "__words", "__lines")


def labellers() -> dict[str, Column]:
    """Heuristic votes on a measured text: 1 good, 0 bad, 2 no opinion.  None sees a label."""
    n, kinds, n_lines, line_kinds, ends, symbols, digits, stops, chars = (
        F.col(f"__{c}") for c in "n kinds n_lines line_kinds ends symbols digits stops chars".split())

    def vote(good, bad):
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE).cast("int")

    return {
        "length": vote(n >= 60, n < 8),
        "symbols": vote(symbols < 0.004 * chars, symbols > 0.02 * chars),
        "word_length": vote((chars >= 4.2 * n) & (chars <= 6.9 * n), (chars > 8 * n) | (chars < 3.5 * n)),
        "variety": vote(kinds >= 0.6 * n, (n >= 30) & (n <= 3000) & (kinds < 0.5 * n)),
        "line_ends": vote(ends >= 0.8 * n_lines, ends < 0.5 * n_lines),
        "repeated_lines": vote((n_lines > 1) & (line_kinds >= 0.95 * n_lines), line_kinds < 0.85 * n_lines),
        "digits": vote(F.lit(False), digits > 0.1 * chars),
        "sentences": vote((stops * 30 >= n) & (stops * 3 <= n), (stops * 60 < n) | (stops * 1.5 > n)),
    }


def pattern() -> Column:
    """All votes on a measured text as one number in base 3."""
    total = F.lit(0)
    for vote in labellers().values():
        total = total * 3 + vote
    return total.cast("int")


class LabelModel:
    """EM for a good and a bad class whose labellers err, abstain and overlap, each in its own way.

    The counts of vote patterns are all it needs (3 ** labellers numbers at most, whatever the
    number of texts).  It starts from the majority of votes.
    """

    def __init__(self, patterns: dict[int, int], n_labellers: int, rounds: int = 200, smooth: float = 1.0):
        self.n = n_labellers
        codes = np.array(sorted(patterns), np.int64)
        counts = np.array([patterns[c] for c in codes.tolist()], float)
        votes = self._votes(codes)
        score = (votes == GOOD).sum(1) - (votes == BAD).sum(1)
        posterior = 1 / (1 + np.exp(-1.5 * score.astype(float)))
        self.share, self.table = 0.5, np.full((2, n_labellers, 3), 1 / 3)
        for _ in range(rounds if len(codes) else 0):
            for y, weight in ((1, posterior), (0, 1 - posterior)):
                for v in range(3):
                    self.table[y, :, v] = smooth + ((votes == v) * (weight * counts)[:, None]).sum(0)
                self.table[y] /= self.table[y].sum(1, keepdims=True)
            self.share = float((posterior @ counts + smooth) / (counts.sum() + 2 * smooth))
            new = self.posterior(codes)
            done = np.abs(new - posterior).max() < 1e-9
            posterior = new
            if done:
                break

    def _votes(self, codes) -> np.ndarray:
        return np.asarray(codes, np.int64)[:, None] // 3 ** np.arange(self.n - 1, -1, -1) % 3

    def posterior(self, codes) -> np.ndarray:
        """Probability of the good class for each pattern."""
        votes, each = self._votes(codes), np.arange(self.n)
        good, bad = (np.log(self.table[y][each, votes]).sum(1) for y in (1, 0))
        return 1 / (1 + np.exp(np.clip(bad - good + np.log((1 - self.share) / self.share), -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Share of right votes of each labeller among those it casts."""
        right = self.share * self.table[1, :, GOOD] + (1 - self.share) * self.table[0, :, BAD]
        cast = self.share * self.table[1, :, :2].sum(1) + (1 - self.share) * self.table[0, :, :2].sum(1)
        return right / cast


# ------------------------------------------------------------------------------- scorer

#: the first buckets are for last bytes and lengths of words, the others for hashed words
SHAPES = 256 + 32


class Hashes(dict):
    """Bucket of a word; bounded memory."""

    def __missing__(self, word: bytes) -> int:
        n = SHAPES + zlib.crc32(word) % (BUCKETS - SHAPES)
        if len(self) < 200_000:
            self[word] = n
        return n


def values_of(text: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights: square root counts, scaled to length one."""
    words = Counter(text.lower().split())
    size, times = len(words), np.fromiter(words.values(), np.float64, len(words))
    at = np.concatenate([np.fromiter(map(hashes.__getitem__, words), np.int64, size), np.fromiter((w[-1] for w in words), np.int64, size),
                         256 + np.minimum(np.fromiter(map(len, words), np.int64, size), 31)])
    counts = np.bincount(at, np.tile(times, 3), BUCKETS)
    found = np.flatnonzero(counts)
    return found, np.sqrt(counts[found] / max(1.0, 3 * times.sum()))


def train(texts: list[tuple[bytes, float]], rounds: int = 4, rate: float = 2.0) -> np.ndarray:
    """Logistic scorer by stochastic gradient descent on soft labels; the last weight is the constant."""
    hashes, rnd = Hashes(), np.random.default_rng(3)
    rows, weights = [(*values_of(t, hashes), y) for t, y in sorted(texts)], np.zeros(BUCKETS + 1)
    for k in range(rounds):
        for i in rnd.permutation(len(rows)):
            at, x, y = rows[i]
            error = y - 1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30)))
            weights[at] += rate / (1 + k) * error * x
            weights[-1] += 0.1 * rate / (1 + k) * error
    return weights.astype(np.float32)


def score(text: str | Column, weights: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Hashes()

        def one(t):
            at, x = values_of(t, hashes)
            return float(1 / (1 + np.exp(-np.clip(float(weights[at] @ x + weights[-1]), -30, 30))))

        for batch in batches:
            yield by_slices(one, pa.float64(), batch)

    return run(text_bytes(text))


def fit(docs: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """Label model from the votes on all texts; scorer from a bounded sample with its posteriors.

    The sample is the ``SAMPLE_ROWS`` texts of least hash of at most ``SAMPLE_CHARS`` characters,
    read by one task.
    """
    names = list(labellers())
    votes = settle(measured(docs.select("text")).select(F.xxhash64("text").alias("h"), pattern().alias("pattern"), F.length("text").alias("n")))
    patterns = {r["pattern"]: r["count"] for r in votes.groupBy("pattern").count().collect()}  # 3 ** labellers at most
    model = LabelModel(patterns, len(names))
    picked = votes.where(F.col("n") <= SAMPLE_CHARS).select("h").distinct().orderBy("h").limit(SAMPLE_ROWS)
    known = docs.sparkSession.createDataFrame([(c, float(p)) for c, p in zip(patterns, model.posterior(list(patterns)))] or [(-1, 0.5)], "pattern int, good double")
    sample = docs.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), "h").dropDuplicates(["h"])
    sample = (measured(sample).select(text_bytes("text").alias("text"), pattern().alias("pattern"))
              .join(F.broadcast(known), "pattern").select("text", "good").repartition(1))

    def run(batches):
        texts = [(t, y) for b in batches for t, y in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([train(texts).tobytes()], pa.binary())], ["weights"])

    row = sample.mapInArrow(run, "weights binary").first()
    return model, np.frombuffer(bytes(row["weights"]), np.float32) if row else train([])


def scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, score, keep, posterior)`` for every row of ``docs``, repeated or not.

    ``posterior`` is the label model's probability of good from the votes alone, ``score`` the
    linear scorer's; a text is kept from ``KEEP`` on.  Null is the empty text.  Other columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    model, weights = fit(docs)
    every = np.arange(3 ** model.n)
    table = F.array(*[F.lit(float(p)) for p in model.posterior(every)])
    out = measured(docs).select("doc_id", score("text", weights).alias("score"), F.element_at(table, pattern() + 1).alias("posterior"))
    return out.select("doc_id", "score", (F.col("score") >= KEEP).alias("keep"), "posterior")
