"""Toxicity by compression distance: windows under a toxic and an ordinary zstandard dictionary.

Both dictionaries hold the same ordinary words, so they compress ordinary windows alike.  The
toxic one also holds the words that toxic text has more often than chance allows.  A window is
toxic as far as the second dictionary makes it shorter, and a logistic curve that is fitted on
labelled texts kept apart turns a document's best windows into a probability.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, text_bytes

#: words of a window and of its step; longer "words" are cut into pieces of so many bytes
WINDOW, STEP, WORD_BYTES = 6, 4, 48
#: the model is fitted on at most so many labelled texts of either class, of at most so many characters
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 4000, 12000, 20000
#: words of the ordinary dictionary, and the least log-likelihood ratio of a toxic word
ORDINARY_WORDS, EVIDENCE, TOXIC_WORDS = 16000, 8.0, 4000
LEVEL, THRESHOLD, BEST = 3, 0.3, 3


def words_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(text) > WORD_BYTES and any(len(w) > WORD_BYTES for w in words):
        return [w[i:i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def windows(text: bytes) -> list[bytes]:
    words = words_of(text)
    return [b" %b " % b" ".join(words[i:i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)] if words else []


def dictionaries(texts: list[tuple[bytes, int]]) -> tuple[bytes, bytes]:
    """Content of the ordinary and the toxic dictionary, most telling words last.

    A word counts once for a text, and once for all near copies of a text (texts with the same
    least shingle hash): else the words of a copied toxic text would all look toxic.
    """
    seen, counts, n = (set(), set()), (Counter(), Counter()), [0, 0]
    for text, toxic in texts:
        words = words_of(text)
        family = min((zlib.crc32(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))), default=0)
        if family not in seen[toxic]:
            seen[toxic].add(family)
            n[toxic] += 1
            counts[toxic].update(set(words))
    share = n[1] / max(1, sum(n))

    def evidence(word):
        a, b = counts[1][word], counts[0][word]
        part = a / (a + b)
        return a * math.log(part / share) + (b * math.log((1 - part) / (1 - share)) if b else 0) if part > share else 0

    telling = {w: e for w in counts[1] if (e := evidence(w)) >= EVIDENCE} if 0 < share < 1 else {}
    telling = sorted(telling, key=lambda w: (telling[w], w))[-TOXIC_WORDS:]
    common, taken = counts[0] + counts[1], set(telling)
    ordinary = sorted((w for w in common if w not in taken), key=lambda w: (common[w], w))[-ORDINARY_WORDS:]
    base = b" %b " % b" ".join(ordinary)
    return base, base + b"".join(w + b" " for w in telling)


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float]):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.sizes, self.weights = [], np.array(weights)
        for content in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            self.sizes.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress)

    def features(self, text: bytes) -> list[float]:
        ordinary, toxic = self.sizes
        pieces = windows(text)
        gains = sorted([len(ordinary(w)) - len(toxic(w)) for w in pieces], reverse=True)[:BEST]
        gains = [min(max(g, 0), 30) for g in gains] + [0] * (BEST - len(gains))
        return [1.0, *gains, math.log1p(len(pieces))]

    def __call__(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-float(np.clip(np.dot(self.weights, self.features(text)), -30, 30))))


def logistic(rows: np.ndarray, labels: np.ndarray, importance: np.ndarray, ridge: float = 1.0) -> list[float]:
    weights = np.zeros(rows.shape[1])
    keep = ridge * np.eye(rows.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (importance * (labels - p)) - keep @ weights
        curve = (rows * (importance * p * (1 - p))[:, None]).T @ rows + keep
        weights = weights + np.linalg.solve(curve, slope)
    return weights.tolist()


def fit_texts(texts: list[tuple[bytes, int]], balance: tuple[float, float] = (1.0, 1.0)) -> dict:
    """Dictionaries from three of four texts, the curve from the fourth; ``balance`` weighs a class."""
    texts = sorted(texts, key=lambda t: (zlib.crc32(t[0]), t))
    ordinary, toxic = dictionaries([t for i, t in enumerate(texts) if i % 4])
    apart = [t for i, t in enumerate(texts) if i % 4 == 0]
    labels = np.array([x for _, x in apart])
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of toxic labels is the score
        share = min(max(sum(x for _, x in texts) / max(1, len(texts)), 1e-6), 1 - 1e-6)
        weights = [math.log(share / (1 - share))] + [0.0] * (BEST + 1)
    else:
        scorer = Scorer(ordinary, toxic, [0.0] * (BEST + 2))
        rows = np.array([scorer.features(t) for t, _ in apart])
        weights = logistic(rows, labels, np.where(labels == 1, balance[1], balance[0]))
    return {"ordinary": ordinary, "toxic": toxic, "weights": weights}


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model, from a bounded sample of labelled rows that are not held out.

    A document with several labels is toxic if one says so.  The sample is the rows of least
    hash of each class (bounds above); it is read by one task, and only the model (under 1 MB)
    comes to the driver.  Labels of both classes are weighed to their shares in all labels.
    """
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
             for c, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the two limits
    balance = tuple(max(1, total.get(c, 0)) / max(1, min(total.get(c, 0), n)) for c, n in ((0, ORDINARY_ROWS), (1, TOXIC_ROWS)))

    def train(batches):
        texts = [(text, toxic) for b in batches for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = fit_texts(texts[:2 * (TOXIC_ROWS + ORDINARY_ROWS)], balance)
        yield pa.RecordBatch.from_arrays([pa.array([model["ordinary"]]), pa.array([model["toxic"]]), pa.array([json.dumps(model["weights"])])],
                                         ["ordinary", "toxic", "weights"])

    sample = (docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(picked, "doc_id")
              .select(text_bytes("text").alias("text"), "toxic").repartition(1))
    row = sample.mapInArrow(train, "ordinary binary, toxic binary, weights string").first()
    if row is None:  # no labelled row, so no task to fit anything
        return fit_texts([])
    return {"ordinary": bytes(row["ordinary"]), "toxic": bytes(row["toxic"]), "weights": json.loads(row["weights"])}


def score(text: str | Column, model: dict) -> Column:
    """Probability that a whole text is toxic; null is the empty text, which has a score too."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model["ordinary"], model["toxic"], model["weights"])
        for batch in batches:
            yield by_slices(scorer, pa.float64(), batch)

    return run(text_bytes(text))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``, repeated or not.

    Labels, lang, source and doc_id take no part in a score; other columns are ignored.  Without
    labelled rows of both classes every text has the same score.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", is_held_out().alias("held_out"), score("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (columns unchanged) that score under the threshold."""
    model = fit(docs, labels)
    return docs.where(score("text", model) < THRESHOLD)
