"""Quality by a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on every text. Votes
are counted over the whole corpus by pattern, of which there are at most
3 ** labellers; expectation-maximisation on these counts estimates how often
each labeller is right. The posterior of a pattern is the label on which a
hashed linear scorer is trained.

Defined cases: a null or empty text gets bad votes for its length and the score
of a text without features beyond those; rows that repeat get equal scores; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import hash_sample, stored, text_or_empty

#: Rows at most that the scorer is trained on, its buckets, its passes, and rows that a pass reads at a time.
TRAINED_ON, BUCKETS, STEPS, PART = 12_000, 1 << 12, 200, 2_000


def votes(text: str = "text") -> dict[str, Column]:
    """Labellers: 1 good, -1 bad, 0 no vote."""
    t = text_or_empty(text)
    n = F.length(t)
    share = lambda pattern: F.try_divide(n - F.length(F.regexp_replace(t, pattern, "")), n)
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    lines = F.split(t, "\n")
    stops = F.regexp_count(F.lower(t), F.lit(r"\b(?:the|and|of|to|in|is|that|der|die|und|das|le|la|les|et|de|que|el|los|en|un)\b"))
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    c = lambda x: F.coalesce(x, F.lit(0.0))
    symbols, letters, stop_share, distinct = c(share(r"[#$%&*|<>{}@~^=+\\\\]")), c(share(r"\p{L}")), c(F.try_divide(stops, words)), c(F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)))
    length = c(F.try_divide(n, words))
    capitals, tokens = c(share(r"\p{Lu}")), F.split(F.lower(t), r"\s+")
    varied = c(F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens)))
    return {
        "symbols": vote(symbols < 0.005, symbols > 0.03),
        "letters": vote(letters > 0.74, letters < 0.65),
        "stops": vote(stop_share > 0.12, stop_share < 0.03),
        "lines": vote(distinct > 0.9, distinct < 0.6),
        "size": vote(words >= 60, words < 12),
        "length": vote((length > 3.5) & (length < 9), (length < 2.5) | (length > 14)),
        "case": vote(capitals < 0.1, capitals > 0.3),
        "varied": vote(varied > 0.4, varied < 0.2),
        "ends": vote(F.rtrim(t).rlike(r"[.!?]$"), ~t.rlike(r"[.!?]")),
    }


def agree(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM: share of good texts, each labeller's chances (good or bad text; votes -1, 0, 1) and the posterior of each pattern."""
    n, k = patterns.shape
    good = 0.7
    chance = np.tile(np.array([[0.1, 0.3, 0.6], [0.6, 0.3, 0.1]]), (k, 1, 1))
    weight = counts / max(1, counts.sum())
    post = np.full(n, good)
    for _ in range(rounds):
        log = np.log([good, 1 - good])[None, :] + np.log(np.stack([chance[j][:, patterns[:, j] + 1] for j in range(k)])).sum(0).T
        post = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
        by = np.stack([post, 1 - post]) * weight
        good = float(np.clip(by[0].sum(), 0.01, 0.99))
        for j in range(k):
            for v in range(3):
                chance[j, :, v] = by[:, patterns[:, j] == v - 1].sum(1) + 1e-4
            chance[j] /= chance[j].sum(1, keepdims=True)
    return good, chance, post


#: Bytes by class: other, letter, digit, space, line end, sign.
_CLASS = np.array([4 if c == 10 else 3 if c <= 32 else 2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 5 for c in range(256)], np.uint8)
#: Features beside the buckets of byte pairs: pairs of classes, lengths of words, distinct lines and words, length, one.
CLASSES, LENGTHS = 6, 16
FEATURES = BUCKETS + CLASSES * CLASSES + LENGTHS + 4


def hashed(text: str) -> np.ndarray:
    """Byte pairs by bucket, pairs of byte classes and lengths of words as roots of shares; shares of distinct lines and words; length."""
    x = np.zeros(FEATURES, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    x[-1] = 1
    if not len(raw):
        return x
    pairs = (raw[:-1].astype(np.uint32) * 31 + raw[1:]) * np.uint32(2654435761) >> np.uint32(20)
    x[:BUCKETS] = np.sqrt(np.bincount(pairs, minlength=BUCKETS)[:BUCKETS] / len(raw))
    kind = _CLASS[raw]
    x[BUCKETS : BUCKETS + CLASSES * CLASSES] = np.sqrt(np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES) / len(raw))
    found = text.split()
    if found:
        sizes = np.minimum(np.fromiter(map(len, found), np.int64, len(found)), LENGTHS - 1)
        x[-4 - LENGTHS : -4] = np.sqrt(np.bincount(sizes, minlength=LENGTHS) / len(found))
        x[-3] = len(set(found)) / len(found)
    lines = text.split("\n")
    x[-4] = len(set(lines)) / len(lines)
    x[-2] = np.log1p(len(raw)) / 10
    return x


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(hashed(text) @ self.weights), -30, 30))))


def label(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the votes, and good (posterior) of every document."""
    cast = stored(docs.select(F.col(key).alias("doc_id"), *[v.cast("int").alias(n) for n, v in votes(text).items()]), "quality-votes")
    names = cast.columns[1:]
    table = cast.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 3 ** labellers rows
    if table.empty:
        return cast.withColumn("good", F.lit(0.0))
    post = agree(table[names].to_numpy(int), table["n"].to_numpy(float))[2]
    known = cast.sparkSession.createDataFrame(table[names].assign(good=post))
    return cast.join(F.broadcast(known), names)


def fit(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = TRAINED_ON) -> Scorer:
    """Logistic scorer on the posteriors of at most ``rows`` documents, fitted in one bounded task.

    Of a doc_id that repeats with other texts the least text counts, with its own votes.
    """
    given = votes("text")
    known = labelled.select(*given, "good").distinct()  # at most 3 ** labellers rows
    keys = hash_sample(docs.select(F.col(key).alias("key")).distinct(), "key", rows)
    same = F.col("d.key").eqNullSafe(F.col("k.key"))
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).alias("d").join(F.broadcast(keys.alias("k")), same).groupBy("d.key").agg(F.min("text").alias("text"))
    sample = texts.select("text", *[v.cast("int").alias(n) for n, v in given.items()]).join(F.broadcast(known), list(given)).select("text", "good")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hashed(t.as_py()).astype(np.float16).tobytes() for t in b.column(0)], pa.binary()), b.column(1)], names=["x", "good"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["good"].to_numpy(np.float32)
        held = pdf.pop("x")
        used = np.zeros(FEATURES, bool)
        for v in held:
            used |= np.frombuffer(v, np.float16) != 0
        # Bounded by ``rows``, widened once, without features that no text has: their weights stay zero. Steps read it in parts.
        x = np.empty((len(held), int(used.sum())), np.float32)
        for i, v in enumerate(held):
            x[i] = np.frombuffer(v, np.float16)[used]
        w = np.zeros(x.shape[1], np.float32)
        m, s = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1):
            g = 1e-5 * w
            for a in range(0, len(y), PART):
                part = x[a : a + PART]
                g += part.T @ (1 / (1 + np.exp(-(part @ w))) - y[a : a + PART]) / len(y)
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(FEATURES)
        weights[used] = w
        return pd.DataFrame({"w": [weights.tolist()]})

    got = sample.mapInArrow(spread, "x binary, good double").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "w array<double>").collect()
    return Scorer(np.asarray(got[0]["w"])) if got else Scorer(np.zeros(FEATURES))


def score(docs: DataFrame, scorer: Scorer, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and quality score of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(key).alias("doc_id"), text_or_empty(text)).mapInArrow(run, f"doc_id {kind}, score double")
