"""Toxicity by non-negative positive-unlabelled learning.

Positives are the confirmed toxic rows, the unlabelled set is drawn from the
whole corpus. The risk estimator subtracts from the unlabelled risk the share
that positives, at the class prior, contribute to it, and stops that difference
from going below zero. Several numpy classifiers are fitted, each on its own
part of the rows, in Spark tasks; a score is the mean of their margins.

Features are words and the first letters of words, present or not, chosen by
how much more often positives hold them than the corpus does. Neither labels
nor lang, source or doc_id are inputs of a score.

Defined cases: a null text is empty and gets the score of a text without
features; rows that repeat get equal scores; without confirmed positives every
score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewell.llm.tables import hash_sample, scratch, stored, text_or_empty

#: Rows at most that the classifiers are fitted on: confirmed positives, and unlabelled texts.
POSITIVES, UNLABELLED = 12_000, 24_000
#: Classifiers, features at most, and the score from which a text is rejected.
MEMBERS, FEATURES, REJECT = 3, 16_384, 0.7
#: How many times as often as clean texts, by logarithm, toxic ones hold a term; standard errors that a term may need to show it.
LIFT, CERTAIN = 1.6, 4.0
#: Bounds of the class prior, and how much above the share of toxic rows among the labelled ones it is set:
#: a prior below the true share would hold the scores of toxic texts down, one above it is caught by the bound at zero.
PRIOR_BOUNDS, PRIOR_MARGIN = (0.01, 0.5), 1.15
PREFIXES = (4, 5, 6)

#: ASCII letters and all bytes beyond ASCII make words; texts are lower-cased before.
_SEPARATORS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATORS).split())


def features(found: set[bytes]) -> set[bytes]:
    """Words, and the first bytes of longer words marked with an asterisk."""
    return found | {w[:n] + b"*" for w in found for n in PREFIXES if len(w) > n}


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8")) % 3 == 1


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch hold each term, by ``positive``; the empty term counts the texts."""
    for b in batches:
        got = {True: Counter(), False: Counter()}
        for positive, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            got[positive].update(features(words(t.as_py())))
            got[positive][b""] += 1
        for positive, n in got.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array([positive] * len(n), pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["term", "positive", "n"])


def nn_pu(x: np.ndarray, positive: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with the logistic loss."""
    n_p, n_u = positive.sum(), (~positive).sum()
    w, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
    m = v = np.zeros(len(w) + 1)
    xp, xu = x[positive], x[~positive]
    for t in range(1, steps + 1):
        gp, gu = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        # Loss as negative: log(1 + e^z), with gradient sigmoid; as positive: log(1 + e^-z), with gradient sigmoid - 1.
        as_negative = np.logaddexp(0, xu @ w + b).sum() / n_u - prior * np.logaddexp(0, xp @ w + b).sum() / n_p
        up, uu = prior * (gp - 1) / n_p, gu / n_u
        down = -prior * gp / n_p
        coef_p, coef_u = (up + down, uu) if as_negative >= 0 else (-down, -uu)  # a negative difference is walked back
        grad = np.append(coef_p @ xp + coef_u @ xu + decay * w, coef_p.sum() + coef_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Sparse:
    """Rows of features that are present or not, with the operations that :func:`nn_pu` needs."""

    __array_ufunc__ = None  # numpy leaves ``a @ self`` to this class

    def __init__(self, of: np.ndarray, what: np.ndarray, rows: int, columns: int):
        self.of, self.what, self.shape = of, what, (rows, columns)

    def __getitem__(self, chosen: np.ndarray) -> Sparse:
        some = chosen[self.of]
        return Sparse((np.cumsum(chosen) - 1)[self.of[some]], self.what[some], int(chosen.sum()), self.shape[1])

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.what], self.shape[0])

    def __rmatmul__(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.what, c[self.of], self.shape[1])


class Model:
    """Weight of each feature, and the bias."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        # Words that start otherwise have no features.
        self.heads = {f.rstrip(b"*")[: PREFIXES[0]] for f in weights}

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        heads, first, weights = self.heads, PREFIXES[0], self.weights
        held = features({w for w in words(text) if w[:first] in heads})
        z = self.bias + sum(weights[f] for f in sorted(held & weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples: ``positives`` confirmed rows, ``unlabelled`` texts of the corpus, held-out rows excluded.

    The class prior comes from the labelled rows unless it is given.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, key, text, label, prior, positives, unlabelled)


def _fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, prior: float | None, positives: int, unlabelled: int) -> Model:
    if prior is None:
        share = labels.filter(~held_out(key)).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        prior = min(max(share * PRIOR_MARGIN, PRIOR_BOUNDS[0]), PRIOR_BOUNDS[1])
    confirmed = labels.filter((F.col(label) == 1) & ~held_out(key)).select(F.col(key).alias("key")).distinct()
    rows = docs.filter(~held_out(key)).select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    chosen_p = hash_sample(confirmed, "key", positives).withColumn("positive", F.lit(True))
    chosen_u = hash_sample(rows.select("key").distinct(), "key", unlabelled).withColumn("positive", F.lit(False))
    keys = chosen_p.unionByName(chosen_u)  # bounded by the two parameters
    # A key may repeat with other texts; the least of them stands for it.
    sample = stored(rows.join(F.broadcast(keys), "key").groupBy("positive", "key").agg(F.min("text").alias("text")), "toxic-sample")
    if sample.filter("positive").isEmpty():
        return Model({}, 0.0)
    # Terms are counted over all rows that are not held out; the confirmed ones are in the corpus as well.
    marked = rows.join(confirmed.withColumn("_toxic", F.lit(True)), "key", "left").select(F.coalesce("_toxic", F.lit(False)).alias("positive"), "text")
    terms = marked.mapInArrow(_spread, "term binary, positive boolean, n long")
    held = stored(terms.groupBy("term").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("u")).filter("p >= 4 OR term = X''"), "toxic-terms")
    all_rows = held.filter("term = X''").first()  # the empty term stands for the rows themselves
    n_p, n_u = all_rows["p"], all_rows["u"]
    lift = F.log(((F.col("p") + 0.5) / n_p) / ((F.col("u") + 0.5) / n_u))
    # Toxic texts are in the corpus too: with their share s, a term that they hold e**LIFT times as often as the others
    # has this lift, and none has more than log(1 / s). By so low a lift a term has to show that it is not chance.
    least = -float(np.log(prior / PRIOR_MARGIN + (1 - prior / PRIOR_MARGIN) * np.exp(-LIFT)))
    by_chance = F.col("u") * F.lit(n_p / n_u)
    apart = (lift > LIFT) | ((lift > least) & (F.col("p") > by_chance + CERTAIN * F.sqrt(by_chance)))
    strength = F.col("p") / n_p * lift
    vocabulary = [bytes(r["term"]) for r in held.filter(apart & (F.col("p") >= 4) & (F.length("term") > 0)).orderBy(strength.desc(), "term").limit(FEATURES).select("term").collect()]
    index = {t: i for i, t in enumerate(vocabulary)}

    def member(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["positive"].to_numpy(bool)
        if not y.any() or y.all():
            return pd.DataFrame({"weights": [], "bias": []})
        held = [[index[f] for f in features(words(t)) if f in index] for t in pdf["text"]]
        of = np.repeat(np.arange(len(held)), [len(h) for h in held])
        x = Sparse(of, np.asarray([k for h in held for k in h], np.int64), len(held), len(index))
        w, b = nn_pu(x, y, prior)
        return pd.DataFrame({"weights": [w.tolist()], "bias": [b]})

    part = F.pmod(F.xxhash64("key"), F.lit(MEMBERS))
    fitted = sample.groupBy(part.alias("_part")).applyInPandas(member, "weights array<double>, bias double").collect()  # one row for each classifier
    if not fitted:
        return Model({}, 0.0)
    mean = np.mean([r["weights"] for r in fitted], axis=0)
    return Model({t: float(w) for t, w in zip(vocabulary, mean, strict=True) if abs(w) > 1e-3}, float(np.mean([r["bias"] for r in fitted])))


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "toxic_score") -> DataFrame:
    """``docs`` with their score as ``out``, from the text alone; a column of that name gives way to it."""
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([model.score(str(t.as_py() or "")) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
