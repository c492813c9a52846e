"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned from a bounded sample turns each vector into a code of as many
bits as it has dimensions. Codes are cut into substrings, each with an index of
its own. If two codes differ in at most r bits, then some substring differs in
few: a probe looks up every substring value within that distance, which retrieves
every code within the radius r, and the floats rerank them. A query's radius grows
until it holds the bits in which a vector at its k-th score would differ.

Codes measure angles, the order asked for is that of inner products. As q . v =
q . (v - mean) + q . mean, rows are centred and queries are not, and rows are
banded by their norms about the mean, the largest first: the radius in a band
follows from the angle at which its norm reaches the k-th score, and a band whose
norm cannot reach it ends the search.

Rows and queries are dealt into blocks of bounded size; each pair of blocks is
one task's work, and only the nearest few of each query leave it.

Defined cases: vectors that are null, of another length than most, zero, or that
hold null or non-finite components take no part; repeated vec_ids are rows of
their own, as neighbours and as queries; with fewer candidates than asked for, all are returned; an empty
table gives an empty result; a query that its radius leaves with too few
candidates takes the whole block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import hash_sample, stored

#: Vectors at most that the rotation is learned from.
SAMPLE = 8_192
#: Bits of a substring, and the part of all bits (one in so many) with which a query's radius begins.
SUBSTRING, START = 4, 4
#: Standard deviations of the number of differing bits that a radius allows beyond the angle, norm bands to each halving, and bands at most.
SLACK, BANDS_TO_HALF, BANDS = 0.8, 4, 40
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 8_192, 8_192


def usable(embedding: str = "embedding") -> Column:
    c = F.col(embedding)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(F.forall(c, finite), F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation that bring centred vectors near the corners of the cube (iterative quantisation)."""
    mean = x.mean(0)
    z = x - mean
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(z @ r).T @ z)
        r = (u @ v).T
    return mean, r


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Substring values (rows x substrings) of the sign bits."""
    bits = (x - mean) @ rotation > 0
    pad = -bits.shape[1] % SUBSTRING
    bits = np.pad(bits, ((0, 0), (0, pad)))
    return bits.reshape(len(x), -1, SUBSTRING) @ (1 << np.arange(SUBSTRING))


@lru_cache(maxsize=8)
def _balls(radius: int) -> list[np.ndarray]:
    """For each substring value, the values within ``radius`` bits of it."""
    v = np.arange(1 << SUBSTRING)
    apart = np.bitwise_count(v[:, None] ^ v[None, :])
    return [np.flatnonzero(apart[k] <= radius) for k in v]


class MultiIndex:
    """One index for each substring: the rows of each of its values, as bits."""

    def __init__(self, subs: np.ndarray):
        self.rows, self.places = subs.shape
        self.each = np.arange(self.places)
        self.words = self._words(subs)
        of = subs.T[:, None, :] == np.arange(1 << SUBSTRING)[:, None]
        #: By distance, substring and value: the rows within that distance of the value; distances as they are asked for.
        self.near = {0: np.packbits(of, axis=2)}

    @staticmethod
    def _words(subs: np.ndarray) -> np.ndarray:
        """Codes as 64-bit numbers (rows x numbers)."""
        pad = np.pad(subs.astype(np.uint64), ((0, 0), (0, -subs.shape[1] % (64 // SUBSTRING))))
        return np.bitwise_or.reduce(pad.reshape(len(subs), -1, 64 // SUBSTRING) << np.arange(0, 64, SUBSTRING, dtype=np.uint64), axis=2)

    def _within(self, distance: int) -> np.ndarray:
        if distance not in self.near:
            self.near[distance] = np.stack([np.bitwise_or.reduce(self.near[0][:, ball], axis=1) for ball in _balls(distance)], axis=1)
        return self.near[distance]

    def within(self, code: np.ndarray, radius: int, beyond: int = -1) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits, and in more than ``beyond``."""
        # By the pigeonhole principle: within ``each`` bits in one of the first more + 1 substrings, or within each - 1 in another.
        each, more = divmod(radius, self.places)
        some = self.each[: more + 1]
        hit = np.bitwise_or.reduce(self._within(each)[some, code[some]], axis=0)
        if each and more + 1 < self.places:
            some = self.each[more + 1 :]
            hit |= np.bitwise_or.reduce(self._within(each - 1)[some, code[some]], axis=0)
        rows = np.flatnonzero(np.unpackbits(hit, count=self.rows).view(bool))
        apart = np.bitwise_count(self.words.take(rows, axis=0) ^ self._words(code[None])).sum(1, dtype=np.int64) if self.words.shape[1] > 1 else np.bitwise_count(self.words[:, 0].take(rows) ^ self._words(code[None])[0, 0])
        return rows[(apart <= radius) & (apart > beyond) if beyond >= 0 else apart <= radius]


def reaches(score: float, norms: float, bits: int) -> int:
    """Bits in which a code may differ if its vector is to have ``score``, with the slack; below zero if none can."""
    cosine = score / max(norms, 1e-300)
    if cosine > 1 + 1e-9:
        return -1
    share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(bits * share + SLACK * np.sqrt(bits * share * (1 - share))))


def nearest(ids: np.ndarray, x: np.ndarray, names: np.ndarray, y: np.ndarray, learnt: tuple[np.ndarray, np.ndarray], start: int, k: int, numbers: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Rows and scores of the k nearest of each query (names, y) among the rows (ids, x), and how many rows were reranked in all.

    A row that has the query's name is not its neighbour. Names are ids, or where ids repeat ``numbers`` of rows.
    """
    numbers = ids if numbers is None else numbers
    mean, rotation = learnt
    subs, asked_codes = codes(x, mean, rotation), codes(y, 0.0, rotation).astype(np.uint8)
    bits = subs.shape[1] * SUBSTRING
    norm = np.linalg.norm(x - mean, axis=1)
    top_norm = np.linalg.norm(x, axis=1).max()
    with np.errstate(divide="ignore"):
        band = np.clip(np.nan_to_num(-np.log2(norm / max(norm.max(), 1e-300)) * BANDS_TO_HALF, posinf=BANDS), 0, BANDS - 1).astype(int)
    bands = [(norm[at].max(), at, MultiIndex(subs[at])) for at in (np.flatnonzero(band == k) for k in np.unique(band))]
    got, probed = [], 0
    for name, v, code in zip(names, y, asked_codes, strict=True):
        length, shift, least = np.linalg.norm(v), float(v @ mean), -np.inf
        rows, scores, best = [], [], np.zeros(0)
        for top, at, index in bands:  # the largest norms first
            reach, before = start, -1
            if least > -np.inf and (reach := reaches(least - shift, length * top, bits)) < 0:
                break  # neither this band nor one of smaller norms
            while True:
                # A band that is to be probed for more than it holds of a few rows is read whole.
                whole = reach >= bits or len(at) <= k
                # Rows within the radius before are scored already.
                own = at[index.within(code, bits if whole else reach, before)]
                own = own[numbers[own] != name]
                rows.append(own)
                scores.append(x.take(own, axis=0) @ v)
                best = np.concatenate((best, scores[-1]))
                if len(best) >= k:
                    best = np.partition(best, -k)[-k:]
                    least = best[0]
                further = reaches(least - shift, length * top, bits) if least > -np.inf else reach + max(1, bits // 16)
                if whole or further <= reach:
                    break
                reach, before = further, reach
        own, score = np.concatenate(rows), np.concatenate(scores)
        if len(own) < k:
            own = np.flatnonzero(numbers != name)
            score = x[own] @ v
        probed += len(own)
        if len(own) > k:  # all that tie with the k-th stay until ids decide; products may differ in their last bits
            own = own[score >= np.partition(score, -k)[-k] - 1e-12 * length * top_norm]
        # Summed row by row, so that equal vectors have equal scores wherever they stand.
        score = (x.take(own, axis=0) * v).sum(1)
        order = np.lexsort((ids[own], -score))[:k]
        got.append((own[order], score[order]))
    return got, probed


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, radius: int | None = None, key: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of the k nearest found of each query among ``vectors``."""
    kind = vectors.schema[key].dataType.simpleString()
    tidy = lambda df: df.filter(usable(embedding)).select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    # Rows are known by their numbers, as ids may repeat; a query is the row that agrees with it in id and vector, one of them where several do.
    rows = stored(tidy(vectors).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    own = rows.groupBy(F.col("id").alias("_id"), F.col("v").alias("_v")).agg(F.min("row").alias("own"))
    met = F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v"))
    asked = stored(tidy(queries).withColumn("row", F.monotonically_increasing_id()).join(own, met, "left").select("id", "v", "row", F.coalesce("own", F.lit(-1).cast("long")).alias("own")), "near-asked")
    # Bounded by ``sample``; of vectors with one id, the least.
    ids_ = hash_sample(rows.select("id").distinct(), "id", sample)
    fit_on = rows.join(F.broadcast(ids_), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").select("v").collect()
    out = f"q_row long, query_id {kind}, vec_id {kind}, score double"
    if not fit_on:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sizes = pd.Series([len(r["v"]) for r in fit_on])
    size = int(sizes.mode()[0])
    learnt = learn_rotation(np.asarray([r["v"] for r in fit_on if len(r["v"]) == size]))
    bits = -(-size // SUBSTRING) * SUBSTRING
    start = radius if radius is not None else bits // START
    rows, asked = (df.filter(F.size("v") == size) for df in (rows, asked))
    row_blocks = max(1, -(-rows.count() // ROWS_IN_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    # Every block of queries meets every block of rows; both are bounded.
    rows = rows.withColumn("own", F.col("row"))
    spread = lambda df, n, own, other, m: df.select("id", "v", "row", "own", F.lit(own == "rb").alias("is_row"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    cells = spread(rows, row_blocks, "rb", "qb", query_blocks).unionByName(spread(asked, query_blocks, "qb", "rb", row_blocks))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r, q = pdf[pdf["is_row"]], pdf[~pdf["is_row"]]
        if r.empty or q.empty:
            return pd.DataFrame({"q_row": [], "query_id": [], "vec_id": [], "score": []}).astype({"q_row": np.int64, "query_id": pdf["id"].dtype, "vec_id": pdf["id"].dtype})
        x, y = np.stack(r["v"].to_numpy()), np.stack(q["v"].to_numpy())
        ids, names = r["id"].to_numpy(), q["id"].to_numpy()
        got, _ = nearest(ids, x, q["own"].to_numpy(), y, learnt, start, k, r["row"].to_numpy())
        rows, score = (np.concatenate(c) for c in zip(*got, strict=True))
        each = [len(r) for r, _ in got]
        return pd.DataFrame({"q_row": np.repeat(q["row"].to_numpy(), each), "query_id": np.repeat(names, each), "vec_id": ids[rows], "score": score})

    found = cells.groupBy("rb", "qb").applyInPandas(meet, out)
    order = W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    return stored(found, "near-vectors").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
