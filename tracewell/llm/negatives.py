"""Hard negatives by threshold joins with an inverted index that leaves out what norms cover.

For an anchor and a positive, hard negatives are the best rows of other labels
whose score lies in a window below the positive's. Each is found by a join on a
threshold: a row's dimensions are indexed only as far as the norm of the rest
could still bring it to the threshold, partial scores are accumulated along the
index, and a pair is left as soon as its partial score and the product of what
remains of both norms stay below. Thresholds begin near the top of the windows
and are lowered until every window is full or its floor is reached, so the
result is exact.

Rows and anchors are dealt into blocks of bounded size; a pair of blocks is one
task's work and hands on only the first few rows of each window.

Defined cases: rows with a null label or vector, or any null component, take no
part; an empty vector or a zero one does; a shorter vector counts as filled with
zeros; repeated keys are rows of their own; a null key counts as the largest
and is null in the result; scores beyond a long saturate; an anchor without a
positive, and a window without a row, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import scratch, stored

ROWS_IN_BLOCK, ANCHORS_IN_BLOCK = 16_384, 4_096
#: Dimensions summed between two looks at the bounds, and anchors looked at together.
STEP, BATCH = 8, 64
#: Thresholds of positives as parts of the largest product of norms, and of negatives as parts of the window from its top.
POSITIVE_LEVELS, WINDOW_LEVELS = (0.6, 0.4, 0.2, 0.0), (0.1, 0.25, 0.5, 1.0)
LAST_ID = (1 << 63) - 1


def _tails(x: np.ndarray) -> np.ndarray:
    """Norms of what remains of each row from each dimension on (rows x dimensions + 1)."""
    squares = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.pad(squares, ((0, 0), (0, 1))))


class Index:
    """Rows of a block, indexed in as many of their dimensions as a score of ``floor`` needs with anchors of at most the norm ``longest``.

    Dimensions stand in falling order of energy. Rows are sorted by the number of
    their indexed dimensions, so the postings of a dimension are a prefix of them.
    """

    def __init__(self, x: np.ndarray, tails: np.ndarray, floor: float, longest: float):
        held = (tails[:, :-1] * longest * (1 + 1e-9) >= floor - 0.5).sum(1)
        self.rows = np.argsort(-held, kind="stable")
        self.held = held[self.rows]
        self.tails = tails[self.rows]
        self.postings = np.where(np.arange(x.shape[1]) < self.held[:, None], x[self.rows], 0.0)

    def pairs(self, q: np.ndarray, q_tails: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and row of every pair that the bounds can't exclude from a score of ``least``."""
        n = int(np.searchsorted(-self.held, 0))  # rows without an indexed dimension can't reach any threshold
        sums, at = np.zeros((len(q), n)), np.arange(n)
        alive = np.ones((len(q), n), bool)
        for begin in range(0, q.shape[1], STEP):
            end = min(begin + STEP, q.shape[1])
            c = int(np.searchsorted(-self.held, -begin))
            sums[:, :c] += q[:, begin:end] @ self.postings[:c, begin:end].T
            upto = np.minimum(self.held[:n], end)
            open_ = q_tails[:, upto] * self.tails[at, upto] * (1 + 1e-9)
            alive = sums + open_ >= least[:, None] - 0.5 - 1e-9 * np.abs(sums)
            if alive.mean() < 0.02:  # few are left: their exact scores cost less than further sums
                break
        a, r = np.nonzero(alive)
        return a, self.rows[r]


class Block:
    """Exact threshold joins of anchors with the rows of a block. Vectors are whole numbers (rows x dimensions, int64)."""

    def __init__(self, x: np.ndarray, q: np.ndarray):
        self.x, self.q = x, q
        order = np.argsort(-(x.astype(float) ** 2).sum(0), kind="stable")
        self.fx, self.fq = x[:, order].astype(float), q[:, order].astype(float)
        self.x_tails, self.q_tails = _tails(self.fx), _tails(self.fq)
        self.fits = self.x_tails[:, 0].max(initial=0) * self.q_tails[:, 0].max(initial=0) < 2.0**62

    def scores(self, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            s = slice(i, i + (1 << 16))
            if self.fits:
                out[s] = np.einsum("ij,ij->i", self.q[a[s]], self.x[r[s]])
            else:
                exact = (self.q[a[s]].astype(object) * self.x[r[s]].astype(object)).sum(1)
                out[s] = [min(max(int(v), -LAST_ID - 1), LAST_ID) for v in exact]
        return out

    def reaching(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of every pair whose score is at least the anchor's threshold."""
        got = [(np.zeros(0, np.int64),) * 3]
        index = Index(self.fx, self.x_tails, least.min(initial=np.inf), self.q_tails[anchors, 0].max(initial=0))
        for i in range(0, len(anchors), BATCH):
            some, t = anchors[i : i + BATCH], least[i : i + BATCH]
            a, r = index.pairs(self.fq[some], self.q_tails[some], t)
            score = self.scores(some[a], r)
            fits = score >= t[a]
            got.append((some[a][fits], r[fits], score[fits]))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True))


def _first(block: Block, levels: list[np.ndarray], top: np.ndarray, group: np.ndarray, k: int, allowed: Callable, order: Callable) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window, rows, scores) with the first ``k`` allowed rows of each window, scores from its last level up to ``top``; ``group`` names a window's anchor."""
    done, out = np.zeros(len(top), bool), []
    for n, least in enumerate(levels):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        anchors, back = np.unique(group[left], return_inverse=True)
        lowest = np.full(len(anchors), np.inf)
        np.minimum.at(lowest, back, least[left])
        a, r, score = block.reaching(anchors, lowest)
        keep = allowed(a, r)
        a, r, score = a[keep], r[keep], score[keep]
        at = np.lexsort((*order(r), -score, a))
        a, r, score = a[at], r[at], score[at]
        for w in left:
            lo, hi = np.searchsorted(a, group[w]), np.searchsorted(a, group[w], side="right")
            inside = (score[lo:hi] <= top[w]) & (score[lo:hi] >= least[w])
            if inside.sum() >= k or n == len(levels) - 1:
                out.append((w, r[lo:hi][inside][:k], score[lo:hi][inside][:k]))
                done[w] = True
    return out


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best_positives(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    rows, asked = pdf[pdf["is_row"]], pdf[~pdf["is_row"]]
    size = int(pdf["v"].map(len).max())
    block = Block(_matrix(rows["v"], size), _matrix(asked["v"], size))
    ids, row, own = rows["id"].to_numpy(), rows["row"].to_numpy(), asked["row"].to_numpy()
    longest = block.q_tails[:, 0] * block.x_tails[:, 0].max(initial=0)
    levels = [s * longest for s in POSITIVE_LEVELS] + [np.full(len(own), -np.inf)]
    got = _first(block, levels, np.full(len(own), np.inf), np.arange(len(own)), k, lambda a, r: row[r] != own[a], lambda r: (row[r], ids[r]))
    parts = [pd.DataFrame({"a_row": own[w], "a_id": asked["id"].to_numpy()[w], "p_row": row[r], "p_id": ids[r], "p_score": s}) for w, r, s in got if len(r)]
    return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a_row", "a_id", "p_row", "p_id", "p_score")})


def _best_negatives(pdf: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    rows, asked = pdf[pdf["is_row"]], pdf[~pdf["is_row"]]
    size = int(pdf["v"].map(len).max())
    block = Block(_matrix(rows["v"], size), _matrix(asked["v"], size))
    ids, row, label, own_label = rows["id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy(), asked["label"].to_numpy()
    windows = [(a, w["p_row"], w["p_id"], w["p_score"]) for a, held in enumerate(asked["windows"]) for w in held]
    group, p_row, p_id, p_score = (np.array(c, np.int64) for c in zip(*windows, strict=True)) if windows else (np.zeros(0, np.int64),) * 4
    floor, top = (np.array([f(int(s)) for s in p_score], float) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
    levels = [top - s * (top - floor) for s in WINDOW_LEVELS[:-1]] + [floor]
    got = _first(block, levels, top, group, k, lambda a, r: label[r] != own_label[a], lambda r: (row[r], ids[r]))
    a_row, a_id = asked["row"].to_numpy(), asked["id"].to_numpy()
    parts = [pd.DataFrame({"a_row": a_row[group[w]], "a_id": a_id[group[w]], "p_row": p_row[w], "p_id": p_id[w], "p_score": p_score[w], "n_row": row[r], "n_id": ids[r], "n_score": s}) for w, r, s in got if len(r)]
    return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a_row", "a_id", "p_row", "p_id", "p_score", "n_row", "n_id", "n_score")})


def _blocks(rows: DataFrame, anchors: DataFrame, by: list[str], n_rows: Column, n_anchors: Column) -> DataFrame:
    """Rows and anchors in one frame, every block of anchors with every block of rows of the same ``by``."""
    own = lambda n, size: F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.ceil(n / size))).cast("int")
    each = lambda n, size: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / size)).cast("int") - 1))
    r = rows.select("id", "row", "label", "v", F.lit(True).alias("is_row"), own(n_rows, ROWS_IN_BLOCK).alias("rb"), each(n_anchors, ANCHORS_IN_BLOCK).alias("ab"))
    extra = [c for c in ("windows",) if c in anchors.columns]
    a = anchors.select("id", "row", "label", "v", F.lit(False).alias("is_row"), own(n_anchors, ANCHORS_IN_BLOCK).alias("ab"), each(n_rows, ROWS_IN_BLOCK).alias("rb"), *extra)
    return r.unionByName(a, allowMissingColumns=True).groupBy(*by, "rb", "ab")


def usable(label: str, vector: str) -> Column:
    c = F.col(vector)
    return F.col(label).isNotNull() & c.isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))


def mine(vectors: DataFrame, is_anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the first ``negatives`` rows of another label in each window.

    ``vector`` holds whole numbers. A window goes from ``low`` to ``high`` hundredths
    of a positive's score; an anchor's positives are its best rows of the same label.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    with scratch(spark):
        id_ = F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID))
        tidy = vectors.filter(usable(label, vector)).select(id_.alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        rows = stored(tidy.withColumn("row", F.monotonically_increasing_id()), "negative-rows")
        sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m"))
        asked = rows.filter("asks")
        sized = rows.join(sizes.filter("m > 0"), "label")
        same = _blocks(sized, sized.filter("asks"), ["label"], F.col("n"), F.col("m"))
        found = same.applyInPandas(lambda pdf: _best_positives(pdf, positives), "a_row long, a_id long, p_row long, p_id long, p_score long")
        nth = F.row_number().over(W.partitionBy("a_row").orderBy(F.col("p_score").desc(), "p_id", "p_row"))
        best = stored(found.withColumn("_n", nth).filter(F.col("_n") <= positives).drop("_n"), "negative-positives")
        windows = best.groupBy(F.col("a_row").alias("row")).agg(F.collect_list(F.struct("p_row", "p_id", "p_score")).alias("windows"))  # at most ``positives`` each
        total = sizes.agg(F.sum("n"), F.sum("m")).first()
        n, m = (F.lit(int(v or 0)) for v in total)
        every = _blocks(rows, asked.join(windows, "row"), [], n, m)
        out = "a_row long, a_id long, p_row long, p_id long, p_score long, n_row long, n_id long, n_score long"
        hard = every.applyInPandas(lambda pdf: _best_negatives(pdf, negatives, low, high), out)
        rank = F.row_number().over(W.partitionBy("a_row", "p_row").orderBy(F.col("n_score").desc(), "n_id", "n_row"))
        named = lambda c: F.nullif(F.col(c), F.lit(LAST_ID)).cast(kind)
        got = hard.withColumn("rank", rank).filter(F.col("rank") <= negatives)
        return stored(got.select(named("a_id").alias("anchor_id"), named("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score")), "negatives", keep=True)
