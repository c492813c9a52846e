"""Near duplicates by BagMinHash signatures of word-shingle multisets.

Each shingle of a text with weight w (how often it occurs) stands for a Poisson
process over time, the weights 0..w and the places of the signature. The
weights are cut into dyadic intervals, each with a process of its own, so that
texts with different weights share points where the weights overlap. Points come
in rising time and stop at the largest time the signature still holds. Two
signatures agree in a place with the weighted Jaccard similarity as probability.

Signatures are banded; texts that share a band are candidates, and candidates
are verified by the overlap of their multisets. Texts with equal multisets are
one class from the start. In a bucket of up to ``PAIRWISE`` texts all pairs are
compared. In a larger one every text is compared with the text that shares most
buckets with others; large buckets that then still hold texts of several
components go through an exact join (:func:`by_differences`) on what their
texts differ in from the majority.

Defined cases: a null or empty text has no words and is a class of its own; a
text of fewer than ``SHINGLE`` words has one shingle; rows that repeat are
copies; whole texts count, however long; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import partitions, portions, scratch, stored, text_or_empty

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Texts in a bucket up to which all its pairs are compared, and texts of the smaller side of two that are; larger ones go by leaders and the exact join.
PAIRWISE = 32
#: Bits of the table by which items that one text alone holds are left out before rows are made of the others.
MARKS = 1 << 24
#: Bytes of text that are sketched together, about.
SKETCHED = 1_000_000

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, p: int) -> np.ndarray:
    out = np.full(n, p, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(number of text, 64-bit shingle hash) of every shingle, from rolling hashes over the bytes of all texts."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_SEPARATORS) for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    letter = data != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    if not begin.size:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(data.astype(_U) * _powers(len(data), _P), dtype=_U)))
    word = _mix((sums[end] - sums[begin]) * _powers(len(data), _P_INV)[begin])
    starts = np.cumsum([1] + [len(r) + 1 for r in raw])
    doc = np.searchsorted(starts, begin, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    have = np.maximum(n - size + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(texts)), have)
    at = first[of] + np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(have)[:-1])), have)
    got = np.zeros(len(of), _U)
    for k in range(size):
        inside = k < n[of]
        got = got * _U(_P) + np.where(inside, word[np.minimum(at + k, len(word) - 1)], _U(k + 1))
    return of, _mix(got)


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, places: int) -> np.ndarray:
    """BagMinHash: least times (docs x places) of weighted items; infinite where a text has no item."""
    times = np.full((docs, places), np.inf)
    flat = times.reshape(-1)
    # Weight intervals [0, 1), [1, 2), [2, 4), ... as far as the weight reaches into them.
    parts = []
    low, level = 0, 0
    while True:
        length = 1 if level < 2 else low
        i = np.flatnonzero(weight > low)
        if not i.size:
            break
        parts.append((doc[i], _mix(item[i] + _U((level * 0xD1B54A32D192ED03) & (2**64 - 1))), np.full(i.size, length), np.minimum(weight[i] - low, length)))
        low, level = low + length, level + 1
    if not parts:
        return times
    d, seed, length, reach = (np.concatenate(c) for c in zip(*parts, strict=True))
    now = np.zeros(len(d))
    step = 0
    while len(d):
        step += 1
        h = _mix(seed + _U((step * _P) & (2**64 - 1)))
        now = now - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (length * places)
        h2 = _mix(h)
        place = ((h2 & _U(0xFFFFFFFF)) % _U(places)).astype(np.int64)
        taken = ((h2 >> _U(32)) % length.astype(_U)).astype(np.int64) < reach
        np.minimum.at(flat, (d * places + place)[taken], now[taken])
        open_ = now < times.max(axis=1)[d]
        if not open_.all():
            d, seed, length, reach, now = d[open_], seed[open_], length[open_], reach[open_], now[open_]
    return times


def sketch(texts: list[str]) -> list[tuple[bytes, list[int], bytes]]:
    """Content key, band keys and multiset of each text; the multiset as sorted 32-bit hashes of (shingle, occurrence)."""
    doc, item = shingles(texts)
    # The text's number and 40 bits of the shingle in one integer sort fast; texts come in batches below 2**24.
    both = np.sort((doc.astype(_U) << _U(40)) | (item >> _U(24)))
    new = np.concatenate(([True], both[1:] != both[:-1])) if both.size else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(both)))
    of, what = (both[first] >> _U(40)).astype(np.int64), both[first] & _U((1 << 40) - 1)
    times = signatures(of, what, count, len(texts), BANDS * ROWS)
    rows = times.astype(np.float32).view(np.uint32).reshape(len(texts), BANDS, ROWS).astype(_U)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=_U), (len(texts), 1))
    for r in range(ROWS):
        keys = _mix(keys * _U(_P) + rows[:, :, r])
    nth = np.arange(len(both)) - np.repeat(first, count)
    ids = (_mix((both & _U((1 << 40) - 1)) * _U(_P) + nth.astype(_U)) >> _U(32)) | (both >> _U(40) << _U(32))
    ids = np.sort(ids)
    ends = np.searchsorted(ids >> _U(32), np.arange(len(texts) + 1, dtype=_U))
    low = (ids & _U(0xFFFFFFFF)).astype("<u4")
    ends40 = np.searchsorted(both >> _U(40), np.arange(len(texts) + 1, dtype=_U))
    out = []
    for i in range(len(texts)):
        some = both[ends40[i] : ends40[i + 1]] & _U((1 << 40) - 1)
        out.append((xxhash.xxh3_128_digest(some.astype("<u8").tobytes()), keys[i].view(np.int64).tolist() if some.size else [], low[ends[i] : ends[i + 1]].tobytes()))
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets of :func:`sketch`."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = np.sort(np.concatenate((x, y)), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(x) + len(y) - same)


def row_mark(key: str = "doc_id", text: str = "text") -> Column:
    """Hash of id and text: equal for rows that agree in both."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), F.lit("\n"), text_or_empty(text))))


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row number, id, mark (hash of id and text), content key, bands and multiset of every row; numbers hold once stored."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 3, SKETCHED):
            k, bands, items = zip(*sketch(b.column(3).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(k, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(items, pa.binary())], names=["id", "name", "mark", "content", "bands", "items"])

    return docs.select(F.monotonically_increasing_id(), F.col(key), row_mark(key, text), text_or_empty(text)).mapInArrow(run, f"id long, name {kind}, mark binary, content binary, bands array<long>, items binary")


def buckets_of(rows: DataFrame) -> DataFrame:
    """(bucket, id, n) of the buckets in ``rows`` (bucket, id) with n > 1 texts; of buckets that hold the same texts, one."""
    held = F.xxhash64("id"), F.xxhash64("id", F.lit(7))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(h).alias(c) for c, h in zip("xy", held, strict=True)]).filter("n > 1")
    chosen = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    return rows.join(chosen.select("bucket", "n"), "bucket")


def alike(sets: list[np.ndarray], least: float, group: np.ndarray | None = None, asks: np.ndarray | None = None, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link what chains of similar sets (sorted, without repeats) link: at most one fewer than there are sets.

    ``group``: what is linked already; ``asks`` and ``asked``: only pairs of one that asks and one that is asked count.
    """
    sizes = np.asarray([len(x) for x in sets])
    every = np.ones(len(sets), bool)
    asks, asked = every if asks is None else asks, every if asked is None else asked
    group, out = np.arange(len(sets)) if group is None else group.copy(), []
    for i in range(1, len(sets)):
        # Sizes alone bound the similarity; what is linked already need not be compared again.
        meets = (asks[:i] & asked[i]) | (asked[:i] & asks[i])
        near = np.flatnonzero(meets & (np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i]) - 1e-9) & (group[:i] != group[i]))
        for j in near.tolist():
            if group[j] == group[i]:
                continue
            at = np.searchsorted(sets[j], sets[i])
            same = int((sets[j][np.minimum(at, sizes[j] - 1)] == sets[i]).sum())
            if same >= least * (sizes[i] + sizes[j] - same) - 1e-9:
                out.append((j, i))
                group[group == group[i]] = group[j]
    return out


def compared(small: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Links (a < b) among the texts of small buckets.

    ``small``: bucket, id, label (equal for texts that are linked already), role
    (bits: 1 is asked, 2 asks). In each bucket all that ask are compared with all
    that are asked, but for those linked already.
    """

    def run(one: pa.Table) -> pa.Table:
        ids, role, label = (one.column(c).to_numpy() for c in ("id", "role", "label"))
        named, first, back = np.unique(ids, return_index=True, return_inverse=True)
        roles = np.zeros(len(named), np.int64)
        np.bitwise_or.at(roles, back, role)
        held = one.column("items")
        links = alike([np.unique(np.frombuffer(held[int(k)].as_py(), "<u4")) for k in first], least, label[first], roles & 2 > 0, roles & 1 > 0)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(named[list(a)], pa.int64()), "b": pa.array(named[list(b)], pa.int64())})

    return small.select("bucket", "id", "label", "role").hint("merge").join(items.select("id", "items"), "id").groupBy("bucket").applyInArrow(run, "a long, b long")


def stars(large: DataFrame) -> DataFrame:
    """Pairs (a < b) of every text of a large bucket with its leader: the text that shares most buckets with others, the smaller id at ties."""
    popular = large.groupBy("id").agg(F.sum("n").alias("p"))
    leaders = large.join(popular, "id").groupBy("bucket").agg(F.min_by("id", F.struct(-F.col("p"), "id")).alias("leader"))
    return large.select("bucket", "id").join(leaders, "bucket").filter(F.col("id") != F.col("leader")).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def unsettled(large: DataFrame, joined: DataFrame) -> DataFrame:
    """(bucket, id) of the texts of large buckets that hold several components; buckets that share texts are one."""
    known = stored(large.join(joined, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")), "near-large")
    open_ = known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("id").alias("first")).filter("x < y").select("bucket", "first")
    chained = stored(known.join(open_, "bucket").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "near-open")
    if chained.isEmpty():
        return chained.select(F.col("a").alias("bucket"), F.col("b").alias("id"))
    return components(chained).select(F.col("label").alias("bucket"), "id")


def _pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Items with their counts, row by row, as a column of lists."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x, _ in rows]))).astype(np.int32)
    flat = [pa.array(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64), pa.int64()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, ["item", "c"]))


def marks(several: DataFrame) -> np.ndarray:
    """Table of ``MARKS`` bits with those of all items in ``several``; items that share a bit with one of them pass too. At most MARKS / 64 rows come to the driver."""
    at = F.col("item").bitwiseAND(MARKS - 1)
    words = several.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(item & 63)))").alias("bits")).toArrow()
    got = np.zeros(MARKS // 64, np.int64)
    got[words["word"].to_numpy()] = words["bits"].to_numpy()
    return got.view(np.uint8)


def _marked(bits: np.ndarray, items: np.ndarray) -> np.ndarray:
    at = items & (MARKS - 1)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _differences(least: float):
    """Functions that find, per (bucket, text), the differences from the majority, and those of them, rarest first, by which a link must show."""
    share = (1 - least) / (1 + least)

    def differ(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, whole, f, less, more = [], [], [], [], []
            for raw, most, lack in zip(*(b.column(k) for k in range(2, 5)), strict=True):
                own = np.unique(np.frombuffer(raw.as_py(), "<u4")).astype(np.int64)
                most, lack = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (most, lack))
                gone = ~np.isin(most, own)
                less.append((most[gone], lack[gone]))
                shared = own[_marked(bits, own)]
                more.append(shared[~np.isin(shared, most)])
                size.append(len(own) - len(most) + 2 * int(gone.sum()))
                whole.append(len(own))
                f.append(size[-1] - share * whole[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(whole, pa.int64()), pa.array(f, pa.float64()), _pairs(less), pa.array(more, pa.list_(pa.int64()))], names=["bucket", "id", "size", "whole", "f", "gone", "more"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, out, roles = [], [], []
            met = b.column(7)
            for i, (size, whole, f, lowest, largest) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 7)), strict=True)):
                far = f + lowest > 1e-9
                # As the partner with the smaller f: the other one is far, and not below this one.
                asked = max(f, (f - lowest) / 2)
                # As the one with the larger f: the other one has no more differences in common than it has at all.
                asks = (f + max(lowest, f - 2 * share * min(largest, whole / least))) / 2
                item, count = (met[i].values.field(k).to_numpy(zero_copy_only=False) for k in ("item", "c"))
                # Differences that no other text has come first in the order of rarity; they need not be posted.
                alone = size - len(item)
                short, long = (max(0, size - max(1, int(np.ceil(need - 1e-6))) + 1 - alone) for need in (asked, asks))
                long = long if far else 0
                first = item[np.lexsort((item, count))[: max(short, long)]]
                which.append(np.full(len(first), i))
                out.append(first)
                roles.append((np.arange(len(first)) < short) + 2 * (np.arange(len(first)) < long))
            which, out, roles = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (which, out, roles))
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out, pa.int64()), pa.array(roles.astype(np.int32))], names=["bucket", "id", "item", "role"])

    return differ, post


def _summed(bucket: np.ndarray, item: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, item) with the sums of their counts."""
    order = np.lexsort((item, bucket))
    bucket, item, c = bucket[order], item[order], c[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), (bucket[1:] != bucket[:-1]) | (item[1:] != item[:-1]))))
    return bucket[first], item[first], np.add.reduceat(c, first) if len(first) else c


def tallied(held: DataFrame) -> DataFrame:
    """(bucket, item, c) of the items that c > 1 texts of a bucket hold, from ``held`` (bucket, raw).

    Counts of some millions of items at a time go as arrays, one for each part of
    the hashes of (bucket, item), and are added up part by part; so an item that
    one text holds alone makes no row.
    """
    parts = partitions(held.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            keys = np.repeat(np.asarray(buckets, np.int64), [len(x) for x in sets]), np.concatenate(sets)
            bucket, item, c = _summed(*keys, np.ones(len(keys[0]), np.int64))
            part = (_mix(bucket.view(_U) * _U(_P) + item.astype(_U)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            there, at = np.unique(part[order], return_index=True)
            cut = [[x.tobytes() for x in np.split(col[order].astype(kind), at[1:])] for col, kind in ((bucket, "<i8"), (item, "<u4"), (c, "<i8"))]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), *(pa.array(x, pa.binary()) for x in cut)], names=["part", "buckets", "items", "cs"])

        buckets, sets, n = [], [], 0
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                buckets.append(bucket)
                sets.append(np.unique(np.frombuffer(raw.as_py(), "<u4")))
                n += len(sets[-1])
                if n >= 4_000_000:
                    yield counted()
                    buckets, sets, n = [], [], 0
        if n:
            yield counted()

    def add(one: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(one.column(k).to_pylist()), kind) for k, kind in (("buckets", "<i8"), ("items", "<u4"), ("cs", "<i8"))]
        bucket, item, c = _summed(*columns)
        return pa.table({"bucket": bucket[c > 1], "item": item[c > 1].astype(np.int64), "c": c[c > 1]})

    return held.select("bucket", "raw").mapInArrow(count, "part long, buckets binary, items binary, cs binary").groupBy("part").applyInArrow(add, "bucket long, item long, c long")


def by_differences(members: DataFrame, items: DataFrame, labels: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Links (a < b) that, beside ``labels`` (id, label: what is linked already), join all texts of a bucket (bucket, id) that chains of similar ones of it join: an exact way.

    M is what more than half of a bucket's texts hold, D(x) where x differs from
    M. Similar texts differ in at most r (|x| + |y|), r = (1 - least) / (1 + least),
    so with f(x) = |D(x)| - r |x| they share (f(x) + f(y)) / 2 differences or more.
    z is the text of the least f. Where f(x) + f(z) is not above zero, x is similar
    to z, and that pair stands for those of such texts; the others are far. All
    further links have a far text, which asks, and one of no larger f, which is
    asked. In the order of rarity, a text that is asked posts as many differences as
    leave fewer than max(f, (f - f(z)) / 2), and one that asks as many as leave
    fewer than its own bound with the least f that a partner can have; so both post
    one that they share. Where few ask or few are asked, they are compared;
    otherwise the texts with a common difference are a bucket of the next round. As
    at most half of the texts have it, rounds end.
    """
    differ, post = _differences(least)
    sets = items.select("id", F.col("items").alias("raw"))
    tasks = partitions(items.sparkSession)

    found: DataFrame | None = None
    rows = stored(buckets_of(members.select("bucket", "id")), "near-join0")
    level = 0
    while True:
        # Dealt anew: few bytes, in few files, stand for much work.
        held = rows.join(sets, "id").repartition(tasks, "id")
        counts = stored(tallied(held).join(rows.select("bucket", "n").distinct(), "bucket"), f"near-counts{level}")
        usual, several = counts.filter(F.col("c") * 2 > F.col("n")), counts.filter(F.col("c") * 2 <= F.col("n")).select("bucket", "item", "c")
        common = stored(usual.groupBy("bucket").agg(F.collect_list(F.struct("item", (F.col("n") - F.col("c")).alias("c"))).alias("m")), f"near-common{level}")
        none = F.array().cast("array<bigint>")
        told = held.join(common, "bucket", "left").select("bucket", "id", "raw", F.coalesce(F.col("m")["item"], none).alias("most"), F.coalesce(F.col("m")["c"], none).alias("lack"))
        bits = marks(several)
        apart = stored(told.mapInArrow(partial(differ, bits=bits), "bucket long, id long, size long, whole long, f double, gone array<struct<item:bigint,c:bigint>>, more array<bigint>"), f"near-apart{level}")
        # Of what texts hold beside the majority, that which several hold: what one alone holds is left out by its bit already, but for few, and those by the join.
        met = apart.select("bucket", "id", "more").repartition(tasks, "id").select("bucket", "id", F.explode("more").alias("item")).join(several, ["bucket", "item"]).groupBy("bucket", "id").agg(F.collect_list(F.struct("item", "c")).alias("met"))
        nearest = apart.groupBy("bucket").agg(F.min("f").alias("lowest"), F.max("whole").alias("largest"), F.min_by("id", F.struct("f", "id")).alias("z"))
        of = apart.join(nearest, "bucket")
        near = of.filter((F.col("f") + F.col("lowest") <= 1e-9) & (F.col("id") != F.col("z"))).select(F.least("id", "z").alias("a"), F.greatest("id", "z").alias("b"))
        found = near if found is None else found.unionByName(near)
        # Of what texts lack of the majority, that which several lack.
        lacked = F.filter("gone", lambda x: x["c"] > 1)
        asking = of.join(met, ["bucket", "id"], "left").select("bucket", "id", "size", "whole", "f", "lowest", "largest", F.concat(F.coalesce("met", F.array().cast("array<struct<item:bigint,c:bigint>>")), lacked).alias("met"))
        posted = asking.mapInArrow(post, "bucket long, id long, item long, role int")
        posted = stored(posted.join(labels, "id", "left").select(F.xxhash64("bucket", "item").alias("bucket"), "id", "role", F.coalesce("label", "id").alias("label")), f"near-posted{level}")
        # A difference whose texts are all linked, or that none asks for, leads no further.
        role = lambda bit: F.count(F.when(F.col("role").bitwiseAND(bit) > 0, 1))
        open_ = posted.groupBy("bucket").agg(role(1).alias("asked"), role(2).alias("asks"), F.min("label").alias("low"), F.max("label").alias("high")).filter("asked > 0 AND asks > 0 AND low < high")
        met = stored(posted.join(open_.select("bucket", "asked", "asks"), "bucket"), f"near-met{level}")
        few = met.filter(F.least("asked", "asks") <= PAIRWISE)
        # The larger side is cut into parts, and the few of the other side go to each of them.
        parts = F.ceil(F.greatest("asked", "asks") / PAIRWISE)
        many = F.when(F.col("asked") > F.col("asks"), 1).otherwise(2)
        cut = few.filter(F.col("role").bitwiseAND(many) > 0).withColumns({"part": F.pmod(F.xxhash64("id"), parts), "role": many})
        whole = few.filter(F.col("role").bitwiseAND(3 - many) > 0).withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "role": 3 - many})
        cells = cut.unionByName(whole).withColumn("bucket", F.xxhash64("bucket", "part"))
        found = found.unionByName(compared(cells, items, least))
        many_each = met.filter(F.least("asked", "asks") > PAIRWISE)
        if many_each.isEmpty():
            return found
        level += 1
        rows = stored(buckets_of(many_each.select("bucket", "id")), f"near-join{level}")


def verified(pairs: DataFrame, items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs whose multisets are similar enough, with their similarity."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [similarity(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, similarity double").filter(F.col("similarity") >= least)


def components(links: DataFrame) -> DataFrame:
    """id and the least id of its connected component, of all ids in ``links`` (a, b).

    Every id takes the least label among its neighbours, then the label of its
    label; rounds go on until none changes.
    """
    ways = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-links")
    labels = stored(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "near-labels")
    while True:
        heard = ways.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("label").alias("before"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = stored(nearer.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "near-labels")
        if labels.filter(F.col("before") != F.col("label")).isEmpty():
            return labels.select("id", "label")


def grouped(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """name (the id), mark and label (the same for the texts of one group) of every row; ids may be null or repeat."""
    with scratch(docs.sparkSession):
        sketched = stored(sketches(docs, key=key, text=text), "near-sketches")
        worded = F.size("bands") > 0
        # Copies: the least row stands for all texts with its content.
        heads = stored(sketched.filter(worded).groupBy("content").agg(F.min("id").alias("head")), "near-heads")
        banded = sketched.filter(worded).select("id", F.explode("bands").alias("bucket")).join(heads.select(F.col("head").alias("id")).hint("merge"), "id", "left_semi")
        buckets = stored(buckets_of(banded), "near-buckets")
        # Multisets of the texts that share a bucket; no others are read again.
        items = stored(sketched.select("id", "items").join(buckets.select("id").distinct().hint("merge"), "id", "left_semi"), "near-items")
        large = buckets.filter(F.col("n") > PAIRWISE)
        small = buckets.filter(F.col("n") <= PAIRWISE).select("bucket", "id", F.col("id").alias("label"), F.lit(3).alias("role"))
        links = compared(small, items, least).unionByName(verified(stored(stars(large), "near-stars"), items, least).select("a", "b"))
        links = stored(links.distinct(), "near-links")
        joined = components(links)
        open_ = stored(unsettled(large, joined), "near-unsettled")
        if not open_.isEmpty():
            some = stored(items.join(open_.select("id"), "id", "left_semi"), "near-open-items")
            more = stored(by_differences(open_, some, joined, least), "near-more")
            joined = components(links.unionByName(more))
        of_head = heads.join(joined.select(F.col("id").alias("head"), "label"), "head", "left").select("content", F.coalesce("label", "head").alias("label"))
        known = sketched.select("id", "name", "mark", F.when(worded, F.col("content")).alias("content")).join(of_head, "content", "left")
        return stored(known.select("name", "mark", F.coalesce("label", "id").alias("label")), "near-groups", keep=True)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id and class_id (the least doc_id of its group, null only if it has no other) of every document."""
    rows = grouped(docs, key=key, text=text, least=least)
    named = rows.groupBy("label").agg(F.min("name").alias("class_id"))
    return rows.join(named, "label").select(F.col("name").alias("doc_id"), "class_id")
