"""Best-fit packing of documents into sequences of a fixed capacity by bin completion.

Pieces of one length are interchangeable, so the plan is made on the histogram
of lengths, which has at most as many rows as a sequence has tokens whatever the
size of the corpus. Around the largest length left, the search enumerates
undominated fillings, applies the chosen one as often as the counts allow,
prunes branches whose waste bound cannot beat the incumbent, and starts from the
best-fit-decreasing solution. Every piece then finds its place from its rank
among the pieces of its length.

Defined cases: a null text is empty and gives the end id alone; only documents
longer than a sequence are cut, the first piece being the shorter one; rows that
repeat are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import partitions, portions, stored, text_or_empty
from tracewell.llm.tokens import encoder, tokenizer_path

CAPACITY = 1024
#: Nodes that the branch and bound may open; the best solution so far is used then.
NODES = 4_000
#: Longest pieces around which a filling of three is looked for.
TRIOS = 16

Plan = list[tuple[int, tuple[int, ...]]]  # (number of sequences, lengths in each)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit on a histogram: counts[n] pieces of n tokens, largest first."""
    rooms: dict[int, Counter] = {}
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            fits = [r for r, bins in rooms.items() if r >= n and bins]
            if fits:
                room = min(fits)
                filling, there = next(iter(rooms[room].items()))
                each, take = 1, min(left, there)
                rooms[room][filling] -= take
                if not rooms[room][filling]:
                    del rooms[room][filling]
                if not rooms[room]:
                    del rooms[room]
            else:
                room, filling, each = capacity, (), min(capacity // n, left)
                take = left // each
            rooms.setdefault(room - each * n, Counter())[filling + (n,) * each] += take
            left -= take * each
    return [(m, f) for bins in rooms.values() for f, m in bins.items()]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` fit into those of ``a``, each of ``a`` taking none, one or several: then ``a`` can stand for ``b`` in any packing."""

    def fits(rooms: tuple[int, ...], rest: tuple[int, ...]) -> bool:
        if not rest:
            return True
        return any(fits((*rooms[:i], r - rest[0], *rooms[i + 1 :]), rest[1:]) for i, r in enumerate(rooms) if r >= rest[0] and r not in rooms[:i])

    return a != b and sum(a) >= sum(b) and fits(a, tuple(sorted(b, reverse=True)))


def fillings(counts: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with up to three pieces, least waste first, at most ``width`` of them.

    Beside a piece, only the longest that fits counts, as it dominates the shorter
    ones. Candidates are taken by waste, those with fewer and larger pieces first,
    and each is tested against those taken before.
    """
    lengths = np.flatnonzero(counts[: room + 1] > 0)
    if not lengths.size:
        return [()]
    # The longest piece there is that is no longer than each length; 0 for none.
    upto = np.zeros(room + 1, np.int64)
    upto[lengths] = lengths
    upto = np.maximum.accumulate(upto)

    def partner(a: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest piece beside ``a`` that fits what is left and is not longer."""
        b = upto[np.minimum(left, a)]
        twice = (b == a) & (counts[a] < 2)
        return np.where(twice, upto[np.minimum(left, a - 1)], b)

    big = lengths[::-1]
    second = partner(big, room - big)
    found = {(int(big[0]),): int(big[0])}
    sums = big + second
    for i in np.argsort(-sums, kind="stable")[: 4 * width]:
        if second[i]:
            found[int(big[i]), int(second[i])] = int(sums[i])
    if sum(s == room for s in found.values()) < width:
        for x in map(int, big[:TRIOS]):
            b = lengths[lengths <= min(x, room - x)][::-1]
            if b.size:
                third = partner(b, room - x - b)
                i = int(np.argmax(b + third))
                trio = (x, int(b[i]), int(third[i]))
                if trio[2] and all(counts[k] >= v for k, v in Counter(trio).items()):
                    found[trio] = sum(trio)
    taken: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-found[f], len(f), tuple(-x for x in f))):
        if len(taken) == width:
            break
        if not any(dominates(t, f) for t in taken):
            taken.append(f)
    return taken


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: pieces over half a sequence never share one, and what fits beside them is limited by their waste."""
    n, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half, bound = capacity // 2, -(-int(tokens[-1]) // capacity)
    for small in range(1, half + 1):
        alone = int(n[-1] - n[half])
        beside = (int(n[capacity - small] - n[half])) * capacity - int(tokens[capacity - small] - tokens[half])
        bound = max(bound, alone + max(0, -(-(int(tokens[half] - tokens[small - 1]) - beside) // capacity)))
    return bound


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES, width: int = 3) -> Plan:
    """A packing of the histogram ``counts`` into few sequences; always complete, the best that the search met."""
    sizes = np.arange(capacity + 1)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(m for m, _ in best)
    least = least_sequences(counts, capacity)
    stack: list[tuple[np.ndarray, int, int, tuple]] = [(counts.astype(np.int64).copy(), int((counts * sizes).sum()), 0, ())]
    while stack and nodes and fewest > least:
        nodes -= 1
        left, tokens, used, path = stack.pop()
        if used + -(-tokens // capacity) >= fewest:  # waste bound
            continue
        if not tokens:
            fewest, best = used, []
            while path:
                path, step = path
                best.append(step)
            continue
        big = int(np.flatnonzero(left)[-1])
        left[big] -= 1
        options = fillings(left, capacity - big, width)
        left[big] += 1
        for more in reversed(options):
            need = Counter((big, *more))
            times = min(int(left[k]) // v for k, v in need.items())
            after = left.copy()
            for k, v in need.items():
                after[k] -= times * v
            # What one round of three pieces left open, later rounds can't fill: add the largest that still fit.
            filling, room = [big, *more], capacity - big - sum(more)
            while room > 0 and (fit := np.flatnonzero(after[1 : room + 1])).size:
                n = int(fit[-1]) + 1
                if after[n] < times:
                    times_now = int(after[n])
                    for k, v in need.items():
                        after[k] += (times - times_now) * v
                    for k in filling[1 + len(more) :]:
                        after[k] += times - times_now
                    times = times_now
                after[n] -= times
                filling.append(n)
                room -= n
            stack.append((after, tokens - times * sum(filling), used + times, (path, (times, tuple(filling)))))
    return best


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each length and run of ranks: first rank, first sequence, pieces of the length in a sequence, their offset."""
    rows, taken, first = [], Counter(), 0
    for times, filling in plan:
        offset = 0
        for n, k in sorted(Counter(filling).items(), reverse=True):
            rows.append((n, taken[n], first, k, offset))
            taken[n] += times * k
            offset += n * k
        first += times
    rows.sort()
    cols = np.asarray(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), cols, strict=True))


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    path = tokenizer or tokenizer_path()
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in portions(batches, 1):
            which, out = [], []
            for i, ids in enumerate(enc.many(b.column(1).to_pylist())):
                n = len(ids) // 4
                head = n % capacity or capacity if n > capacity else n
                at = 0
                for p, end in enumerate(range(head, n + 1, capacity)):
                    out.append((p, at, end - at, zlib.crc32(ids[at * 4 : end * 4])))
                    which.append(i)
                    at = end
            p, s, n, c = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("doc_id"), text_or_empty(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, *, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``cut`` (rows with doc_id, piece and length) with sequence_id and offset."""
    spark = cut.sparkSession
    # A length may be hot: ranks run within (length, salt), and each salt starts where those before it end.
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(spark))).cast("int")
    salted = cut.withColumn("_salt", salt)
    cells = stored(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-cells")
    counts = np.zeros(capacity + 1, np.int64)
    for n, total in cells.groupBy("length").agg(F.sum("_n")).collect():  # at most one row for each length up to the capacity
        counts[n] = total
    place = slots(bin_completion(counts, capacity, nodes))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = salted.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_from") + F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (place["length"] << 48) | place["rank"]
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (n << 48) | rank, "right") - 1
            inside = rank - place["rank"][at]
            each = place["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(place["sequence"][at] + inside // each), pa.array(place["offset"][at] + inside % each * n)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, "_rank").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, nodes: int = NODES, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole documents as pieces with their places in sequences of ``capacity`` tokens."""
    return pack(stored(pieces(docs, capacity=capacity, tokenizer=tokenizer, key=key, text=text), "pack-pieces"), capacity=capacity, nodes=nodes)
