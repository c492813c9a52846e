"""Token-id files written by an adaptive context-mixing range coder.

A file is a table of segments. A segment holds whole documents in order; its ids
are cut into blocks of a fixed length, each coded from a fresh model and with a
checksum of its own, so that a damaged block spoils no other. All blocks of a
segment are coded in step by numpy, one lane for each block.

Every id is predicted by three orders. Order 0 is how often ids occur in the
segment; order 1 is how often they follow the id before; the head of the segment
holds both, and every block starts from them. Order 2 is learnt within the block:
the id that followed the same two ids. Whether that id comes again is coded with
a probability that is mixed in the logistic domain from how reliable order 2 has
been, from order 1 and from order 0, with weights that the block adapts. If it does
not come, order 1 codes the id, or an escape to order 0. All arithmetic is on
integers, so that every machine decodes alike.

Defined cases: a null text is empty and gives the end id alone; documents are
written in ascending order of their key, nulls first, rows that repeat side by
side; an empty table gives no segments; a damaged block raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.tables import new_path, partitions, text_or_empty
from tracewell.llm.tokens import encoder, tokenizer_path

MAGIC, VERSION = b"TWID", 3
#: Ids in a block, and ids from which a segment is closed.
BLOCK, SEGMENT = 1024, 8_000_000
#: Lanes coded together at most; bounds the memory of the models.
LANES = 8192
#: Order 1: ids at most that have followers, how often a follower must come, and the share of its context (one of so many) that it must have.
CONTEXTS, OFTEN, SHARE = 4096, 3, 2048

#: Bits of a probability of order 1 and of a yes or no, and of one of order 0.
_BITS, _BITS0 = 12, 17
_ONE, _ONE0 = 1 << _BITS, 1 << _BITS0
_SLOTS = 9  # bits of the number of slots in the order-2 table of a lane
_U, _I = np.uint64, np.uint32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch (4096 entries, ln(p / (1 - p)) in 1/256) and its inverse squash (by stretch + 2048), both as integers from one rule."""
    x = (np.arange(4096) - 2047.5) / 256
    squash = np.clip(np.floor(4096 / (1 + np.exp(-x)) + 0.5), 1, 4095).astype(np.int64)
    stretch = np.searchsorted(squash, np.arange(4096), "left").clip(0, 4095).astype(np.int64) - 2048
    return stretch, squash


_STRETCH, _SQUASH = _tables()


def _shares(counts: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Whole shares of 2**bits, one at least, of the counts in each group; ``first`` has where groups begin, and what rounding leaves goes to that entry."""
    size = np.diff(np.append(first, len(counts)))
    total = np.repeat(np.add.reduceat(counts, first), size)
    got = 1 + counts * ((1 << bits) - np.repeat(size, size)) // np.maximum(total, 1)
    got[first] += (1 << bits) - np.add.reduceat(got, first)
    return got


class Orders:
    """Orders 0 and 1 of a segment, as the head holds them.

    ``ids``, ``counts``: what occurs, and how often. ``owner``, ``of``, ``follower``,
    ``share``: contexts in rising order, followers of each, and their shares out of
    4096; the first follower of each context stands for the escape.
    """

    def __init__(self, ids: np.ndarray, share0: np.ndarray, owner: np.ndarray, sizes: np.ndarray, follower: np.ndarray, share: np.ndarray):
        self.ids, self.share0, self.owner, self.sizes, self.follower, self.share = ids, share0, owner, sizes, follower, share
        self.size0, self.start0 = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.size0[ids], self.start0[ids] = share0, np.cumsum(share0) - share0
        # Context 0 is that of all ids without one: it always escapes, at no cost.
        self.context = np.zeros(1 << 16, np.int64)
        self.context[owner] = np.arange(1, len(owner) + 1)
        each = np.append(1, sizes).astype(np.int64)
        self.base = np.cumsum(each) - each
        self.symbol = np.append(0, follower).astype(np.uint32)
        self.size = np.append(_ONE, share).astype(np.int64)
        ends = np.cumsum(self.size)
        self.start = (ends - self.size) % _ONE
        of = np.repeat(np.arange(len(each)), each)
        self.escape = np.zeros(len(of), bool)
        self.escape[self.base] = True
        #: What an entry, or an id by order 0, says on the order-2 decision.
        self.stretch = _STRETCH.take(np.minimum(np.where(self.escape, 1, self.size), _ONE - 1))
        self.stretch0 = _STRETCH.take(self.size0 >> (_BITS0 - _BITS + 1))
        self.place = self.start << 14 | self.size << 1 | self.escape  # all three for one look
        # For a search of (context, follower): the escape comes first in its context.
        self.keys = of << 17 | np.where(self.escape, 0, self.symbol.astype(np.int64) + 1)

    @classmethod
    def counted(cls, before: np.ndarray, ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Orders:
        """From the ids of a segment, the id before each, and the distinct pairs in rising order with how often they occur."""
        n = np.bincount(ids, minlength=1 << 16)
        there = np.flatnonzero(n)
        n0 = n[there]
        top = int(np.argmax(n0)) if len(n0) else 0
        share0 = 1 + n0 * (_ONE0 - len(there)) // max(1, len(ids))
        if len(there):
            share0[top] += _ONE0 - share0.sum()
        # The most frequent ids have followers.
        at_start = np.bincount(before, minlength=1 << 16)
        owner = np.sort(np.argsort(-at_start, kind="stable")[:CONTEXTS])
        owner = owner[at_start[owner] >= OFTEN * 2]
        a, b, count = pairs
        known = np.zeros(1 << 16, bool)
        known[owner] = True
        keep = known[a] & (count >= OFTEN) & (count * SHARE >= at_start[a])
        a, b, count = a[keep], b[keep], count[keep]
        owner = np.unique(a)
        # Each context has one more entry, its first: the escape, with all that was not kept.
        kept = np.bincount(a, weights=count, minlength=1 << 16).astype(np.int64)[owner]
        sizes = np.bincount(a, minlength=1 << 16)[owner] + 1
        first = np.cumsum(sizes) - sizes
        follower, counts = np.zeros(len(a) + len(owner), np.int64), np.zeros(len(a) + len(owner), np.int64)
        rest = np.ones(len(follower), bool)
        rest[first] = False
        follower[rest], counts[rest] = b, count
        counts[first] = at_start[owner] - kept
        return cls(there, share0, owner, sizes, follower, _shares(counts, first, _BITS) if len(counts) else counts)

    def find(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entry of each id in its context: that of the escape where it has none."""
        key = context << 17 | ids + 1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys.take(at) == key, at, self.base.take(context))

    def packed(self) -> bytes:
        rising = np.diff(self.follower, prepend=0) & 0xFFFF
        parts = [self.ids, np.diff(self.owner, prepend=0), self.sizes, rising & 255, rising >> 8, self.share & 255, self.share >> 8]
        body = b"".join(x.astype(k).tobytes() for x, k in zip(parts, ("<u2", "<u2", "<u2", "u1", "u1", "u1", "u1"), strict=True))
        body += self.share0.astype("<u4").tobytes()
        return struct.pack("<III", len(self.ids), len(self.owner), len(self.follower)) + zlib.compress(body, 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Orders:
        n, m, k = struct.unpack_from("<III", data)
        body, at = zlib.decompress(data[12:]), 0
        got = []
        for count, kind in ((n, "<u2"), (m, "<u2"), (m, "<u2"), (k, "u1"), (k, "u1"), (k, "u1"), (k, "u1"), (n, "<u4")):
            got.append(np.frombuffer(body, kind, count, at).astype(np.int64))
            at += got[-1].size * np.dtype(kind).itemsize
        ids, owner, sizes, low, high, s_low, s_high, share0 = got
        return cls(ids, share0, np.cumsum(owner), sizes, np.cumsum(low | high << 8) & 0xFFFF, s_low | s_high << 8)

    def lookups(self) -> tuple[np.ndarray, np.ndarray]:
        """For decoding: entry within its context by (context, value), and id by value of order 0."""
        each = np.diff(np.append(self.base, len(self.size)))
        nth = (np.arange(len(self.size)) - np.repeat(self.base, each)).astype(np.uint16)
        return np.repeat(nth, self.size), np.repeat(self.ids, self.share0).astype(np.uint16)


class _Coder:
    """Range coder for many lanes: 64-bit low and range, 32 bits written at a time, without carries.

    The range is kept at 2**32 or above: a lane below it writes the upper half of
    its low end, after cutting the range at the end of the window if it crosses it.
    """

    def __init__(self, lanes: int, words: int | None = None, data: np.ndarray | None = None):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
        self.at = np.zeros(lanes, np.int64)
        self.out = np.zeros((lanes, words), np.uint32) if data is None else data
        self.flat, self.words = self.out.reshape(-1), self.out.shape[1]
        self.code = None
        if data is not None:
            self.code = (data[:, 0].astype(_U) << _U(32)) | data[:, 1]
            self.at += 2

    def _move(self, m: np.ndarray) -> None:
        """Lanes m write, or read, 32 bits."""
        low, span = self.low.take(m), self.range.take(m)
        crosses = ((low ^ (low + span)) >> _U(32)) != 0
        span = np.where(crosses, (~low + _U(1)) & _U(0xFFFFFFFF), span)
        at = self.at.take(m)
        where = m * self.words + at
        if self.code is None:
            self.flat[where] = low >> _U(32)
        else:
            self.code[m] = (self.code.take(m) << _U(32)) | self.flat.take(where, mode="clip")  # a damaged block may read on
        self.at[m] = at + 1
        self.low[m], self.range[m] = low << _U(32), span << _U(32)

    def all(self, n: int, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """The first n lanes take the part [start, start + size) of their ranges; unit is one step of it."""
        self.low[:n] += unit * start.view(_U)
        span = self.range[:n]
        np.multiply(unit, size.view(_U), out=span)
        m = np.flatnonzero(span < _U(1 << 32))
        if m.size:
            self._move(m)

    def some(self, i: np.ndarray, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """The same for lanes i."""
        self.low[i] = self.low.take(i) + unit * start.view(_U)
        span = unit * size.view(_U)
        self.range[i] = span
        m = i[span < _U(1 << 32)]
        if m.size:
            self._move(m)

    def value(self, i: np.ndarray, unit: np.ndarray, most: int) -> np.ndarray:
        """Where in the ranges of lanes i, in steps of unit, the code stands."""
        return np.minimum((self.code.take(i) - self.low.take(i)) // unit, _U(most - 1)).view(np.int64)

    def flush(self) -> None:
        lanes = np.arange(len(self.low))
        for _ in range(2):
            self.out[lanes, self.at] = (self.low >> _U(32)).astype(np.uint32)
            self.low <<= _U(32)
            self.at += 1


def _run(coder: _Coder, lengths: np.ndarray, orders: Orders, ids: np.ndarray | None, entry: np.ndarray | None) -> np.ndarray:
    """Codes ids (steps x lanes; ``entry``: of order 1), or decodes and returns them if ids is None. Lanes are in falling order of length."""
    lanes, steps = len(lengths), int(lengths[0])
    got = np.zeros((steps, lanes), np.uint16) if ids is None else ids
    if ids is None:
        inside, by_value = orders.lookups()
    # Order 2: tag of the two ids (8 bits), how often in a row it held (8), the id that followed (16); and the entry of order 1 that the id had there.
    table, known = np.zeros(lanes << _SLOTS, np.uint32), np.zeros(lanes << _SLOTS, np.int32)
    stretched = np.zeros((3, lanes), np.int64)
    hit = np.full(lanes * 8, _ONE // 2, np.int64)  # how often a guess held, by its record
    weight = np.tile(np.array([[1 << 16], [1 << 15], [0]]), lanes)
    offset = np.arange(lanes, dtype=np.uint32) << _I(_SLOTS)
    b1, b2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # lanes longer than t
    for t in range(steps):
        n = int(active[t])
        c1, c2 = b1[:n], b2[:n]
        h = c1 * _I(0x9E3779B1) + c2 * _I(0x85EBCA6B)
        slot = offset[:n] + (h >> _I(32 - _SLOTS))
        tag = (h & _I(0xFF00)) << _I(16) | _I(0x10000)
        e = table.take(slot)
        true = None if ids is None else ids[t, :n].astype(np.uint32)
        value = np.zeros(n, np.uint32) if true is None else true
        done = None
        i = np.flatnonzero(((e ^ tag) < _I(1 << 24)) & (e > 0))
        if i.size:
            own = e.take(i).astype(np.int64)
            guess, record = own & 0xFFFF, i << 3 | (own >> 16 & 7)
            of1 = known.take(slot.take(i))
            was = hit.take(record)
            x = stretched[:, : i.size]
            x[0], x[1], x[2] = _STRETCH.take(was), orders.stretch.take(of1), orders.stretch0.take(guess)
            w = weight.take(i, axis=1)
            wx = w * x
            p = _SQUASH.take(np.minimum(np.maximum((wx[0] + wx[1] + wx[2]) >> 16, -2047), 2047) + 2048)
            unit = coder.range.take(i) >> _U(_BITS)
            bit = coder.value(i, unit, _ONE) < p if true is None else true.take(i) == guess
            coder.some(i, np.where(bit, 0, p), np.where(bit, p, _ONE - p), unit)
            goal = bit * (_ONE - 1)
            hit[record] = was + ((goal - was) >> 4)
            weight[:, i] = np.minimum(np.maximum(w + ((x * (goal - p)) >> 10), -(1 << 18)), 1 << 18)
            done = i[bit]
            if true is None:
                value[done] = guess[bit]
        # Order 1, with an escape. Lanes that are done take their whole range.
        unit = coder.range[:n] >> _U(_BITS)
        if true is None:
            at = orders.context.take(c1)
            v = np.minimum((coder.code[:n] - coder.low[:n]) // unit, _U(_ONE - 1)).view(np.int64)
            at = orders.base.take(at) + inside.take((at << _BITS) + v)
        else:
            at = entry[t, :n]
        known[slot] = at
        if done is not None and done.size:
            known[slot.take(done)] = of1[bit]
        place = orders.place.take(at)
        start, size, escape = place >> 14, place >> 1 & 8191, place & 1
        if done is not None and done.size:
            start[done], size[done], escape[done] = 0, _ONE, 0
            if true is None:
                keep = value.take(done)
                value = orders.symbol.take(at)
                value[done] = keep
        elif true is None:
            value = orders.symbol.take(at)
        coder.all(n, start, size, unit)
        i = np.flatnonzero(escape)
        if i.size:
            unit = coder.range.take(i) >> _U(_BITS0)
            if true is None:
                value[i] = by_value.take(coder.value(i, unit, _ONE0))
            some = value.take(i)
            coder.some(i, orders.start0.take(some), orders.size0.take(some), unit)
        if true is None:
            got[t, :n] = value
        fresh = tag | value
        held = ((e ^ fresh) & _I(0xFF00FFFF) == 0) & (e > 0)
        table[slot] = np.where(held, np.minimum(e + _I(0x10000), fresh + _I(0x60000)), fresh)
        b2[:n] = c1
        b1[:n] = value
    return got


def _before(ids: np.ndarray) -> np.ndarray:
    """The id before each, 0 at the start of a block."""
    got = np.zeros(len(ids), ids.dtype)
    got[1:] = ids[:-1]
    got[::BLOCK] = 0
    return got


def _together(blocks: int) -> int:
    """Blocks that are coded together: at most ``LANES``, and the same in each group but for the rest."""
    return max(1, -(-blocks // max(1, -(-blocks // LANES))))


def encode_blocks(ids: np.ndarray) -> tuple[Orders, list[bytes]]:
    """Orders of a segment of ids (uint16), and its coded blocks, BLOCK ids in each but the last."""
    before, out = _before(ids), []
    # Pairs and the places where they occur, sorted together as integers.
    placed = np.sort((before.astype(_U) << _U(16) | ids) << _U(32) | np.arange(len(ids), dtype=_U))
    pairs, place = (placed >> _U(32)).astype(np.uint32), placed.astype(np.uint32)
    edge = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    first, second, count = (pairs[edge] >> 16).astype(np.int64), (pairs[edge] & 0xFFFF).astype(np.int64), np.diff(np.append(edge, len(pairs)))
    orders = Orders.counted(before, ids, (first, second, count))
    entries = np.zeros(len(ids), np.int32)
    entries[place] = np.repeat(orders.find(orders.context.take(first), second).astype(np.int32), count)
    del placed, pairs, place
    together = _together(-(-len(ids) // BLOCK))
    for a in range(0, len(ids), BLOCK * together):
        part = ids[a : a + BLOCK * together]
        lanes = -(-len(part) // BLOCK)
        lengths = np.full(lanes, BLOCK)
        lengths[-1] = len(part) - BLOCK * (lanes - 1)
        steps = int(lengths.max())
        own, entry = np.zeros(lanes * BLOCK, np.uint16), np.zeros(lanes * BLOCK, np.int32)
        own[: len(part)] = part
        entry[: len(part)] = entries[a : a + len(part)]
        by_step = lambda x: np.ascontiguousarray(x.reshape(lanes, BLOCK)[:, :steps].T)
        coder = _Coder(lanes, words=2 * steps + 8)
        _run(coder, lengths, orders, by_step(own), by_step(entry))
        coder.flush()
        out += [coder.out[i, : coder.at[i]].astype("<u4").tobytes() for i in range(lanes)]
    return orders, out


def decode_blocks(orders: Orders, blocks: list[bytes], lengths: np.ndarray) -> np.ndarray:
    out = []
    together = _together(len(blocks))
    for a in range(0, len(blocks), together):
        part, sizes = blocks[a : a + together], lengths[a : a + together]
        words = max(len(b) for b in part) // 4 + 4
        data = np.zeros((len(part), words), np.uint32)
        for i, b in enumerate(part):
            data[i, : len(b) // 4] = np.frombuffer(b[: len(b) // 4 * 4], "<u4")
        got = _run(_Coder(len(part), data=data), sizes, orders, None, None)
        out += [got[:n, i] for i, n in enumerate(sizes.tolist())]
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def encode_segment(docs: list[bytes]) -> bytes:
    """A segment of documents given as little-endian 32-bit ids.

    Head: magic, version, block length, numbers of documents and ids, length of the
    orders; then the lengths of the documents, the sizes and checksums of the
    blocks, the orders, a checksum of all this, and the blocks.
    """
    sizes = np.fromiter((len(d) // 4 for d in docs), "<u4", len(docs))
    ids = np.frombuffer(b"".join(docs), "<u4")
    if ids.size and ids.max() > 0xFFFF:
        raise ValueError("ids beyond 65535 don't fit this format")
    orders, blocks = encode_blocks(ids.astype(np.uint16))
    # A checksum runs over the ids of a block and then over its coded bytes.
    sums = np.fromiter((zlib.crc32(b, zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].tobytes())) for k, b in enumerate(blocks)), "<u4", len(blocks))
    held = orders.packed()
    head = struct.pack("<4sHHIQI", MAGIC, VERSION, BLOCK, len(docs), len(ids), len(held)) + sizes.tobytes() + np.fromiter(map(len, blocks), "<u4", len(blocks)).tobytes() + sums.tobytes() + held
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def decode_segment(data: bytes) -> list[np.ndarray]:
    """The documents of a segment as arrays of ids."""
    fixed = struct.calcsize("<4sHHIQI")
    magic, version, block, n_docs, n_ids, n_orders = struct.unpack_from("<4sHHIQI", data)
    if magic != MAGIC or version != VERSION or block != BLOCK:
        raise ValueError("not a segment of this format")
    n_blocks = -(-n_ids // block)
    tables = fixed + 4 * (n_docs + 2 * n_blocks)
    end = tables + n_orders
    if len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("the head of the segment is damaged")
    sizes, lens, sums = np.split(np.frombuffer(data, "<u4", n_docs + 2 * n_blocks, fixed).astype(np.int64), [n_docs, n_docs + n_blocks])
    ends = end + 4 + np.cumsum(lens)
    blocks = [data[b - n : b] for b, n in zip(ends.tolist(), lens.tolist(), strict=True)]
    lengths = np.full(n_blocks, block)
    if n_blocks:
        lengths[-1] = n_ids - block * (n_blocks - 1)
    ids = decode_blocks(Orders.unpacked(data[tables:end]), blocks, lengths)
    wide = ids.astype("<u4")
    for k in range(n_blocks):
        if zlib.crc32(blocks[k], zlib.crc32(wide[k * block : (k + 1) * block].tobytes())) != sums[k]:
            raise ValueError(f"block {k} of the segment is damaged")
    return np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Token-id files at ``path``: rows (part, segment, ids before it in its part, n_ids, keys, data) in ascending order of key."""
    bpe, kind = tokenizer or tokenizer_path(), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(bpe), TaskContext.get().partitionId(), 0
        keys, held, n, before = [], [], 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)), pa.array([encode_segment(held)], pa.binary())], names=["part", "segment", "ids_before", "n_ids", "keys", "data"])

        for b in batches:
            for i, ids in enumerate(enc.many(b.column(1).to_pylist())):
                held.append(ids)
                keys.append(b.column(0).slice(i, 1))
                n += len(held[-1]) // 4
                if n >= SEGMENT:
                    yield close()
                    keys, held, n, before, number = [], [], 0, before + n, number + 1
        if held:
            yield close()

    ordered = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    ordered.mapInArrow(run, f"part int, segment int, ids_before long, n_ids long, keys array<{kind}>, data binary").write.option("compression", "none").parquet(path)


def read(files: DataFrame) -> DataFrame:
    """key, place, start, n_tokens and ids (binary, unsigned 32-bit little-endian) of every document in ``files``."""
    # Ids before each part, of which there are as many as write tasks.
    of_part = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = of_part.select("part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                docs = decode_segment(b.column(2)[row].as_py())
                n = np.fromiter(map(len, docs), np.int64, len(docs))
                start = b.column(0)[row].as_py() + np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
                for a in range(0, len(docs), 512):
                    some = [d.astype("<u4").tobytes() for d in docs[a : a + 512]]
                    yield pa.RecordBatch.from_arrays([b.column(1)[row].values.slice(a, len(some)), pa.array(start[a : a + 512]), pa.array(n[a : a + 512]), pa.array([zlib.crc32(x) for x in some], pa.int64()), pa.array(some, pa.binary())], names=["key", "start", "n_tokens", "ids_crc32", "ids"])

    placed = files.join(F.broadcast(parts), "part").select((F.col("_before") + F.col("ids_before")).alias("first"), "keys", "data")
    return placed.mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def write_and_read(docs: DataFrame, *, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document as read back from files in the shared folder."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, path, tokenizer=tokenizer, key=key, text=text)
    return read(spark.read.parquet(path))
