"""Token ids of whole texts by a public tokenizer, with a cache of its pieces.

The byte-level BPE splits a text into pieces before it merges, and a piece has
the same ids wherever it stands. Pieces repeat, so each worker keeps the ids of
those it has seen and asks the tokenizer for new ones only. Pieces of up to 16
bytes are looked up together, many texts at a time, in a table of hash places
that holds them as two 64-bit numbers. Texts with characters outside the plain
ranges below go to the tokenizer whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters whose classes (letter, digit, space, other) the pattern below states exactly.
_PLAIN = "\\x00-\\x1b\\x20-\\x7f¡-©«-±´¶-¸»¿-ɏ‐-‧"
_ODD = re.compile(f"[^{_PLAIN}]")
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^\\s0-9{_L}]+|\\s+(?!\\S)|\\s+")


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pieces; what is not here is taken from the generation before, or encoded."""

    def __init__(self, encode, before: dict[str, bytes]):
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        got = self.before.get(piece)
        if got is None:
            got = np.asarray(self.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        self[piece] = got
        return got


#: Texts of other characters than these don't go through the table: all beyond ASCII that is left is a letter of two bytes.
_UNTABLED = re.compile(f"[^\\x01-\\x1b\\x20-\\x7f{_L}]|<\\|")
#: Class of each byte: 0 between texts, 1 letters, 2 digits, 3 others, 4 white space.
_CLASS = np.asarray([0 if c == 0 else 4 if c in b" \t\n\v\f\r" else 2 if 48 <= c <= 57 else 1 if c >= 128 or chr(c).isalpha() else 3 for c in range(256)], np.uint8)
_FIRST = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE, _QUOTE = ord(" "), ord("'")


def borders(data: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as ``_PIECES`` finds them; a zero byte follows each text and is a piece, and one precedes the first."""
    kind = _CLASS[data]
    run = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    end, what = np.append(run[1:], len(data)), kind[run]
    mark = data == 0
    # A space before other characters belongs to them; of more white space, the last character is by itself.
    mark[run[(what != 4) & (data[run - 1] != _SPACE)]] = True
    white = what == 4
    mark[run[white]] = True
    mark[end[white & (data[np.minimum(end, len(data) - 1)] != 0)] - 1] = True
    quote = run[(data[run] == _QUOTE) & (end - run == 1) & (data[run - 1] != _SPACE)]
    if quote.size:
        one, two = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("l")) & (two == ord("l"))) | (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")))
        mark[quote[short | long] + 1] = False
        mark[quote[short] + 2] = True
        mark[quote[long] + 3] = True
    return np.flatnonzero(mark)


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit bytes, the end id included; many(texts) those of each."""

    #: Bytes of text that are looked up together, about.
    TOGETHER = 4_000_000

    def __init__(self, path: str, end_id: int = END_ID, kept_pieces: int = 1_000_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.batch = tokenizer.encode, tokenizer.encode_batch_fast
        # Whether an id begins with a space, which the byte-level alphabet writes so.
        vocabulary = tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[k for t, k in vocabulary.items() if t[0] == "Ġ"]] = True
        self.pieces, self.kept = _Pieces(self.encode, {}), kept_pieces
        self.end = np.asarray([end_id], "<u4").tobytes()
        self.bits = max(8, (2 * kept_pieces).bit_length())
        self._clear()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if "<|" in text or _ODD.search(text):
            return np.asarray(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        if 4 * len(self.pieces) > self.kept:  # bounds a worker's memory; pieces that are met again move to the new generation
            self.pieces = _Pieces(self.encode, dict(self.pieces))
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text))) + self.end

    def many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some, n = [], 0
        for i, t in enumerate(texts):
            if t and _UNTABLED.search(t):
                out[i] = self.ids(t)
                continue
            some.append(i)
            n += len(t or "")
            if n >= self.TOGETHER:
                self._tabled(some, texts, out)
                some, n = [], 0
        if some:
            self._tabled(some, texts, out)
        return out

    def _clear(self) -> None:
        """Entry 0 is the end of a text."""
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.ends, self.flat, self.keys, self.uses = np.ones(1, np.int64), np.frombuffer(self.end, "<u4"), np.zeros((1, 2), np.uint64), np.zeros(1, np.int64)

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of the keys, -1 for those that are not held."""
        at = self._place(low, high)
        got = self.entry[at]
        i = np.flatnonzero((got >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[i]
        while i.size:
            at = (at + 1) & (len(self.entry) - 1)
            got[i] = self.entry[at]
            on = (got[i] >= 0) & ((self.low[at] != low[i]) | (self.high[at] != high[i]))
            i, at = i[on], at[on]
        return got

    def _insert(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that are not held yet, with their entries."""
        at = self._place(keys[:, 0], keys[:, 1])
        while len(entry):
            free = np.flatnonzero(self.entry[at] < 0)
            self.entry[at[free]] = entry[free]
            own = self.entry[at] == entry
            self.low[at[own]], self.high[at[own]] = keys[own].T
            keys, entry, at = keys[~own], entry[~own], (at[~own] + 1) & (len(self.entry) - 1)

    def _encoded(self, pieces: list[bytes], spaced: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Numbers of ids and ids of pieces. The first ``spaced`` begin with a space before other characters: they are encoded as one text, as they are its pieces again."""
        sizes, ids = [], []
        for a in range(0, spaced, 1000):
            some = pieces[a : min(a + 1000, spaced)]
            got = np.asarray(self.batch([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.opens[got])
            if len(first) != len(some):
                raise ValueError("the tokenizer cuts texts in another way")
            sizes.append(np.diff(np.append(first, len(got))))
            ids.append(got)
        for p in pieces[spaced:]:
            ids.append(np.asarray(self.encode(p.decode(), add_special_tokens=False).ids, np.uint32))
            sizes.append(np.asarray([len(ids[-1])]))
        return sizes, ids

    def _added(self, pieces: list[bytes], spaced: int, keys: np.ndarray) -> np.ndarray:
        entry = np.arange(len(self.ends), len(self.ends) + len(pieces))
        sizes, ids = self._encoded(pieces, spaced)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))))
        self.flat = np.concatenate((self.flat, *ids))
        self.keys = np.concatenate((self.keys, keys))
        self.uses = np.concatenate((self.uses, np.zeros(len(pieces), np.int64)))
        return entry

    def _shrink(self) -> None:
        """Bounds a worker's memory: of the pieces of 16 bytes or fewer, the most used half stay."""
        size = np.diff(self.ends, prepend=0)
        keep = np.flatnonzero(self.keys[:, 0])
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.kept // 2]])
        ends, flat, keys, uses = self.ends, self.flat, self.keys[keep], self.uses[keep]
        self._clear()
        ids = flat[np.repeat(ends[keep] - np.cumsum(size[keep]), size[keep]) + np.arange(size[keep].sum())]
        self.ends, self.flat = np.append(1, 1 + np.cumsum(size[keep])), np.append(self.flat, ids)
        self.keys, self.uses = np.concatenate((self.keys, keys)), np.append(0, uses // 2)
        self._insert(keys, np.arange(1, 1 + len(keys), dtype=np.int32))

    def _tabled(self, some: list[int], texts: list[str | None], out: list[bytes]) -> None:
        raw = b"\0" + b"\0".join([(texts[i] or "").encode() for i in some]) + b"\0"
        data = np.frombuffer(raw + bytes(16), np.uint8)
        begin = borders(data[: len(raw)])[1:]
        size = np.diff(np.append(begin, len(raw)))
        eight = np.ndarray((len(raw) + 9,), "<u8", data, 0, (1,))
        low, high = eight[begin] & _FIRST[np.minimum(size, 8)], eight[np.minimum(begin + 8, len(raw) + 8)] & _FIRST[np.clip(size - 8, 0, 8)]
        entry = self._find(low, high)
        ends = data[begin] == 0
        entry[ends] = 0
        large = size > 16
        entry[large] = -1
        missed = np.flatnonzero(entry < 0)
        if missed.size:
            if len(self.ends) > self.kept:
                self._shrink()
                return self._tabled(some, texts, out)
            new: dict[bytes, int] = {}
            names = [raw[b:e] for b, e in zip(begin[missed].tolist(), (begin + size)[missed].tolist(), strict=True)]
            for k, name in enumerate(names):
                if name not in self.long:
                    new.setdefault(name, k)
            if new:
                spaced = {p: k for p, k in new.items() if p[0] == _SPACE and p[-1] not in b" \t\n\v\f\r"}
                new = spaced | {p: k for p, k in new.items() if p not in spaced}
                at = missed[list(new.values())]
                keys = np.stack((low[at], high[at]), 1)
                keys[size[at] > 16] = 0
                added = self._added(list(new), len(spaced), keys)
                held = keys[:, 0] > 0
                self._insert(keys[held], added[held].astype(np.int32))
                named = dict(zip(new, added.tolist(), strict=True))
                self.long.update((k, v) for k, v in named.items() if len(k) > 16)
            else:
                named = {}
            entry[missed] = [named[x] if x in named else self.long[x] for x in names]
        self.uses += np.bincount(entry, minlength=len(self.uses))
        n = np.diff(self.ends, prepend=0)[entry]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.ends[entry] - upto, n) + np.arange(upto[-1])].astype("<u4").tobytes()
        at = 0
        for i, to in zip(some, (4 * upto[ends]).tolist(), strict=True):
            out[i] = ids[at:to]
            at = to


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One for each worker process."""
    return Encoder(path, end_id)
