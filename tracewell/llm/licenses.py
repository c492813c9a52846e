"""License scans with a generalised suffix automaton of licence words.

The automaton holds every template and phrase. A text streams through it word by
word, which gives the matching statistics: at each word the length of the
longest run ending there that occurs in some template, and all places of that run.
Phrases are read off the automaton's states. Long runs are chained where they
follow each other both in the text and in the template, with small gaps in both;
a chain that covers enough of its template, and is mostly the template's words,
is a span. Where spans of several templates overlap, the one that covers most
words stands, so that the words in which licences differ decide between them.

Defined cases: a null or empty text has no words and no labels; a long text is
streamed whole; repeated rows are repeated in the result; other columns are
left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.license_texts import TEMPLATES
from tracewell.llm.tables import text_or_empty

#: Phrase and label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Words of a run that is long enough to chain, words that a gap between two runs may have in the text or in the template,
#: and the share of a template that a span must cover, and of its own words that must be the template's.
LONG_RUN, GAP, COVERED, OWN = 5, 12, 0.6, 0.6

_SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case, and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


class Automaton:
    """Suffix automaton of several word sequences.

    For each state: steps by word, suffix link, longest length; the phrases
    that end there; and, for states of long runs, all places (template, end)
    where its strings occur.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted(templates)
        self.sizes = [len(templates[n].split()) for n in self.names]
        self.phrase_labels = list(phrases.values())
        self.phrase_sizes = [len(p.split()) for p in phrases]
        every = [templates[n] for n in self.names] + list(phrases)
        self.word_ids = {w.encode(): i for i, w in enumerate(sorted({w for t in every for w in t.split()}))}
        here: dict[int, set[tuple[int, int]]] = {}
        for k, t in enumerate(every):
            last = 0
            for i, w in enumerate(t.split()):
                last = self._extend(last, self.word_ids[w.encode()])
                if k < len(self.names):
                    here.setdefault(last, set()).add((k, i + 1))
        # A phrase ends in the state that its own words reach.
        ends_here: list[list[int]] = [[] for _ in self.next]
        for p, text in enumerate(phrases):
            at = 0
            for w in text.split():
                at = self.next[at][self.word_ids[w.encode()]]
            ends_here[at].append(p)
        self.phrases: list[list[int]] = [[] for _ in self.next]
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.phrases[s] = ends_here[s] + (self.phrases[self.link[s]] if s else [])
        # Places of a state also hold for the one that its suffix link leads to.
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if s in here and self.length[self.link[s]] >= LONG_RUN:
                here.setdefault(self.link[s], set()).update(here[s])
        self.places = {s: sorted(at) for s, at in here.items() if self.length[s] >= LONG_RUN}

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        s, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = s
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[s] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return s

    def stream(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matching length) after each word of ``run``."""
        state = size = 0
        nxt, link, length = self.next, self.link, self.length
        for w in run:
            while (to := nxt[state].get(w)) is None and state:
                state = link[state]
                size = length[state]
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            yield state, size

    def scan(self, text: str) -> dict:
        """Words, places of phrases (phrase, first word) and chained spans (template, first word, end word, covered share)."""
        got = words(text)
        ids = list(map(self.word_ids.get, got))
        places, runs, spans = [], {}, []
        # Words outside the templates end every match, so only runs of known words are streamed.
        known = np.fromiter((i is not None for i in ids), bool, len(ids))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        least = min(min(self.phrase_sizes, default=LONG_RUN), LONG_RUN)
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a < least:
                continue
            for i, (state, size) in enumerate(self.stream(ids[a:b]), a):
                for p in self.phrases[state] if size >= least else ():
                    if size >= self.phrase_sizes[p]:
                        places.append((p, i + 1 - self.phrase_sizes[p]))
                if size < LONG_RUN:
                    continue
                for k, end in self.places.get(state, ()):
                    # A run is known by its template and how far the text is ahead of it.
                    run = runs.get((k, i + 1 - end))
                    if run and run[1] >= i + 1 - size:
                        run[1] = i + 1
                    else:
                        if run:
                            spans.append((k, i + 1 - end, *run))
                        runs[k, i + 1 - end] = [i + 1 - size, i + 1]
        spans += [(*of, *run) for of, run in runs.items()]
        return {"n_words": len(got), "places": places, "spans": self._best(self._chain(spans))}

    def _chain(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float, int]]:
        """Runs (template, lead of the text, first, end) to chains (template, first word, end word, covered share, covered words).

        A run follows the one that gives the longest chain among those that end up
        to ``GAP`` words before it, in the text and in the template; where runs
        overlap, the later one counts from where the earlier ends.
        """
        chains = []
        for k in sorted({r[0] for r in runs}):
            mine = sorted((a, b, lead) for t, lead, a, b in runs if t == k)
            best: list[tuple[int, int, int]] = []  # covered words, run before, first word
            low = 0
            ends_upto: list[int] = []
            for n, (a, b, lead) in enumerate(mine):
                covered, before, first = b - a, -1, a
                while low < n and ends_upto[low] < a - GAP:
                    low += 1
                for m in range(low, n):
                    a1, b1, lead1 = mine[m]
                    cut = max(0, b1 - a, (b1 - lead1) - (a - lead))
                    gap_text, gap_template = a - b1, (a - lead) - (b1 - lead1)
                    if cut < b - a and lead1 != lead and gap_text <= GAP and gap_template <= GAP and best[m][0] + b - a - cut > covered:
                        covered, before, first = best[m][0] + b - a - cut, m, best[m][2]
                best.append((covered, before, first))
                ends_upto.append(max(b, ends_upto[-1] if ends_upto else 0))
            used = set()
            for n in sorted(range(len(mine)), key=lambda n: -best[n][0]):
                m, whole = n, []
                while m >= 0 and m not in used:
                    whole.append(m)
                    m = best[m][1]
                if m >= 0 or not whole:
                    continue  # joins a longer chain
                used.update(whole)
                chains.append((k, best[n][2], mine[n][1], best[n][0] / self.sizes[k], best[n][0]))
        return chains

    def _best(self, chains: list[tuple[int, int, int, float, int]]) -> list[tuple[int, int, int, float]]:
        """Of chains that overlap in the text, those that cover most words, the greater share of their template at ties; by place."""
        kept: list[tuple[int, int, int, float]] = []
        for k, a, b, share, words_ in sorted(chains, key=lambda c: (-c[4], -c[3], self.names[c[0]], c[1])):
            at = bisect_left(kept, a, key=lambda c: c[2] - 1)  # the first that ends beyond a
            if words_ >= OWN * (b - a) and (at == len(kept) or kept[at][1] >= b):
                kept.insert(at, (k, a, b, share))
        return kept


@lru_cache(maxsize=4)
def _automaton(phrases: tuple, templates: tuple) -> Automaton:
    return Automaton(dict(phrases), dict(templates))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,first_word:bigint,end_word:bigint,covered:double>>, score double"


def scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence places, labels and covered template spans of every document."""
    kind = docs.schema[key].dataType.simpleString()
    held = tuple((phrases or PHRASES).items()), tuple((templates or TEMPLATES).items())
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(*held)
        for b in batches:
            rows = []
            for t in b.column(1):
                got = auto.scan(t.as_py())
                base = sorted({auto.phrase_labels[p] for p, _ in got["places"]})
                at = [w for _, w in got["places"]]
                spans = [(auto.names[k], s, e, c) for k, s, e, c in got["spans"]]
                more = {n for n, _, _, c in spans if c >= COVERED}
                score = 1.0 if base else max((c for *_, c in spans), default=0.0)
                rows.append((got["n_words"], len(at), min(at, default=None), max(at, default=None), base, sorted({*base, *more}), [dict(zip(("label", "first_word", "end_word", "covered"), s, strict=True)) for s in spans], score))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [span, pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])

    return docs.select(F.col(key).alias("doc_id"), text_or_empty(text)).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
