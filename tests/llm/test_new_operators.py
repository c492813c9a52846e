"""Hard negatives, main text and conversation repair against brute force."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.llm import dialogs, mixing, negatives, neighbours, pagetext, queries

SF = "/root/testdata/sf0.001"

# Hard negatives


def brute_negatives(rows, anchors, positives=5, negatives_=10, low=30, high=90):
    """rows: (vec_id, label, vector) that take part; rows of one id stay apart."""
    last = 1 << 63
    rank = lambda s, i: (-s, last if i is None else i)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  a shorter one counts as filled with zeros
    for a, (aid, al, av) in enumerate(rows):
        if not anchors(aid):
            continue
        scored = [(dot(av, v), i, lab, k) for k, (i, lab, v) in enumerate(rows) if k != a]
        pos = sorted((x for x in scored if x[2] == al), key=lambda x: rank(x[0], x[1]))[:positives]
        for ps, pid, *_ in pos:
            neg = sorted((x for x in scored if x[2] != al and low * ps <= 100 * x[0] <= high * ps), key=lambda x: rank(x[0], x[1]))[:negatives_]
            out += [(aid, pid, r, nid, ps, ns) for r, (ns, nid, *_) in enumerate(neg, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id long, label int, vector array<long>, row string, asks int"


def mined(spark, rows, anchors=lambda c: c % 10 == 0, **more):
    frame = spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in rows], VECTORS)
    return sorted((tuple(r) for r in negatives.mine(frame, anchors(F.col("vec_id")), **more).collect()), key=str)


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties", "norms"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ROWS_IN_BLOCK", 70)
    monkeypatch.setattr(negatives, "ANCHORS_IN_BLOCK", 9)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 20)) * 40
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(13, 20)) * 90, 20, 0) + rng.normal(size=(260, 20)) * 9
    if kind == "ties":
        x = rng.integers(-1, 2, size=(260, 20)).astype(float)
    if kind == "norms":
        x = x * np.exp(rng.normal(size=(260, 1)))
    rows = [(int(i), int(rng.integers(0, 4)) if i % 3 else 0, [int(v) for v in np.floor(r)]) for i, r in enumerate(x)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    fine = [(0, 1, [3, 4]), (1, 1, [3, 3]), (1, 1, [2, 3]), (2, 2, [2, 2]), (2, 2, [2, 2]), (3, 2, []), (4, 2, [1]), (None, 2, [1, 1]), (10, 1, [-5, -5]), (20, 7, [9, 9]), (5, 2, [2, 1, 8])]
    bad = [(6, None, [1, 1]), (7, 2, None), (8, 2, [1, None]), (30, None, [1, 1])]
    assert mined(spark, fine + bad) == brute_negatives(fine, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, []) == []
    big = (1 << 62) + 1
    rows = [(0, 1, [big, 0]), (1, 1, [4, 0]), (2, 2, [2, 5]), (3, 2, [1, 0])]
    top = lambda s: min(s, (1 << 63) - 1)  # noqa: E731  saturates
    got = mined(spark, rows)
    assert {(r[1], r[4]) for r in got} <= {(1, top(4 * big))}


def test_bounds_leave_pairs_out_but_lose_none():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 64)) * 30).astype(np.int64)
    block = negatives.Block(x, x[:20])
    score = x[:20] @ x.T
    least = np.quantile(score, 0.99, axis=1)
    a, r, s = block.reaching(np.arange(20), least)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(score >= least[:, None]), strict=True)}
    assert {(int(i), int(j)) for i, j in zip(a, r, strict=True)} == want and (score[a, r] == s).all()
    index = negatives.Index(block.fx, block.x_tails, float(least.min()), float(block.q_tails[:, 0].max()))
    assert (index.held < 64).mean() > 0.8 and index.held.mean() < 62, "tails are left out of the index"
    looked, _ = index.pairs(block.fq, block.q_tails, least)
    assert len(looked) < 0.5 * score.size


# Main text


def plain_article(html):
    """The article of a generated page: its blocks without tags."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)) if b)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")
def test_main_text_of_every_page(spark):
    want = {r["page_id"]: plain_article(r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = queries.op12_main_text(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


LONG = "Words that make up a sentence of an article, and more of them to fill a line. " * 2
PAGES = {
    "": "",
    "no tags &amp; one\n line": "no tags & one line",
    "<p>short": "short",
    "<article></article><div class='sidebar'>not this</div>": "",
    "<nav>only a menu</nav>": "",
    f"<article><header><h1>T</h1></header><p>{LONG}<aside>aside</aside><div class=ad-slot>buy</div><p>x<footer>by</footer></article><p>{LONG}": f"T\n{LONG.strip()}\nx",
    f"<div id=main-content><h1>T</h1><p>{LONG}</p><p>so.</p></div><div class='cookie-bar'>{LONG}</div><ol class=commentlist><li>{LONG}</ol>": f"T\n{LONG.strip()}\nso.",
    f"<body><p><a href=/>Home</a> <a href=/b>News</a></p><h1>T</h1><p>{LONG}</p><p>so it ends.</p><p><a href=c>more</a></p></body>": f"T\n{LONG.strip()}\nso it ends.",
    f"<form id=aspnet><p>{LONG}</p><p>b</p></form>": f"{LONG.strip()}\nb",
    f"<form><article><p>{LONG}</p><form>sign <input> up</form></article></form>": LONG.strip(),
    f"<main><section class=intro>a</section><div><p>{LONG}</p></div></main><section role=complementary>{LONG}</section>": f"a\n{LONG.strip()}",
    "<article>a<script>if (x < 1) '<!--'</script>b<style>p{}</style><!-- c --> <b>c</b>\t&#65;&eacute;&nbsp;d</article>": "ab c Aé d",
    "<article><p hidden>no</p><p style='display: none'>no</p><p data-x=\"hidden\">yes</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>": "yes\none\ntwo\n1\n2",
    "<article><p>a<script>never closed": "a",
    "<article><p>a<!-- never closed <p>b": "a",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text_of_small_pages(page):
    assert pagetext.main_text(page) == PAGES[page]


def test_main_text_of_odd_rows(spark):
    rows = [(1, "u", None, "t", 3), (1, "u", None, "t", 3), (None, None, "<article>" + "<p>word word</p>" * 50_000, None, None), (2, "v", "<div>" * 20_000 + "deep" + "</section>" * 20_000, "", 0)]
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"], r["text"][:9]) for r in got.collect()) == [(0, 50_000 * 10 - 1, "word word"), (1, 0, ""), (1, 0, ""), (2, 4, "deep")]
    assert pagetext.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_stretches_begin_at_a_surge_and_end_at_a_dive():
    w = np.array([0, 5, 0, 0, 0, 60, 50, 0, 0, 9, 0, 0, 0, 3.0])
    assert pagetext.stretches(w, 80) == [(5, 10)]  # two lines without weight are no dive, three are
    assert pagetext.stretches(w, 2) == [(1, 2), (5, 10), (13, 14)]


# Conversations


def plain_damage(rows):
    """(conv, [rows (turn, role, text) after damage in order])."""
    out = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")):
        held = out[conv]
        spaced = lambda v: " " if v is None else str(v)
        role, text = spaced(role), spaced(text)
        k = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        held += [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """What the contract says of one conversation, the cheapest edits by trying them all with memory."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == n and state in ("", "a") else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if (to := after(state, role[0])) is not None:
                    c, a, r = best(i, to, inserts + 1)
                    found.append((c + 5, "I" + a, (f"{role}:", *r)))
        if i < n:
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for edit, to_role in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (to := after(state, to_role[:1])) is not None:
                        c, a, r = best(i + 1, to, 0)
                        found.append((c + more + (edit == "R"), edit + a, (f"{to_role}:{text}", *r)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    cost, audit, said = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string, pos int, code string"


def repaired(spark, rows):
    got = dialogs.repair(spark.createDataFrame([(*r, 1, "c") for r in rows], TURNS)).collect()
    assert got == [] or got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in got}


def brute_repairs(rows):
    after = plain_damage(rows)
    return {c: plain_repair(after[c]) for c in {r[0] for r in rows}}


def random_turns(rng, convs, n):
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "Why?\n", "And x.  ", "end ", "é."]
    rows = []
    for c in convs:
        for t in range(int(rng.integers(1, n))):
            turn = None if rng.random() < 0.05 else t + int(rng.integers(0, 2))
            rows.append((c, turn, roles[rng.choice(6, p=[0.4, 0.4, 0.08, 0.06, 0.03, 0.03])], f"{t} {texts[rng.integers(0, 10)]}" if rng.random() < 0.6 else texts[rng.integers(0, 10)]))
    return rows


def test_repairs_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = random_turns(rng, [*range(120), None], 12)
    assert repaired(spark, rows) == brute_repairs(rows)
    assert repaired(spark, []) == {}


def test_conversations_of_many_chunks(spark):
    """Chunks of a conversation are searched by themselves and linked: the same path as over the whole."""
    sys.setrecursionlimit(20_000)
    rng = np.random.default_rng(12)
    rows = random_turns(rng, range(6), 220)
    rows += [(7, k, "user", "The same.") for k in range(300)] + [(8, 5, "user", "One place.")] * 200
    assert repaired(spark, rows) == brute_repairs(rows)


def test_a_lost_conversation_stays(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(conv, 0, "user", "Hello.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables here")
def test_repairs_of_the_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r[0]: tuple(r)[1:] for r in queries.op13_dialogs(spark, SF).collect()}
    assert got == brute_repairs(rows)


def test_search_is_the_least_of_the_cheapest():
    """Every code sequence of up to four rows, against the least of all accepted edits."""
    import itertools

    for n in range(4):
        for rows in itertools.product(range(16), repeat=n):
            if n == 3 and hash(rows) % 5:
                continue
            best = None
            todo = [(0, dialogs.START, 0, "", 0)]
            while todo:
                i, place, cost, audit, inserts = todo.pop()
                if best is not None and cost > best[0]:
                    continue
                if i == n and place in (dialogs.START, dialogs.ASSISTANT):
                    best = min(best, (cost, audit)) if best else (cost, audit)
                    continue
                if inserts < 2:
                    todo.append((i, dialogs._follows(place), cost + 5, audit + "I", inserts + 1))
                if i < n:
                    todo += [(i + 1, to, cost + c, audit + e, 0) for e, c, to, taken in dialogs.STEPS[rows[i]][place] if taken]
            assert dialogs.Search(bytes(rows), dialogs.WHOLE, True).run(dialogs.START)[:2] == best


# Rows of one id, and texts without words, in the earlier operators


def test_neighbours_of_repeated_ids_are_those_of_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).round(2).tolist()
    rows = [(0, x[0]), (0, x[1]), (0, x[0]), (20, x[2]), (20, x[3])] + [(5 if k % 2 else 7, v) for k, v in enumerate(x[4:12])] + [(100 + 20 * k + 1, v) for k, v in enumerate(x[12:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(df, df.filter("vec_id % 20 = 0"), k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    for q in (0, 20):
        want = []
        for a, (i, v) in enumerate(rows):
            if i == q:
                best = sorted((-sum(p * r for p, r in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if b != a)[:5]
                want += [(n, j, round(-s, 9)) for n, (s, j) in enumerate(best, 1)]
        assert sorted(got[q]) == sorted(want)


def test_texts_without_words_are_taken_once(spark):
    rows = [(1, None, "none"), (2, "", "none"), (3, " \n", "some"), (4, "w " * 30, "some"), (5, "w " * 500, "big"), (6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r["key"]: r["times"] for r in mixing.mix(df).collect()}
    assert all(times[k] == 1 for k in (1, 2, 3, 6)) and times[4] == 3
    kept = [r["doc_id"] for r in mixing.repeated(df).collect()]
    assert all(kept.count(k) == 1 for k in (1, 2, 3, 6))
