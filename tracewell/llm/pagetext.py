"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one for each block of the page; what a page marks as
no part of its article (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments of readers) leaves its lines without weight, and what it
marks as its article gives them more. Lengths are summed over sliding windows of
lines. Where the sum surges over a threshold a stretch of text begins, where it
dives to nothing it ends, and the lines between stand.

Defined cases: a null or empty page has an empty text; a page without tags is one
line; tags that are never closed end with what holds them; an unclosed comment or
script takes the rest of the page; a page whose lines are all short has its
threshold lowered until a stretch begins; where a page has no article of its own
and a form or a layout element holds all of its text, that text counts.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a window, characters over which a window surges, and the least part of the longest stretch that another must have where no article is marked.
WINDOW, SURGE, LEAST_PART = 3, 80, 0.2
#: Part of a page's open text that must lie in elements of a level (article 3, main 2, content 1) for the level to decide.
LEVEL_PART = {3: 0.1, 2: 0.2, 1: 0.3}

# Elements by their place in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
PLAIN_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre hr figcaption blockquote address caption legend option summary".split())
CONTAINER = frozenset("article aside body center details dialog div dl fieldset figure footer form header hgroup html main menu nav noscript ol section table tbody tfoot thead ul head title".split())
NEVER = frozenset("script style noscript template head title iframe object svg canvas audio video button select textarea dialog nav footer aside menu".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class, id and role that mark what is no part of an article, whatever it holds; and those of layout, which an article inside overrules.
FIRM_WORDS = frozenset("""ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr notice notices
    alert alerts alertdialog announcement disclaimer popup modal overlay dialog toast comment comments commentlist commentary respond reply replies disqus discussion related recommended recommendations recommendation
    trending teaser teasers share sharing social newsletter subscribe subscription signup login signin search searchbox copyright breadcrumb breadcrumbs pagination pager skip""".split())  # fmt: skip
LAYOUT_WORDS = frozenset("sidebar sidebars sidenav aside rail widget widgets menu menus menubar nav navs navbar navigation topnav subnav toolbar masthead topbar footer footers complementary contentinfo form forms".split())
HEADER_WORDS, OF_ARTICLE = frozenset("header headers head".split()), frozenset("article post entry story content section title".split())
ARTICLE_MARKS = frozenset("articlebody article-body article-content article-text post-content post-body entry-content story-body".split())
CONTENT_MARKS = frozenset("article post story content main-content maincontent page-content entry main".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+)>?|<[!?/][^>]*+>?""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What lines an element's marks exclude: none, those not in an article of their own, all.
OPEN, LAYOUT, FIRM = 0, 1, 2


@lru_cache(maxsize=1 << 15)
def _marks(tag: str, attributes: str) -> tuple[int, int]:
    """(exclusion, level) that an element's attributes give it."""
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return FIRM, 0
    names = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
    whole = {w.lower() for w in names.split()}
    if "hidden" in whole:
        return FIRM, 0
    words = {w for w in re.split(r"[^a-z]+", _CAMEL.sub(" ", names).lower()) if w}
    level = 3 if whole & ARTICLE_MARKS else 2 if found.get("role", "").lower() == "main" else 1 if tag in ("div", "section", "td") and whole & CONTENT_MARKS else 0
    if tag in ("html", "body", "main"):
        return OPEN, level
    if words & FIRM_WORDS or any(w.startswith("comment") for w in words):
        return FIRM, 0
    if words & LAYOUT_WORDS or words & HEADER_WORDS and not words & OF_ARTICLE and not re.fullmatch("h[1-6]", tag):
        return LAYOUT, 0
    return OPEN, level


def lines_of(html: str) -> list[tuple[str, int, int, int, int]]:
    """(text, plain characters, characters in links, exclusion, level) of each line; containers begin and end with an empty one."""
    lines: list[tuple[str, int, int, int, int]] = []
    stack: list[tuple[str, int, int, bool]] = [("", OPEN, 0, False)]  # name, exclusion, level, in a link
    parts: list[str] = []
    open_: Counter[str] = Counter()
    linked, at, of = 0, 0, (FIRM, 0)  # of: the least exclusion and the highest level of a line's parts

    def end_line(gap: bool) -> None:
        nonlocal linked, of
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, max(0, len(text) - linked), linked, *of))
            parts.clear()
            linked, of = 0, (FIRM, 0)
        if gap and lines and lines[-1][0]:
            lines.append(("", 0, 0, OPEN, 0))

    def take(raw: str) -> None:
        nonlocal linked, of
        _, out, level, link = stack[-1]
        if out != FIRM:
            if not raw.isspace():
                of = (min(of[0], out), max(of[1], level))
            parts.append(unescape(raw) if "&" in raw else raw)
            linked += len(" ".join(raw.split())) if link else 0

    def pop(k: int) -> None:
        for name, *_ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    def close(name: str, stop: tuple[str, ...] = ()) -> None:
        if not open_[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                if name in CONTAINER or name in PLAIN_BLOCK:
                    end_line(name in CONTAINER)
                pop(k)
                return
            # An inline end tag doesn't reach out of its block, nor a cell, row or item out of its table or list.
            if stack[k][0] in stop or (name not in CONTAINER and stack[k][0] in CONTAINER):
                return

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            take(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            close(name)
            continue
        block = name in CONTAINER or name in PLAIN_BLOCK
        if block:
            end_line(name in CONTAINER)
            while len(stack) > 1 and stack[-1][0] not in CONTAINER and stack[-1][0] not in PLAIN_BLOCK and stack[-1][1] == stack[-2][1]:
                pop(len(stack) - 1)  # inline elements left open
            if stack[-1][0] == "p":  # blocks end a paragraph
                pop(len(stack) - 1)
            for other in CLOSES.get(name, ()):
                close(other, ("ul", "ol", "table", "dl"))
        elif name == "br":
            parts.append(" ")
        if name in VOID or not block and _CLOSED.search(m[3]):
            continue
        _, out, level, link = stack[-1]
        mark, own = _marks(name, m[3]) if m[3] and (name != "a" or "class" in m[3]) else (OPEN, 0)
        if name in ("article", "main") and mark == OPEN and out == LAYOUT:
            out = OPEN
        own = max(own, 3 if name == "article" else 2 if name == "main" else 0)
        if name in NEVER:
            mark = FIRM
        elif name == "form" or name == "header" and level < 2:
            mark = max(mark, LAYOUT)
        open_[name] += 1
        stack.append((name, max(out, mark), max(level, own), link or name == "a"))
        if name in RAW:
            ends = _RAW_END[name].search(html, at)
            at = ends.start() if ends else len(html)
    if at < len(html):
        take(html[at:])
    end_line(False)
    return lines


def _level(lines: list[tuple], excluded: int) -> int:
    """The highest level that holds its part of the page's open text."""
    total = sum(len(t) for t, _, _, out, _ in lines if out < excluded)
    for level, part in LEVEL_PART.items():
        if (held := sum(len(t) for t, _, _, out, of in lines if out < excluded and of >= level)) and held >= part * total:
            return level
    return 0


def stretches(weights: np.ndarray, surge: float) -> list[tuple[int, int]]:
    """[begin, end) of each stretch: from where the sum over a window of lines exceeds ``surge`` to where it is zero, without lines of no weight at both ends."""
    sums = np.convolve(weights, np.ones(WINDOW))[WINDOW - 1 :]
    out, i, n = [], 0, len(weights)
    over, zero = np.flatnonzero(sums > surge), np.flatnonzero(sums == 0)
    while (k := np.searchsorted(over, i)) < len(over):
        begin = int(over[k])
        z = np.searchsorted(zero, begin)
        i = int(zero[z]) if z < len(zero) else n
        held = np.flatnonzero(weights[begin:i])
        out.append((begin + int(held[0]), begin + int(held[-1]) + 1))
    return out


def main_text(html: str | None) -> str:
    """The lines of the page's article, in page order, joined by line ends."""
    lines = lines_of(html or "")
    for excluded in (LAYOUT, FIRM):
        level = _level(lines, excluded)
        fits = lambda line, e=excluded, v=level: bool(line[0]) and line[3] < e and line[4] >= v
        if level:
            weights = np.array([SURGE + len(line[0]) if fits(line) else 0 for line in lines], float)
        else:
            weights = np.array([max(0, line[1] - line[2]) if fits(line) else 0 for line in lines], float)
        surge, found = float(SURGE), []
        while weights.any() and not (found := stretches(weights, surge)):
            surge = surge / 4 if surge > 1 else 0.0
        if not level and found:
            sums = [weights[a:b].sum() for a, b in found]
            found = [s for s, n in zip(found, sums, strict=True) if n >= LEAST_PART * max(sums)]
        if found:
            return "\n".join(line[0] for a, b in found for line in lines[a:b] if fits(line))
        if any(of >= 2 for *_, of in lines) or html and re.search(r"<(article|main)[\s>]", html, re.I):
            break  # an article that holds nothing
    return ""


def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def main_text_of(html: str) -> Column:
    return F.pandas_udf(_main_text, "string")(F.coalesce(F.col(html).cast("string"), F.lit("")))


def extract(pages: DataFrame, *, html: str = "html", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its length in code points in place of the markup; other columns stay, but ``text`` and ``size`` are replaced."""
    return pages.withColumn(text, main_text_of(html)).withColumn(size, F.char_length(F.col(text)).cast("long")).drop(html)
