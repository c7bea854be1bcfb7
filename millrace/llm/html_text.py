"""Main text of a web page by its line-block distribution.

The markup is stripped to lines: each block element or line break starts a new one. A line's
weight is the number of its characters outside links (0 if most are in links). Elements that are no article text by
their kind (menus, footers, asides, forms, dialogs, hidden ones, a page's header, reader
comments, and containers whose class or id names one of these kinds) keep their lines, with
weight 0 and marked: they are gaps in the distribution and never part of the text.

Over the weights a window of WINDOW lines slides. Text begins where the windowed sum surges
to SURGE characters or more (on a page that has less text, half of the largest sum), with the
few lines just before it, and ends at the dive, where the sum falls to nothing. What lies
between a surge and its dive is kept, short lines and links included; all runs are kept, and
so are lines with weight that stand in the same container as a run's lines (adverts between
them may have made a gap).

Where the page names its article (one that holds text, in no other article and in no marked
element; the heaviest if there are several; else a main element), that is where its text is:
each line of it weighs SURGE at least, so the article's short lines surge too. Lines beyond it
are gaps, but for headings of the first level in the main element and for other articles that
are no mere teasers (SURGE characters and the share OWN outside links), which have to surge by
their own weight. Without an article the windows decide alone.

A line's white space becomes single spaces, character references are decoded, and kept lines
are joined by a line feed. Nulls: a null or empty page, or one without text, has an empty
text. Repeated pages each get a row; an empty table gives an empty one; columns of the pages
may have any names (a kept column called text is replaced). Of articles of equal weight the
first counts as the page's own. Long pages are read whole, in time linear in their length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import arrow_map, as_texts

WINDOW = 3
SURGE = 80
LINKS = 0.5  # a line with a larger share of its characters in links has no weight
OWN = 0.8  # share of a second article's characters that are outside links

# HTML element names, roles, and the words by which classes and ids name kinds.
RAW = "script style noscript template textarea title svg iframe select option datalist"
INLINE = "a button abbr acronym b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math meter mfrac mi mn mo mrow ms msqrt mstyle msub msubsup msup mtext munder mover munderover nobr object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr"
KINDS = "nav footer aside form menu dialog fieldset header"
VOID = "area base br col embed hr img input link meta param source track wbr"
CONTAINERS = "div section aside ul ol dl table tbody tr td center details figure header"
ROLES = "navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar"
NAMED = "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond reply replies feedback share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar alert teaser teasers"
WITH = "site page top bottom left right box list section area block wrapper container bar links link user reader readers item items inner outer global primary secondary form post posts message slot unit by for the"
TEXT = "article content entry story main text body note prose post-body post-content"

_RAW, _INLINE, _KINDS, _VOID, _CONTAINERS, _ROLES, _NAMED, _WITH, _TEXT = (frozenset(x.split()) for x in (RAW, INLINE, KINDS, VOID, CONTAINERS, ROLES, NAMED, WITH, TEXT))
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>""", re.DOTALL)
_ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}
_CUTS = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "a"))  # these end one of their own name left open
_BREAKS = frozenset(("br", "hr"))  # of the elements without content
_ROOTS = frozenset(("html", "body", "main"))


@dataclass
class Line:
    text: str
    own: int  # characters outside links
    marked: bool  # in an element that is no article text
    article: int  # number of the article it is in, 0 for none
    main: bool
    title: bool  # a heading of the first level
    parent: int  # number of the innermost container, 0 for none


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)} if raw.strip() else {}


def _names_a_kind(named: str) -> bool:
    """Whether a class or id list names a kind of element that is no article text. A word
    counts only if all its parts do (market-share and with-sidebar name none), and not
    beside one that names text (note notice)."""
    tokens = named.split()
    if any(t.lower() in _TEXT for t in tokens):
        return False
    for token in tokens:
        parts = [p.lower() for p in _PART.findall(token)]
        if any(p in _NAMED for p in parts) and all(p in _NAMED or p in _WITH for p in parts):
            return True
    return False


def _marked(name: str, attributes: dict[str, str], article: bool) -> bool:
    """article: inside of one or of the main element, whose own header may hold the title."""
    if name in _ROOTS:
        return False
    if name in _KINDS and not (name == "header" and article):
        return True
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if name not in _CONTAINERS or (name == "header" and article):
        return False
    return _names_a_kind(attributes.get("class", "")) or _names_a_kind(attributes.get("id", ""))


def lines(page: str) -> list[Line]:
    out: list[Line] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, marks, number of the article it opens, is main
    opened: dict[str, int] = {}
    held: list[str] = []
    links = at = marks = main = anchors = titles = articles = mute = 0
    inside, containers, numbered = [0], [0], 0
    enclosed: set[int] = set()  # depths of marked elements that are known to end later

    def close() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            own = max(0, len(text) - links)
            out.append(Line(text, own if own >= (1 - LINKS) * len(text) else 0, marks > 0, inside[-1], main > 0, titles > 0, containers[-1]))
        held.clear()
        links = 0

    def pop() -> str:
        nonlocal marks, main, anchors, titles, mute
        name, marking, article, is_main = stack.pop()
        enclosed.discard(len(stack))
        mute -= name == "button"
        opened[name] -= 1
        marks -= marking
        main -= is_main
        anchors -= name == "a"
        titles -= name == "h1"
        if article:
            inside.pop()
        if name in _CONTAINERS:
            containers.pop()
        return name

    def put(raw: str) -> None:
        nonlocal links
        if raw and not mute:
            text = html.unescape(raw)
            held.append(text)
            if anchors:
                links += len(" ".join(text.split()))

    def left_open() -> bool:
        """Whether a marked element on the stack has no end of its own in the rest of the page."""
        for depth, (name, marking, *_) in enumerate(stack):
            if marking and depth not in enclosed:
                if len(re.findall(rf"</{name}\b", page[at:], re.IGNORECASE)) <= len(re.findall(rf"<{name}\b", page[at:], re.IGNORECASE)):
                    return True
                enclosed.add(depth)
        return False

    def end_open(name: str) -> None:
        """Ends an element of the name that is open above inline ones only."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] not in _INLINE:
                return

    while (m := _TAG.search(page, at)) is not None:
        put(page[at : m.start()])
        at = m.end()
        ends, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        empty = name in _VOID or raw.rstrip().endswith("/")
        if name in _BREAKS or not (name in _INLINE or name in _RAW or empty):
            close()
        if ends:
            if opened.get(name):
                while pop() != name:
                    pass
            continue
        if empty:
            continue
        if name in _RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page) if name in ("script", "style") else at
            continue
        attributes = _attributes(raw)
        if name in _CUTS:
            end_open(name)
        if name in ("article", "main") and marks and not inside[-1] and left_open():
            while marks:
                pop()
        is_main = name == "main" or attributes.get("role", "").lower() == "main"
        article = name == "article" or "articlebody" in attributes.get("itemprop", "").lower()
        # an article in another one is a reader's comment
        comment = name == "article" and inside[-1] > 0
        marking = name not in _INLINE and not is_main and (comment or _marked(name, attributes, inside[-1] > 0 or main > 0))
        number = 0
        if article and not marking and not marks and not inside[-1]:
            articles += 1
            number = articles
            inside.append(number)
        stack.append((name, marking, number, is_main))
        opened[name] = opened.get(name, 0) + 1
        marks += marking
        main += is_main
        anchors += name == "a"
        titles += name == "h1"
        if name in _CONTAINERS:
            numbered += 1
            containers.append(numbered)
        mute += name == "button"
    put(page[at:])
    close()
    return out


def weights(found: list[Line]) -> tuple[list[int], list[bool]]:
    """What each line adds to the distribution, and whether it may be text."""
    size: dict[int, int] = {}
    own: dict[int, int] = {}
    for x in found:
        if x.article and not x.marked:
            size[x.article] = size.get(x.article, 0) + len(x.text)
            own[x.article] = own.get(x.article, 0) + x.own
    best = min(size, key=lambda k: (-size[k], k)) if size else 0
    more = {k for k in size if own[k] >= SURGE and own[k] >= OWN * size[k]}
    main = not best and any(x.main and not x.marked for x in found)
    out, may = [], []
    for x in found:
        named = (best > 0 and (x.article == best or (x.main and x.title and not x.article))) or (main and x.main)
        free = not x.marked and (named or (x.article in more if best else not main))
        may.append(free)
        out.append((max(SURGE, x.own) if named else x.own) if free else 0)
    return out, may


def runs(weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line of each run: from the surge of the windowed sum, or up to a window's
    lines before it that have weight and stand together with it, to the dive."""
    n = len(weight)
    total = [0] * (n + 1)
    for i in range(n):
        total[i + 1] = total[i] + weight[i]
    block = [total[min(n, i + window)] - total[i] for i in range(n)]  # of the window that begins at i
    most = max(block, default=0)
    high = min(surge, (most + 1) // 2)
    out: list[tuple[int, int]] = []
    i = 0
    while i < n and most:
        if block[i] < high or not weight[i]:
            i += 1
            continue
        start = last = i
        while start > max(0, i - window) and weight[start - 1]:
            start -= 1
        while i < n and block[i] > 0:
            if weight[i]:
                last = i
            i += 1
        out.append((start, last))
    return out


def main_text(page: str) -> str:
    found = lines(page)
    weight, may = weights(found)
    kept = {i for a, b in runs(weight) for i in range(a, b + 1) if may[i]}
    parents = {found[i].parent for i in kept if weight[i]} - {0}
    return "\n".join(x.text for i, x in enumerate(found) if i in kept or (weight[i] and x.parent in parents))


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every page, and its main text (column text)."""
    keep = [c for c in pages.columns if c != column] if keep is None else keep
    return arrow_map(pages, {"h": pages[column]}, keep, {"text": "string"}, lambda got: {"text": [main_text(h) for h in as_texts(got["h"])]})
