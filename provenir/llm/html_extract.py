"""Main-text extraction from web pages by line-block distribution.

A page becomes a sequence of lines (one for each block of text). Each line has a weight: its
characters, without those in links unless the block is a paragraph or heading, or nothing if an enclosing
element is page furniture. What only its class, id or role calls furniture isn't if it holds the page's
articles or most of its text. Sums of the weights over a sliding window of lines rise at a surge point,
where text starts, and fall to nothing at a dive point, where it ends. The lines from surge to dive are kept
if the highest sum between them is large enough; so are lines of links among them, while a longer run of those (a
menu that no mark tells) is a dive. Furniture is never kept. A marked article's text needs no threshold.

Defined results: a null or empty page, or one without text, gives the empty string; repeated pages give the same
text, an empty table no rows. White space in a block becomes one space, blocks are joined by a newline,
repeated blocks stay, and nothing is capped: neither a page's length, in which time is linear, nor the depth of its
elements. Only `keep` and the page are read, so that other columns can't clash.
"""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, field

#: Lines in the sliding window, and the window sum at which a surge starts outside a marked article.
WINDOW = 3
SURGE = 80

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>?""", re.S)
RAW = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split()
)
FURNITURE = frozenset("nav footer aside form head button menu dialog label fieldset".split())
REGION = frozenset("article main".split())
#: Blocks whose links are part of a text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre dd figcaption caption address center".split())
#: Words of class, id and role attributes that mark furniture.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsbygoogle|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscribe|subscription|signup|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|topbar|toolbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|responses|related|recommend(?:ed|ations)?|share|sharing|social|widgets?|pagination|pager|skip|login|search|complementary|contentinfo|site-header|page-header|disclaimer)(?=$|[\s_-])"
)
#: The same for words that stand for a whole page header, taken outside an article only.
HEADER = re.compile(r"(?:^|[\s_-])(?:headers?|banner)(?=$|[\s_-])")
#: Marks that tell an element's state, not what it is.
STATE = re.compile(r"(?<!\S)(?:(?:has|no|with|without)[_-]\S*|\S*[_-](?:open|closed))(?!\S)")
MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    """By element, or hidden."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    return bool(attributes) and name not in ("html", "body", "main") and HIDDEN.search(attributes) is not None


def is_hinted(name: str, attributes: str, in_article: bool) -> bool:
    """By words of class, id and role."""
    if not attributes or name in ("html", "body", "main"):
        return False
    for m in MARKS.finditer(attributes):
        marks = STATE.sub(" ", (m[1] or m[2] or m[3] or "").lower())
        if HINT.search(marks) or not in_article and HEADER.search(marks):
            return True
    return False


class Line(NamedTuple):
    text: str
    weight: int
    furniture: bool
    article: bool  # whether an article encloses it
    hint: int = -1  # innermost hinted element


#: A region's border: no window reaches over it.
EDGE = Line("", -1, True, False)


class Open(NamedTuple):
    """An open element."""

    name: str
    furniture: bool
    article: bool
    hint: int
    block: int  # place of the innermost block on the stack


NOTHING = Open("", False, False, -1, -1)


def hints_off(hints: list[list[int]], lines: list[Line], outside: bool) -> list[bool]:
    """Whether each hinted element (the one around it, whether it holds an article or main) is furniture or inside such.

    outside: whether an article or main lies outside of all of them; then hints are right.
    """
    held, total = [0] * len(hints), 0
    for x in lines:
        n = len(x.text) * (x.weight > 0)
        total += n
        if x.hint >= 0:
            held[x.hint] += n
    for k in range(len(hints) - 1, -1, -1):
        around, region = hints[k]
        if around >= 0:
            held[around] += held[k]
            hints[around][1] |= region
    off: list[bool] = []
    for (around, region), n in zip(hints, held, strict=True):
        off.append(around >= 0 and off[around] or outside or not (region or 2 * n > total))
    return off


def page_lines(page: str) -> list[Line]:
    """The page's lines, with EDGE at each border of a region."""
    lines: list[Line] = []  # as if no hint counted
    stack: list[Open] = []
    hints: list[list[int]] = []  # hinted element around it or -1, whether it holds an article or main
    outside = False
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else NOTHING
                prose = top.article and top.block >= 0 and stack[top.block].name in PROSE
                lines.append(Line(text, 0 if top.furniture else len(text) if prose else max(0, len(text) - linked), top.furniture, top.article, top.hint))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop().name
            open_[top] -= 1
            links -= top == "a"
            if top == name:
                return

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(piece := page[at : m.start()])
            linked += len(piece) * (links > 0)
        at = max(m.end(), m.start() + 1)
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th", "img"):
            parts.append(" ")
        if m[1]:
            if open_.get(name):
                off = stack[-1].furniture or stack[-1].hint >= 0
                if name not in BLOCK and off:  # an inline advert ends inside a block
                    parts and flush()
                close(name)
                if name in REGION:
                    lines.append(EDGE)
            continue
        if name in VOID or m[3].endswith("/") and name in ("svg", "math", "script"):
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK and stack and (k := stack[-1].block) >= 0 and (stack[k].name == "p" or name == stack[k].name == "li"):
            close(stack[k].name)
        if name == "body" and open_.get("head"):
            close("head")
        top = stack[-1] if stack else NOTHING
        hint = top.hint
        own = is_furniture(name, m[3], top.article)
        hinted = not (top.furniture or own) and is_hinted(name, m[3], top.article)
        if (own or hinted) and not top.furniture and hint < 0 and name not in BLOCK:
            flush()
        if hinted:
            hints.append([hint, 0])
            hint = len(hints) - 1
        if name in REGION:
            if not (top.furniture or own):
                outside |= hint < 0
                if hint >= 0:
                    hints[hint][1] = 1
            lines.append(EDGE)
        stack.append(Open(name, top.furniture or own, top.article or name in REGION and not (top.furniture or own), hint, len(stack) if name in BLOCK else top.block))
        open_[name] = open_.get(name, 0) + 1
        links += name == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    off = hints_off(hints, lines, outside)
    return [x if x.hint < 0 or not off[x.hint] else Line(x.text, 0, True, False) for x in lines]


def segments(weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """(surge point, dive point, highest window sum) of each stretch of text among lines of these weights; -1 is a border.

    A surge point is a line of weight where no text is going on; the dive point is the line after the last
    one of weight before a whole window without any, or before a border.
    """
    out: list[tuple[int, int, int]] = []
    surge = dive = -1
    recent: deque[int] = deque(maxlen=window)  # weights of the window that ends here
    highest = 0
    for k, w in enumerate([*weights, -1]):
        recent.append(max(w, 0))
        if surge >= 0 and (w < 0 or not any(recent)):
            out.append((surge, dive, highest))
            surge = -1
        if w < 0:
            recent.clear()
        elif w > 0:
            if surge < 0:
                surge, highest = k, 0
            dive = k + 1
        if surge >= 0:
            highest = max(highest, sum(recent))
    return out


def extract(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page."""
    if not page:
        return ""
    lines = page_lines(page)
    article = any(x.article and x.weight > 0 for x in lines)
    weights = [x.weight if x.weight < 0 or x.article or not article else 0 for x in lines]
    found = segments(weights, window)
    least = 0 if article else min(surge, max((highest for *_, highest in found), default=0))
    return "\n".join(lines[k].text for a, b, highest in found if highest >= least for k in range(a, b) if not lines[k].furniture and (lines[k].article or not article))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """`keep` and the main text of each row. One row out for each row in; a null page gives the empty text."""

    def start():
        return lambda column: [pa.array([extract(x or "", window, surge) for x in column.to_pylist()], pa.string())]

    return append_columns(pages, [html_col], list(keep), [field(out, T.StringType())], start)
