"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its root-to-leaf tag path (tags with their class names). Text length and
punctuation are aggregated by path and divided by the path's blocks. The ratios are smoothed over the blocks in page order;
a path's own and its smoothed ratio are fused, with the share of its text that is no link, with how much text the containers
of its blocks hold (which counts less within an article; a title may stand alone), and with what tags and names along the path say (log-odds, the fixed words below) into one score. The
text of a page is that of the blocks whose path scores at least a share of the text-weighted mean score.

Names are evidence among other evidence. An element that is named as something else but holds nearly all text of the page,
in several paths, is a layout wrapper, and its name says nothing. Only what is no text at all is left out before scoring:
scripts, styles, forms and hidden elements. Nothing depends on the depth or the length of a page, and time is linear in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, table

# Names of HTML elements and the words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template svg iframe object audio video canvas map form button select option textarea input label fieldset datalist progress meter".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th br nobr center label input button select option".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("thead", "tbody"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl article section main div aside nav header footer form blockquote".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adunit adbox taboola outbrain sponsor sponsored sponsors promo promotion promoted banner"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip"
    " footer foot masthead topbar toolbar sidebar sidebars aside rail widget widgets related recommended recommendations trending popular"
    " comment comments disqus respond replies reply discussion"
    " cookie cookies cookiebar cookiebanner cookienotice consent gdpr notice notices alert alerts warning popup modal overlay paywall newsletter subscribe subscription signup login"
    " share sharing social copyright legal disclaimer search form hidden"
    " commentlist commentform commentarea commentsection usercomments readercomments sitefooter pagefooter sitenav mainnav topnav subnav".split()
)
HEADER_WORDS = frozenset("header head top".split())
#: Of an article rather than of a page.
TITLE_WORDS = frozenset("article post entry content story title headline main page section body text analysis".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip status".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
TEXTUAL = frozenset("p blockquote pre li dd dt td th tr figcaption h2 h3 h4 h5 h6".split())
OTHER = frozenset("nav menu footer aside header dialog".split())
#: Not containers of text by themselves: what holds them is.
PARTS = frozenset("li ul ol dl dt dd table tbody thead tfoot tr blockquote figure figcaption pre header hgroup p h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡«»“”\"()]")

#: Width of the smoothing; the ratio at which a path counts half; the share of the mean, and the least score, that select a path.
SPREAD, HALF, SHARE, LEAST = 1.0, 60.0, 0.1, 0.0125
#: Log-odds: a name of something else, a tag or role of something else, article or main, a name of an article, a title, a tag of running text.
NAMED, TAGGED, INSIDE, CALLED, TITLE, RUNNING = -4.5, -5.0, 1.5, 0.7, 1.5, 0.7
#: Shares of the page's text between which an element's name loses its weight.
WRAPS = (0.8, 0.95)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: After a quote that never ends: tags end at the next sign.
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)()()()", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BIT = {t: 1 << i for i, t in enumerate(sorted({"p"} | HEADINGS | {t for ts in CLOSED_BY.values() for t in ts}))}


class Element:
    """An element with all that its blocks need to know about what lies above it."""

    __slots__ = ("tag", "path", "parent", "own", "drop", "linked", "inside", "called", "tagged", "named", "outer", "block", "container", "closable", "heads")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, paths: dict):
        self.tag, self.parent, up = tag, parent, parent
        classes = attributes.get("class", "")
        self.path = paths.setdefault((up.path if up else -1, tag, tuple(sorted(set(_TOKEN.findall(classes.lower()))))), len(paths))
        words = set(_TOKEN.findall(_HUMP.sub(" ", f"{classes} {attributes.get('id', '')}").lower())) if tag not in ("html", "body") else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        self.inside = bool(up and up.inside)
        other = bool(words & WORDS) or bool(words & HEADER_WORDS) and not words & TITLE_WORDS and not self.inside and tag in ("div", "section")
        if tag in MAIN and (tag == "main" or not words & {"comment", "comments", "reply", "replies", "ad", "ads", "sponsored", "promo", "related"}):
            self.inside, other = True, False
        self.own = other or hidden or tag in DROPPED
        self.drop = bool(up and up.drop) or hidden or tag in DROPPED
        self.linked = tag == "a" or bool(up and up.linked)
        self.called = bool(up and up.called) or bool(words & TITLE_WORDS) and not other
        self.heads = tag in HEADINGS or bool(up and up.heads)
        away = (tag in OTHER and not (tag == "header" and self.inside)) or attributes.get("role", "").lower() in ROLES
        self.tagged = 2 if away or bool(up and up.tagged == 2) else 1 if tag == "header" or bool(up and up.tagged == 1) else 0
        self.outer = up.named if up else None  # the next one above that is named as something else
        self.named = self if other else self.outer
        block = tag not in INLINE or self.own or up is None
        self.block = self if block else up.block
        self.container = self if (block and tag not in PARTS) or up is None else up.container
        #: Which elements that a new one may end are open since the last scope.
        self.closable = 0 if tag in SCOPES else (up.closable if up else 0) | _BIT.get(tag, 0)


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with their innermost block element; entities decoded, white space joined."""
    paths: dict = {}
    root = Element("html", {}, None, paths)
    stack, out, open_ = [root], [], Counter()
    pieces: list[tuple[str, bool]] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text and not stack[-1].drop:
                out.append(Block(text, stack[-1].block, sum(len("".join(p.split())) for p, linked in pieces if linked)))
            pieces.clear()

    def push(element: Element) -> None:
        stack.append(element)
        open_[element.tag] += 1

    def cut(i: int) -> None:
        if any(e.block is e for e in stack[i:]):
            flush()
        for e in stack[i:]:
            open_[e.tag] -= 1
        del stack[i:]

    def close(tag: str) -> None:
        if open_[tag] > 0:
            cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))

    def opened(tags: tuple[str, ...]) -> None:
        """Ends the elements of these names that a new one ends, up to the next scope."""
        if stack[-1].closable & sum(_BIT[t] for t in tags):
            first = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    first = i
                elif stack[i].tag in SCOPES:
                    break
            cut(first)

    at, end, tags = 0, len(page), _TAG
    while at < end:
        m = tags.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            pieces.append((html.unescape(page[at:stop]), stack[-1].linked))
        if not m:
            break
        at = m.end()
        if m[5]:
            tags = _BROKEN
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            close(tag)
            continue
        if tag in ("html", "body"):
            flush()
            if tag == "body":
                close("head")
                if not open_["body"]:
                    push(Element("body", {}, stack[-1], paths))
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if tag in CLOSES_P:
            opened(("p",))
        if tag in CLOSED_BY:
            opened(CLOSED_BY[tag])
        if tag in HEADINGS:
            opened(tuple(HEADINGS))
        if tag in ("br", "td", "th", "img"):
            pieces.append((" ", False))
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[3] or m[6] or "")}
        element = Element(tag, attributes, stack[-1], paths)
        if element.block is element:
            flush()
        push(element)
    flush()
    return out


def _smoothed(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / SPREAD) ** 2)
    kernel /= kernel.sum()
    padded = np.concatenate([x[:1], x[:1], x, x[-1:], x[-1:]])
    return np.convolve(padded, kernel, "valid")


def _weights_of_names(found: list[Block]) -> dict[Element, float]:
    """The log-odds that each element named as something else gives to what it holds."""
    total = max(1, sum(len(b.text) - b.linked for b in found))
    mass: dict[Element, int] = {}
    paths: dict[Element, set[int]] = {}  # at most two of each
    for b in found:
        e = b.element.named
        if e is not None:
            mass[e] = mass.get(e, 0) + len(b.text) - b.linked
            if len(p := paths.setdefault(e, set())) < 2:
                p.add(b.element.path)
    order, seen = [], set()
    for e in list(mass):
        chain = []
        while e is not None and e not in seen:
            seen.add(e)
            chain.append(e)
            e = e.outer
        order += reversed(chain)  # those above come first
    for e in reversed(order):
        if e.outer is not None:
            mass[e.outer] = mass.get(e.outer, 0) + mass.get(e, 0)
            paths.setdefault(e.outer, set()).update(list(paths.get(e, ()))[: 2 - len(paths.get(e.outer, ()))])
    out: dict[Element, float] = {}
    for e in order:
        share = mass.get(e, 0) / total
        keep = 1.0 if len(paths.get(e, ())) < 2 else 1.0 - min(1.0, max(0.0, (share - WRAPS[0]) / (WRAPS[1] - WRAPS[0])))
        out[e] = min(NAMED * keep, out[e.outer] if e.outer is not None else 0.0)
    return out


def path_scores(found: list[Block]) -> dict[int, float]:
    """The fused score of each path."""
    names = _weights_of_names(found)
    totals: dict[int, list[float]] = {}
    held: dict[Element, float] = {}
    log: list[float] = []
    for b in found:
        t = totals.setdefault(b.element.path, [0.0, 0.0, 0.0, 0.0])
        for i, v in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), b.linked, 1)):
            t[i] += v
        e = b.element
        odds = names.get(e.named, 0.0)
        if e.tagged == 2 or e.tagged == 1 and not e.heads:
            odds = min(odds, TAGGED)
        log.append(odds)
        held[e.container] = held.get(e.container, 0.0) + (len(b.text) - b.linked) * math.exp(odds)
    own = np.array([totals[b.element.path][0] / totals[b.element.path][3] * (1 + totals[b.element.path][1] / totals[b.element.path][3]) for b in found])
    own = own / (own + HALF)
    fused = np.sqrt(own * _smoothed(own))
    most = max(held.values()) or 1.0
    sums: dict[int, float] = {}
    for b, ratio, odds in zip(found, fused, log, strict=True):
        e = b.element
        odds += INSIDE * e.inside + CALLED * e.called + (TITLE if e.tag == "h1" else RUNNING * (e.tag in TEXTUAL))
        sums[e.path] = sums.get(e.path, 0.0) + float(ratio) * (1.0 if e.tag == "h1" else (held[e.container] / most) ** (0.5 if e.inside else 1.0)) * math.exp(odds)
    return {p: s / totals[p][3] * (1 - min(1.0, totals[p][2] / max(1.0, totals[p][0]))) for p, s in sums.items()}


def extract(page: str | None) -> str:
    """The blocks of the selected paths, joined by newlines; empty if the page has no text."""
    found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(found)
    level = max(LEAST, SHARE * sum(scores[b.element.path] * len(b.text) for b in found) / sum(len(b.text) for b in found))
    return "\n".join(b.text for b in found if scores[b.element.path] >= level)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Null or empty html gives an empty text, as does a page without any content; rows that repeat a page are extracted each;
    pages of any length and depth are read whole; paths that tie are all taken or all left; an empty table gives an empty
    result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
