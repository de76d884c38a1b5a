"""Main-text extraction from HTML by tag-path ratios.

A page is cut into blocks of text, each under a root-to-leaf path of block-level tags with their classes.
Per path the text outside links and the punctuation are added up and divided by the times that it occurs; the
two ratios are smoothed over the blocks in page order and fused, and a path's value is the mean over its blocks.
Paths whose value, weighted by what their elements are called, reaches two fifths of the largest value are content.
Names only weigh: what lies in an article element, or in main where there is none, counts more; what lies in navigation, footers, sidebars,
forms, or under classes of adverts, notices or reader comments, counts less.  Where all values are alike they say
nothing, and every path is content.

Chosen paths bring their region along, with its headings and short paragraphs, unless names or ratios speak
against them: the article elements, else the main elements, that hold most of the chosen text, or else the
smallest element that does.

Null html, and pages without text, give an empty text; unclosed, crossed and cut-off tags are read as
browsers read them, near enough; rows are on their own, so repeated rows and urls give repeated results; other
columns are dropped.  A page takes time in proportion to its length, however its tags are nested or broken.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: A tag, its name and its attributes; nothing is ever tried in a second way.
TAG = re.compile(r"""</?+([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Elements whose content isn't markup, and isn't text of the page.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "svg", "math", "object", "template", "audio", "video", "canvas"}
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*+>?+", re.I) for t in sorted(RAW)}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are part of a running text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: Elements whose text is no text of the page.
NEVER = {"head", "button", "select", "option", "datalist", "input"}
#: Elements and roles that seldom hold the article.
SELDOM = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of classes and ids that mark what isn't the article, and others that may do so.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter overlay pager pagination paywall popup promo promotion reply replies respond sidebar signup skip sponsor sponsored subscribe subscription topbar".split()
)
HINTS = set("alert alerts disclaimer discussion header notice notices notification recommended related responses share sharing social toolbar widget widgets".split())
#: What names are worth: within an article, marked, perhaps marked.
ARTICLE, MARKED, HINTED = 8.0, 1 / 16, 1 / 4
#: Part of the largest value that a content path reaches, and of the chosen text that a region holds.
LEAST, MOST, NEARLY_ALL = 0.4, 0.5, 0.75
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements that an implied end doesn't reach across.
WALLS = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "blockquote", "select", "td", "th"}
#: Elements that are no region of their own.
LEAVES = {"p", "li", "td", "blockquote", "pre", "h1", "h2", "h3"}
PUNCTUATION = re.compile(r"[.,;:!?¡¿。、，]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: int
    path: int  # number of its root-to-leaf path
    excluded: bool
    article: bool
    within: int  # 2 in an article element, 1 in what else is named the article
    weight: float  # of names against it: 1 if there are none


@dataclass
class Block:
    element: int
    path: int
    text: str
    linked: int


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(text) if text.strip(" /\n\t") else ():
        out.setdefault(k.lower(), html.unescape(a or b or c))
    return out


def _named(tag: str, has: dict[str, str], in_article: bool) -> tuple[float, bool]:
    """The weight of an element's own names, and whether it is hidden."""
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{has.get('class', '')} {has.get('id', '')}").lower()))
    if in_article:
        words.discard("header")  # an article's own head
    hidden = "hidden" in has or has.get("aria-hidden") == "true" or HIDDEN.search(has.get("style", "")) is not None
    if tag in ("html", "body"):
        return 1.0, hidden
    marked = words & MARKS or tag in SELDOM or has.get("role", "").lower() in ROLES or (tag == "header" and not in_article)
    return (MARKED if marked else HINTED if words & HINTS else 1.0), hidden


class Tree:
    """The open elements of a page while it is read, and all that there were."""

    def __init__(self) -> None:
        self.elements = [Element("#root", -1, 0, False, False, 0, 1.0)]
        self.stack = [0]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack, by tag
        self.paths: dict[tuple[int, str], int] = {}

    def push(self, tag: str, has: dict[str, str]) -> None:
        up = self.elements[self.stack[-1]]
        weight, hidden = _named(tag, has, up.within > 0)
        article = weight == 1 and (tag in ("article", "main") or has.get("role", "").lower() in ("main", "article") or "articlebody" in has.get("itemprop", "").lower())
        name = tag + "".join(f".{w}" for w in sorted(has.get("class", "").split()))
        path = self.paths.setdefault((up.path, name), len(self.paths) + 1)
        excluded = up.excluded or tag in NEVER or hidden
        self.open[tag].append(len(self.stack))
        self.stack.append(len(self.elements))
        self.elements.append(Element(tag, self.stack[-2], path, excluded, article and not excluded, max(up.within, article + (article and tag == "article")), min(up.weight, weight)))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.open[self.elements[self.stack.pop()].tag].pop()

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def imply_ends(self, tag: str) -> None:
        """Ends what a new element of this tag can't lie in."""
        shut = CLOSES.get(tag, {"p"})
        while (place := self.last(shut)) and place >= self.last(WALLS):
            own = self.elements[self.stack[place]].tag
            self.pop_to(place)
            if own != "p" or tag == "p":
                break


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page in order, and its block-level elements."""
    tree = Tree()
    blocks: list[Block] = []
    parts: list[str] = []
    linked = at = start = 0
    in_link = False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(tree.stack[-1], tree.elements[tree.stack[-1]].path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while (begin := page.find("<", at)) >= 0:
        kind = page[begin + 1 : begin + 2]
        if kind == "/" and page[begin + 2 : begin + 3].isalpha() or kind.isalpha() and kind.isascii():
            m = TAG.match(page, begin)
            end = m.end() if m else -1
        elif kind and kind in "!?/":
            m = None
            mark = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(mark, begin + (4 if len(mark) == 3 else 2))
            end = end + len(mark) if end >= 0 else -1
        else:
            at = begin + 1  # a sign of its own
            continue
        add(page[start:begin])
        at = start = end if end >= 0 else len(page)  # the page's end cuts the tag off
        if m is None:
            continue
        tag, attributes, closing = m[1].lower(), m[2], kind == "/"
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                found = RAW_END[tag].search(page, at)
                at = start = found.end() if found else len(page)
        elif tag in INLINE:
            if tag in ("br", "wbr", "img"):
                parts.append("\n" if tag == "br" else "")
            elif tag == "a":
                in_link = not closing
            elif closing:
                if tree.open.get(tag):
                    flush()
                    tree.pop_to(tree.last({tag}))
            elif attributes.strip() and not attributes.endswith("/"):
                has = _attributes(attributes)
                weight, hidden = _named("span", has, tree.elements[tree.stack[-1]].within > 0)
                if weight < 1 or hidden:  # running text that is marked as something else
                    flush()
                    tree.push(tag, has)
        else:
            flush()
            in_link = False
            if tag in VOID:
                continue
            if not closing:
                tree.imply_ends(tag)
                tree.push(tag, _attributes(attributes))
            elif place := tree.last({tag}):
                tree.pop_to(place)
    add(page[start:])
    flush()
    return blocks, tree.elements


def smooth(values: np.ndarray, radius: int = 1, width: float = 0.5) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks; narrow, so that a short block beside a long one stays short."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / width) ** 2)
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def fused_ratios(blocks: list[Block]) -> np.ndarray:
    """For each block the fused ratio of its path: text outside links, and punctuation, per occurrence."""
    paths = np.unique([b.path for b in blocks], return_inverse=True)[1]
    times = np.bincount(paths)
    text = np.bincount(paths, [len(b.text) - b.linked for b in blocks]) / times
    marks = np.bincount(paths, [len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0 for b in blocks]) / times
    return smooth(text[paths]) * (1 + smooth(marks[paths]))


def chosen_blocks(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """Which blocks lie under paths that the ratios, weighted by names, choose."""
    ratio = fused_ratios(blocks)
    paths = np.unique([b.path for b in blocks], return_inverse=True)[1]
    value = (np.bincount(paths, ratio) / np.bincount(paths))[paths]
    if value.max() - value.min() <= 1e-9 * value.max():
        return np.ones(len(blocks), bool)
    under = [elements[b.element] for b in blocks]
    innermost = max(e.within for e in under) or -1
    names = np.array([ARTICLE if e.within == innermost and e.weight == 1 else e.weight for e in under])
    return value * names >= LEAST * value.max()


def content_blocks(blocks: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks of the article, in page order."""
    free = [b for b in blocks if not elements[b.element].excluded]
    if not free:
        return []
    chosen = chosen_blocks(free, elements)
    regions = _regions(free, chosen, elements)
    inside = [False] * len(elements)  # elements come after those around them
    for i, e in enumerate(elements):
        inside[i] = i in regions or (e.parent >= 0 and inside[e.parent])
    return [b for b, own in zip(free, chosen.tolist(), strict=True) if own or (inside[b.element] and elements[b.element].weight == 1)]


def _regions(free: list[Block], chosen: np.ndarray, elements: list[Element]) -> set[int]:
    """The elements whose headings and short paragraphs belong to the chosen blocks.

    Article elements, else main elements, if they hold most of the chosen text, and else the smallest element that
    holds nearly all of it, if it is smaller than the page's body.  Where no text is chosen, any article will do.
    """
    held = [0] * len(elements)
    for b, own in zip(free, chosen.tolist(), strict=True):
        held[b.element] += (len(b.text) - b.linked) * own
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
    for plain in (True, False):
        named, outer, around = set(), 0, [False] * len(elements)
        for i, e in enumerate(elements):
            own = e.article and (e.tag == "article" or not plain)
            outside = e.parent < 0 or not around[e.parent]
            around[i] = own or not outside
            if own:
                named.add(i)
                outer += held[i] * outside
        if named and outer >= MOST * held[0]:
            return {i for i in named if held[i] or not held[0]} | {i for i, e in enumerate(elements) if e.tag == "h1" and e.within}
    below: dict[int, int] = {}
    for i, e in enumerate(elements[1:], 1):
        if held[i] >= NEARLY_ALL * held[0] > 0:
            below[e.parent] = i
    region = 0
    while region in below and elements[below[region]].tag not in LEAVES:
        region = below[region]
    return set() if region == 0 or elements[region].tag in ("html", "body") else {region}


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not page:
        return ""
    return "\n\n".join(b.text for b in content_blocks(*blocks_of(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, the main ``text`` and its length in code points."""
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return work

    return arrow_pass(pages, {"page_id": F.col(id_col), "url": F.col(url_col), "html": F.col(html_col)}, make, f"page_id {kind}, url {url_kind}, text string, n_chars long")
