"""Main text of HTML pages by tag-path ratios.

A page is read into text blocks, each with the path of tags (and class names) from the
root to it. Characters and punctuation marks are summed over all blocks of a path and
divided by their number, which makes the path's plain ratio; ratios are smoothed over the
paths that come before and after it on the page, by a Gaussian of the path edit distance;
the geometric mean of both, less the share of links, is the fused ratio. What a page says
of its parts weighs in it: navigation, headers, footers, asides, forms, dialogs, adverts,
notices, comments and hidden parts, by tag, role or the words of class and id, have a
factor of ``HARD`` or ``SOFT``, and where a page has an article, main or articleBody
element, what lies outside has ``outside``. Paths under a share of the best fused ratio
(a smaller share inside an article), or under ``LEAST``, are dropped.

Defined results: a null or empty page gives an empty text; a page without content blocks
too; a page cut off in the middle gives the text it has; repeated rows give the same text
twice; ids are of any type; extra columns are ignored; time grows in proportion to a
page's length: an open element that a tag closes is looked for among the ``REACH``
innermost ones, a path has ``MAX_DEPTH`` steps at most, and a ratio is smoothed over
``NEIGHBOURS`` paths on either side.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path keeps at most so many steps; deeper elements share their ancestor's path.
MAX_DEPTH = 64
#: An implied end tag, and the end of an inline element, looks at so many open elements.
REACH = 64
#: Paths on either side, in page order, over which a ratio is smoothed; edit distances are counted up to this many.
NEIGHBOURS, FAR = 8, 4
#: Factors of the ratios of parts that the page marks as no content by tag or role, or by a word of class or id.
HARD, SOFT = 0.001, 0.001
#: A fused ratio under this is no text at all: marked parts can't reach it on a page that has nothing else.
LEAST = 0.05
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "main", "td", "th", "aside", "nav", "footer", "header"}
_BOILER_TAGS = {"nav", "footer", "aside", "form", "dialog", "button", "select", "menu", "head", "input", "fieldset", "label", "datalist", "audio", "video", "canvas"}
_BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status", "tablist"}
_BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored", "sponsors", "promo", "promoted", "promotion",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "topbar", "toolbar", "logo", "brand", "branding", "pagination", "pager",
    "header", "footer", "foot", "copyright", "legal", "colophon",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "disclaimer", "warning",
    "newsletter", "subscribe", "subscription", "signup", "signin", "login", "register", "paywall",
    "social", "share", "sharing", "related", "recommended", "recommendations", "trending", "popular", "teaser", "widget", "outbrain", "taboola",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reviews",
    "form", "search", "hidden", "skip", "aside",
}
_ROOT_TAGS = {"article", "main"}
_NEVER_SOFT = {"html", "body"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class _Page:
    """Elements of a page in order (parent, tag, path, mark) and its text blocks."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.mark, self.root = [-1], [""], [0], [0], [False]
        self.holder = [0]  # the innermost element around each one, itself included, that isn't inline
        self.paths: list[tuple[str, ...]] = [()]  # a path's steps, by number
        self.numbers: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.open: dict[str, int] = {}  # how many elements of a tag are open
        self.roots = 0  # and how many articles
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.buffer: list[str] = []
        self.linked = 0
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.blocks.append((self.holder[self.stack[-1]], text, min(self.linked, len(text))))
            self.buffer, self.linked = [], 0

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self.buffer.append(text)
        if self.open.get("a"):
            self.linked += len(text.strip())

    def _leave(self, at: int) -> None:
        """Closes the open elements from a place of the stack on."""
        for i in self.stack[at:]:
            self.open[self.tag[i]] -= 1
            self.roots -= self.root[i]
        del self.stack[at:]

    def _open(self, tag: str, raw: str) -> None:
        if tag == "br" or tag == "wbr" or tag == "img":
            self.buffer.append(" " if tag == "br" else "")
            return
        if tag not in _INLINE:
            self._flush()
            closing = _SIBLINGS.get(tag, {"p"} if tag in _CLOSES_P else ())
            if self.open.get("p") and tag in _CLOSES_P or any(self.open.get(t) for t in closing):
                for at in range(len(self.stack) - 1, max(len(self.stack) - 1 - REACH, 0), -1):
                    own = self.tag[self.stack[at]]
                    if own in closing or tag in _CLOSES_P and own == "p":
                        self._leave(at)
                        if tag not in ("tr", "tbody"):
                            break
                    elif own in _SCOPE:
                        break
        if tag in _VOID:
            return
        above = self.stack[-1]
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}
        words = {w.lower() for w in _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")}
        role = attributes.get("role", "").lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        root = tag in _ROOT_TAGS or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
        mark = self.mark[above] == 2 and 2 or 0
        if tag in _BOILER_TAGS or role in _BOILER_ROLES or hidden or tag == "header" and not self.roots:
            mark = 2
        elif not mark and words & _BOILER_WORDS and tag not in _NEVER_SOFT:
            mark = 2 if tag in _ROOT_TAGS and words & {"comment", "comments", "reply"} else 1
        number, inline = self.path[above], tag in _INLINE
        if not inline and len(self.paths[number]) < MAX_DEPTH:
            step = (number, tag + "".join(f".{c}" for c in sorted(attributes.get("class", "").split())[:3]))
            if step not in self.numbers:
                self.numbers[step] = len(self.paths)
                self.paths.append((*self.paths[number], step[1]))
            number = self.numbers[step]
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(number)
        self.mark.append(mark)
        self.root.append(root and mark < 2)
        self.holder.append(self.holder[above] if inline else len(self.tag) - 1)
        self.stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.roots += self.root[-1]

    def _close(self, tag: str) -> None:
        inline = tag in _INLINE
        if not inline:
            self._flush()
        if not self.open.get(tag):
            return
        for at in range(len(self.stack) - 1, max(len(self.stack) - 1 - REACH, 0) if inline else 0, -1):
            own = self.tag[self.stack[at]]
            if own == tag:
                self._leave(at)
                return
            if inline and own not in _INLINE:
                return

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            if html.startswith("<!--", start):
                self._text(html[at:start])
                end = html.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            after = html[start + 1 : start + 2]
            if not (after.isalpha() and after.isascii() or after in ("/", "!", "?") and after):
                self._text(html[at : start + 1])
                at = start + 1
                continue
            self._text(html[at:start])
            end = self._tag_end(html, start)
            if end < 0:
                return  # cut off inside a tag
            at = end + 1
            if after in "!?":
                continue
            name = _NAME.match(html, start + (2 if after == "/" else 1))
            if not name:
                continue
            tag = name[0].lower()
            if after == "/":
                self._close(tag)
                continue
            if tag in _RAW:
                if html[end - 1] == "/":
                    continue
                closing = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                if not closing:
                    return
                at = html.find(">", closing.start()) + 1 or size
                continue
            self._open(tag, html[name.end() : end])

    @staticmethod
    def _tag_end(html: str, start: int) -> int:
        """Place of the > that ends a tag: not one inside a quoted value."""
        end = html.find(">", start)
        if end < 0 or "=" not in html[start:end]:
            return end
        at = start
        while True:
            opened = min((i for i in (html.find('="', at, end), html.find("='", at, end)) if i >= 0), default=-1)
            if opened < 0:
                return end
            closed = html.find(html[opened + 1], opened + 2)
            if closed < 0:
                return end
            at = closed + 1
            if closed > end:
                end = html.find(">", closed)
                if end < 0:
                    return -1


def _distance(a: tuple, b: tuple) -> int:
    """Edit distance of two paths, by steps; ``FAR`` where it is as much or more."""
    if abs(len(a) - len(b)) >= FAR:
        return FAR
    same = 0
    while same < len(a) and same < len(b) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):  # a band around the diagonal: what lies outside is as far as FAR
        lo, hi = max(1, i - FAR), min(len(b), i + FAR)
        before, row[lo - 1] = row[lo - 1], i if lo == 1 else FAR
        for j in range(lo, hi + 1):
            before, row[j] = row[j], min((row[j] if j < i + FAR else FAR) + 1, row[j - 1] + 1, before + (x != b[j - 1]))
    return min(row[-1], FAR)


def path_ratios(blocks: list[tuple[tuple, str, int]], sigma: float = 1.0) -> dict[tuple, float]:
    """The fused ratio of each path. blocks: (path, text, characters in links) in page order.

    A path is (group, steps); paths of different groups are not smoothed over each other.
    Characters and punctuation marks a block, as logarithms, make the plain ratio; the
    Gaussian of the path edit distance smooths it over the neighbouring paths of its group;
    fused is the geometric mean of both, less the share of its characters that are links
    (a heading may be one).
    """
    total: dict[tuple, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, linked in blocks:
        own = total[path]
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_PUNCTUATION.findall(text))
        own[3] += 0 if len(path[1]) > 0 and path[1][-1][:2] in _HEADINGS else linked
    raw = {p: math.log1p(length / n) * (1 + math.log1p(marks / n)) for p, (n, length, marks, _) in total.items()}
    groups: dict[object, list[tuple]] = defaultdict(list)
    for p in total:
        groups[p[0]].append(p)
    gauss = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(FAR)] + [0.0]
    fused = {}
    for order in groups.values():
        for at, p in enumerate(order):
            near = order[max(at - NEIGHBOURS, 0) : at + NEIGHBOURS + 1]
            weight = [gauss[_distance(p[1], q[1])] for q in near]
            smooth = sum(w * raw[q] for w, q in zip(weight, near)) / sum(weight)
            _, length, _, linked = total[p]
            fused[p] = math.sqrt(raw[p] * smooth) * (1 - linked / length)
    return fused


def extract(html: str | None, *, share: float = 0.2, share_inside: float = 0.02, outside: float = 0.02, sigma: float = 1.0, hard: float = HARD, soft: float = SOFT, least: float = LEAST) -> str:
    """The main text of a page.

    share: of the best fused ratio, under which a path is dropped; share_inside: the same
    for paths inside an article or main element; outside: the factor of paths outside it,
    where a page has one with text; hard, soft: the factors of marked parts; least: the
    ratio that any text needs.
    """
    page = _Page(html or "")
    size = [0] * len(page.tag)
    for at, text, linked in page.blocks:
        size[at] += len(text) - linked
    holds = list(page.root)
    for i in range(len(size) - 1, 0, -1):
        size[page.parent[i]] += size[i]
        holds[page.parent[i]] |= holds[i]
    mark, inside = [0] * len(size), [False] * len(size)
    for i in range(1, len(size)):
        # A part that its class names as no content still is a wrapper if the article or most of the page is in it.
        wrapper = page.mark[i] == 1 and (holds[i] or size[i] * 2 > size[0])
        mark[i] = max(mark[page.parent[i]], 0 if wrapper else page.mark[i])
        inside[i] = inside[page.parent[i]] or page.root[i]
    blocks = [(((mark[at], inside[at]), page.paths[page.path[at]]), text, linked) for at, text, linked in page.blocks]
    bounded = any(own == (0, True) for (own, _), _, _ in blocks)
    factor = {(m, i): (1, soft, hard)[m] * (outside if bounded and not i else 1) for m in range(3) for i in (False, True)}
    ratio = {p: r * factor[p[0]] for p, r in path_ratios(blocks, sigma).items()}
    best = max(ratio.values(), default=0)
    return "\n".join(text for path, text, _ in blocks if ratio[path] >= max((share_inside if path[0][1] else share) * best, least))


def extract_pages(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", share: float = 0.2, sigma: float = 1.0) -> DataFrame:
    """``key``, ``url``, text and n_chars (code points) of every page. A narrow step without shuffle."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(h, share=share, sigma=sigma) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    found = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    kind = lambda c: found.schema[c].dataType.simpleString()
    return found.mapInArrow(run, f"k {kind('k')}, u {kind('u')}, text string, n_chars bigint").withColumnsRenamed({"k": key, "u": url})
