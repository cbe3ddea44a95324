"""
Main text of web pages by gradient-boosted trees over DOM-node features, with hierarchical decoding.

A page is parsed to a tree of block elements (inline elements belong to the block around them). Boosted trees give every
block a probability of being main text, from its tag, attribute tokens, depth, siblings and the density of its subtree.
Decoding then picks the cheapest consistent labelling of the whole tree: a block is outside, main text, or cut away; main
text may begin anywhere outside, what is cut away inside main text stays away with all its descendants, and nothing
below it returns. The trees are fitted on pages that a seeded writer makes up in many layouts, since no table holds labels.

Defined cases: null or blank html gives the empty text; repeated rows and null ids pass through; html of any length is
read as a whole in time that grows with its length; unclosed, stray and misnested tags are repaired; white space is what Unicode calls so,
no-break spaces and U+001C to U+001F included; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxscribe.llm.common import frugal, ship

NAME = re.compile(r"""/?[a-zA-Z][^\s/>"'<]*""")
REST = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")  # attributes with their quotes, up to the end of the tag
DEEPEST = 256  # elements open at once; what is nested deeper has its text with the last of them
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element classes of HTML.
RAW = {"script", "style", "xmp", "noembed", "noframes"}
ESCAPABLE = {"title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}
KINDS = [{"article", "main"}, {"section", "div", "center"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "select", "option", "input", "button", "textarea", "label", "dialog"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "thead", "tbody", "tfoot", "tr"}, {"td", "th"}, {"pre", "blockquote", "figure", "figcaption", "details", "summary"}, {"head", "title", "noscript", "template", "iframe", "object", "svg", "video", "audio", "canvas"}]
KIND_OF = {name: k for k, names in enumerate(KINDS) for name in names}
BOILER = set("nav navbar navigation menu menubar header masthead topbar banner footer foot bottom sidebar side aside rail widget ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login register search share sharing social follow related recommended recommend more comment comments reply replies discussion disqus respond breadcrumb breadcrumbs pagination pager tags meta byline author copyright legal disclaimer toolbar skip form".split())
CONTENT = set("article content main post entry story body text page hentry blog news copy prose single".split())
BUCKETS = 12


class Page:
    """Blocks in document order (a parent before its children) and the text runs that belong to them."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent = ["#page"], [""], [-1]
        self.runs: list[tuple[int, str, bool]] = []  # block, text, inside a link
        self.links = 0
        stack: list[tuple[str, int]] = [("#page", 0)]
        at, n = 0, len(source)
        for kind, start, end, name, attrs in self._markup(source):
            if start > at:
                self._text(stack, source[at:start])
            at = end
            if kind == "close":
                self._close(stack, name)
            elif kind == "open":
                self._open(stack, name, attrs)
            elif kind == "inside" and name in ESCAPABLE:
                self._text(stack, source[start:end])
        if at < n:
            self._text(stack, source[at:])

    @staticmethod
    def _markup(source: str) -> Iterator[tuple[str, int, int, str, str]]:
        """
        Kind (open, close, inside for what a raw element holds, none), start, end, name and attributes of each piece of markup. Every character is looked at a fixed number of times: quotes count
        only until a tag is met whose quotes never close, and once no > is left the rest is text.
        """
        at, n, quotes = 0, len(source), True
        while (at := source.find("<", at)) >= 0:
            name = NAME.match(source, at + 1)
            if name is None:
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 4)
                    end = n if end < 0 else end + 3
                elif source.startswith("<![CDATA[", at):
                    end = source.find("]]>", at)
                    end = n if end < 0 else end + 3
                elif source[at + 1 : at + 2] in ("!", "?", "/") and source[at + 1 : at + 3] != "/":
                    end = source.find(">", at) + 1
                    if not end:
                        return
                else:
                    at += 1
                    continue
                yield "none", at, end, "", ""
            else:
                rest = REST.match(source, name.end()) if quotes and name[0][0] != "/" else None
                if rest:
                    end = rest.end()
                else:
                    quotes = quotes and name[0][0] == "/"
                    end = source.find(">", name.end()) + 1
                    if not end:
                        return
                tag = name[0].lower()
                yield ("close", at, end, tag[1:], "") if tag[0] == "/" else ("open", at, end, tag, source[name.end() : end - 1])
                if tag in RAW or tag in ESCAPABLE:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, end)
                    yield "inside", end, close.start() if close else n, tag, ""
                    end = close.start() if close else n
            at = end

    def _open(self, stack: list, name: str, attrs: str) -> None:
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    self._pop(stack, i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SCOPES[name]:
                    break
                if stack[i][0] in SAME[name]:
                    self._pop(stack, i)
                    break
        top = stack[-1][1]
        if name in INLINE:
            if name == "br":
                self.runs.append((top, " ", False))
            elif name not in VOID and len(stack) < DEEPEST:
                self.links += name == "a"
                stack.append((name, top))
            return
        if name in {"html", "body"} and any(x[0] == name for x in stack):
            return
        self.tag.append(name)
        self.attrs.append(attrs)
        self.parent.append(top)
        self.runs.append((-1, "", False))
        if name not in VOID and len(stack) < DEEPEST:  # a slash at the end means nothing on other elements
            stack.append((name, len(self.tag) - 1))

    def _pop(self, stack: list, i: int) -> None:
        for name, _ in stack[i:]:
            self.links -= name == "a"
            if name not in INLINE:
                self.runs.append((-1, "", False))
        del stack[i:]

    def _close(self, stack: list, name: str) -> None:
        if name in {"html", "body"}:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                return self._pop(stack, i)
            if name in INLINE and stack[i][0] not in INLINE:
                return None
        return None

    def _text(self, stack: list, text: str) -> None:
        self.runs.append((stack[-1][1], html.unescape(text), self.links > 0))

    def features(self) -> np.ndarray:
        """A row a block."""
        n = len(self.tag)
        parent = np.array(self.parent)
        own, link, runs = np.zeros(n), np.zeros(n), np.zeros(n)
        for block, text, linked in self.runs:
            if block >= 0 and text and not text.isspace():
                own[block] += len(text)
                runs[block] += 1
                if linked:
                    link[block] += len(text)
        hits = np.zeros((n, 2))
        hashed = np.zeros((n, BUCKETS))
        for i, raw in enumerate(self.attrs):
            if raw and raw != "/":
                for m in ATTRIBUTE.finditer(raw):
                    if m[1].lower() in {"class", "id", "role", "itemprop", "aria-label"}:
                        for t in TOKEN.findall(m[2] or m[3] or m[4] or ""):
                            t = t.lower()
                            hits[i, 0] += t in BOILER
                            hits[i, 1] += t in CONTENT
                            hashed[i, sum(t.encode()) % BUCKETS] += 1
        kind = np.zeros((n, len(KINDS)))
        for i, t in enumerate(self.tag):
            if t in KIND_OF:
                kind[i, KIND_OF[t]] = 1
        text, links, blocks, paragraphs, items = own.copy(), link.copy(), np.ones(n), kind[:, 7].copy(), kind[:, 10].copy()
        fields = kind[:, 6].copy()
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (text, links, blocks, paragraphs, items, fields):
                a[p] += a[i]
        depth, place, above = np.zeros(n), np.zeros(n), np.zeros((n, 2))
        above_kind = np.zeros((n, len(KINDS)))
        children = np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            above[i] = above[p] + hits[p]
            above_kind[i] = np.maximum(above_kind[p], kind[p])
        siblings = children[parent]
        siblings[0] = 1
        up = np.maximum(parent, 0)
        total = max(text[0], 1.0)
        start = np.concatenate([[0], np.cumsum(own)[:-1]]) / total
        log = np.log1p
        columns = [log(own), log(text), links / np.maximum(text, 1), link / np.maximum(own, 1), text / total, text / np.maximum(text[up], 1), log(text / blocks), log(blocks), paragraphs, items, fields, depth, place, siblings, place / np.maximum(siblings, 1), start, log(text[up]), links[up] / np.maximum(text[up], 1), paragraphs[up], children, runs]
        return np.column_stack([*columns, hits, above, hashed, kind, above_kind])

    def text(self, states: np.ndarray) -> str:
        """Text of the blocks in state 1: a block's white space as one space, blocks joined by one space."""
        out, block = [], []
        for at, run, _ in self.runs:
            if at < 0:
                if block:
                    out += "".join(block).split()
                    block = []
            elif states[at] == 1:
                block.append(run)
        out += "".join(block).split()
        return " ".join(out)


class Boosted:
    """Gradient-boosted regression trees for a probability: histogram splits, trees of fixed depth."""

    def __init__(self, trees: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, cuts)) for column in x.T]
        binned = self._binned(x)
        n, f = x.shape
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.start)
        size, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, size), dtype=np.int64)
        self.cut = np.full((self.trees, size), self.bins, dtype=np.int64)
        self.value = np.zeros((self.trees, leaves))
        rng = np.random.default_rng(f)
        for t in range(self.trees):  # each tree sees a third of the features and half of the rows
            some, rows = np.sort(rng.choice(f, max(1, f // 3), replace=False)), np.sort(rng.choice(n, max(1, n // 2), replace=False))
            m = len(some)
            keys = binned[np.ix_(rows, some)] + np.arange(m)[None] * self.bins
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for d in range(self.depth):
                width = 2**d
                flat = (keys + node[rows, None] * (m * self.bins)).ravel()
                shape = (width, m, self.bins)
                gs = np.bincount(flat, np.repeat(g[rows], m), width * m * self.bins).reshape(shape).cumsum(2)
                hs = np.bincount(flat, np.repeat(h[rows], m), width * m * self.bins).reshape(shape).cumsum(2)
                G, H = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (G - gs) ** 2 / (H - hs + self.l2) - G**2 / (H + self.l2)
                gain[(hs < 1) | (H - hs < 1)] = 0
                best = gain.reshape(width, -1).argmax(1)
                worth = gain.reshape(width, -1).max(1) > 1e-6
                at = width - 1 + np.arange(width)
                self.feature[t, at] = np.where(worth, some[best // self.bins], 0)
                self.cut[t, at] = np.where(worth, best % self.bins, self.bins)
                node = 2 * node + (binned[np.arange(n), self.feature[t, width - 1 + node]] > self.cut[t, width - 1 + node])
            self.value[t] = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            margin += self.value[t][node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]) if len(x) else np.empty((0, len(self.edges)), dtype=np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                at = 2**d - 1 + node
                node = 2 * node + (binned[rows, self.feature[t, at]] > self.cut[t, at])
            margin += self.value[t][node]
        return 1 / (1 + np.exp(-margin))


def decode(parent: list[int], p: np.ndarray, weight: np.ndarray, turn: float = 1.0) -> np.ndarray:
    """
    The cheapest states of all blocks: 0 outside, 1 main text, 2 cut away. Children of 0 are 0 or 1, of 1 are 1 or 2, of 2 are 2;
    a turn from one to another costs `turn`, a state costs its weighted negative log likelihood.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = (-np.log(p) * weight).tolist(), (-np.log(1 - p) * weight).tolist()
    n = len(parent)
    cost = [[no[i], yes[i], no[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        out, main, cut = cost[i]
        up = cost[parent[i]]
        up[0] += min(out, main + turn)
        up[1] += min(main, cut + turn)
        up[2] += cut
    states = [0] * n
    for i in range(1, n):
        out, main, cut = cost[i]
        above = states[parent[i]]
        states[i] = 2 if above == 2 else (1 if main + turn < out else 0) if above == 0 else (2 if cut + turn < main else 1)
    return np.array(states)


class Writer:
    """Makes up pages with known main text: many layouts of menus, headers, sidebars, notices, adverts, forms and reader comments around it."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        letters = "abcdefghilmnoprstuv"
        self.words = ["".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(600)]

    def some(self, low: int, high: int) -> str:
        words = list(self.rng.choice(self.words, self.rng.integers(low, high + 1)))
        for i in range(0, len(words), int(self.rng.integers(6, 15))):
            words[i] = words[i].title()
            words[i - 1] += "." if i else ""
        return " ".join(words) + self.rng.choice([".", "", " &amp; co.", "&hellip;"])

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def one(self, *of: str) -> str:
        return of[self.rng.integers(len(of))]

    def tag(self, name: str, names: tuple = (), inside: str = "", truth: int = 0) -> str:
        attrs = MARK if truth else ""
        if names and self.chance(0.8):
            key, value = self.one("class", "id", "class"), self.one(*names)
            attrs += f' {key}="{value}{self.one("", "", "-wrap", " clearfix", "-1", " box")}"'
        end = "" if name in ("p", "li") and self.chance(0.2) else f"</{name}>"
        return f"<{name}{attrs}>{inside}{end}"

    def inline(self, text: str) -> str:
        if self.chance(0.3):
            text += self.one("<b>", "<i>", "<br>", "<br/>") + self.some(2, 6)
        if self.chance(0.3):
            text += f' <a href="/x">{self.some(1, 4)}</a> ' + self.one("", self.some(3, 12))
        return text

    def links(self, low: int = 3, high: int = 10) -> str:
        item = lambda: f'<a href="/{self.one(*self.words)}">{self.some(1, 3)}</a>'
        n = int(self.rng.integers(low, high + 1))
        if self.chance(0.7):
            return "<ul>" + "".join(self.tag("li", (), item()) for _ in range(n)) + "</ul>"
        return self.one(" | ", " ", "<br>").join(item() for _ in range(n))

    def boiler(self) -> str:
        kind = self.rng.integers(12)
        t = self.tag
        if kind == 0:
            return t(self.one("nav", "div", "nav"), ("nav", "menu", "main-menu", "navbar", "breadcrumb"), self.links())
        if kind == 1:
            return t(self.one("header", "div"), ("header", "masthead", "topbar", "site-header"), t("div", ("logo",), self.some(1, 4)) + self.one("", self.links(), t("p", (), self.some(3, 12)), t("h1", (), self.some(1, 4))))
        if kind == 2:
            return t(self.one("footer", "div", "footer"), ("footer", "bottom", "site-footer", "copyright"), "&copy; " + self.some(3, 25) + self.one("", self.links(), t("p", (), self.some(5, 30))))
        if kind == 3:
            return t(self.one("aside", "div"), ("sidebar", "widget", "related", "recommended", "rail"), t("h3", (), self.some(1, 4)) + self.one(self.links(), "".join(t("p", (), self.inline(self.some(5, 30))) for _ in range(self.rng.integers(1, 4)))))
        if kind == 4:
            return "<!-- ad -->" + t(self.one("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo-box"), self.one(self.some(3, 30), t("p", (), self.some(3, 30)), f'<a href="/ad">{self.some(3, 9)}</a>'))
        if kind == 5:
            return t("div", ("cookie-notice", "gdpr", "consent", "notice", "alert", "popup"), self.one(self.some(8, 40), t("p", (), self.some(8, 40))) + "<button>OK</button>")
        if kind == 6:
            return t("form", ("search", "newsletter", "login", "subscribe"), f"<label>{self.some(1, 3)}</label><input type=text><select><option>{self.some(1, 2)}<option>{self.some(1, 2)}</select><textarea>{self.some(0, 9)}</textarea><button>{self.some(1, 2)}</button>")
        if kind in (7, 8):
            tag = self.one("div", "li", "article")
            comments = "".join(t(tag, ("comment", "reply"), t("div", ("author", "meta"), self.some(1, 3)) + "".join(t("p", (), self.inline(self.some(5, 60))) for _ in range(self.rng.integers(1, 3)))) for _ in range(self.rng.integers(1, 7)))
            return t(self.one("section", "div", "ol" if tag == "li" else "div"), ("comments", "comment-list", "respond", "discussion"), self.one("", t("h3", (), self.some(1, 3))) + comments)
        if kind == 9:
            return t("div", ("share", "social", "tags", "pagination", "toolbar", "follow"), self.links(2, 6))
        if kind == 10:
            return self.one(f"<noscript>{self.some(3, 12)}</noscript>", f"<iframe>{self.some(1, 3)}</iframe>", f'<script>var t="</p>{self.some(1, 3)}";</script>', f"<style>.{self.one(*self.words)}{{color:red}}</style>")
        return t("section", ("related", "more", "recommended", "promo"), t("h2", (), self.some(1, 4)) + "".join(t("div", (), f'<a href="/r">{self.some(3, 9)}</a>' + t("p", (), self.some(5, 20))) for _ in range(self.rng.integers(1, 5))))

    def block(self) -> str:
        t, kind = self.tag, self.rng.integers(14)
        if kind < 8:
            return t("p", (), self.inline(self.some(3, 90)), 1)
        if kind == 8:
            return t(self.one("h2", "h3", "h4"), (), self.some(1, 8), 1)
        if kind == 9:
            return t(self.one("ul", "ol"), (), "".join(t("li", (), self.inline(self.some(2, 20)), 1) for _ in range(self.rng.integers(2, 7))), 1)
        if kind == 10:
            return t("blockquote", (), self.one(self.some(5, 40), t("p", (), self.some(5, 40), 1)), 1)
        if kind == 11:
            return t("pre", (), self.some(3, 30), 1)
        if kind == 12:
            rows = "".join(t("tr", (), "".join(t("td", (), self.some(1, 5), 1) for _ in range(3)), 1) for _ in range(self.rng.integers(2, 6)))
            return t("table", (), t("tbody", (), rows, 1), 1)
        return t("figure", (), "<img src=x>" + t("figcaption", (), self.some(2, 12), 1), 1)

    def page(self) -> str:
        t = self.tag
        blocks = [self.block() for _ in range(self.rng.integers(1, 20))]
        if self.chance(0.7):
            blocks = [t("p", (), self.inline(self.some(20, 120)), 1) for _ in range(self.rng.integers(1, 12))]
        if self.chance(0.8):
            blocks.insert(0, t("h1", (), self.some(2, 12), 1))
        if self.chance(0.15):
            blocks = [self.some(20, 200) + "<br><br>" + self.some(10, 80)]
        if self.chance(0.15):
            blocks = [t("h1", (), self.some(1, 8), 1), *(t("p", (), self.inline(self.some(1, 8)), 1) for _ in range(self.rng.integers(1, 3)))]
        for _ in range(self.rng.integers(0, 3)):
            blocks.insert(int(self.rng.integers(len(blocks) + 1)), self.boiler())
        body = "".join(blocks)
        layout = self.rng.integers(6)
        if layout < 3:
            body = t("article", self.one((), ("post", "entry", "article")), body, 1)
        elif layout == 3:
            body = t("main", (), body, 1)
        elif layout == 4:
            body = t("div", ("content", "post-content", "entry-body", "article-text", "story", "main"), body, 1)
        else:
            body = t("section", (), t("div", ("content", "text", "main"), body, 1), 1)
        around = [self.boiler() for _ in range(self.rng.integers(1, 8))]
        cut = int(self.rng.integers(len(around) + 1))
        whole = "".join(around[:cut]) + body + "".join(around[cut:])
        for _ in range(self.rng.integers(0, 3)):
            whole = t("div", ("page", "wrapper", "container", "layout", "main"), whole)
        if self.chance(0.1):
            whole = f"<table><tr><td>{self.links()}<td>{whole}</table>"
        head = f"<!DOCTYPE html><html><head><title>{self.some(2, 9)}</title><style>p{{margin:0}}</style><script>a()</script></head><body>"
        return head + whole + self.one("</body></html>", "")


MARK = ' data-truth="1"'


def marked(page: Page) -> np.ndarray:
    """1 for the blocks that the writer of a made-up page marked as main text."""
    return np.array([int(MARK in a) for a in page.attrs])


def training_pages(pages: int = 500, seed: int = 11) -> list[str]:
    writer = Writer(np.random.default_rng(seed))
    return [writer.page() for _ in range(pages)]


def fit(pages: int = 1200, seed: int = 11) -> Boosted:
    """Boosted trees from made-up pages."""
    x, y = [], []
    for source in training_pages(pages, seed):
        page = Page(source)
        x.append(page.features())
        y.append(marked(page))
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(float))


_fitted: dict[tuple[int, int], Boosted] = {}


def fit_on_cluster(spark: SparkSession, pages: int = 1200, seed: int = 11) -> Boosted:
    """fit() in one task of the cluster; kept by the driver, since its pages are always the same."""
    if (pages, seed) not in _fitted:
        ship(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pages, seed))])], ["model"])

        _fitted[pages, seed] = pickle.loads(spark.range(1).coalesce(1).mapInArrow(run, "model binary").first()["model"])
    return _fitted[pages, seed]


def main_texts(sources: list[str | None], model: Boosted) -> Iterator[str]:
    pages = [Page(s or "") for s in sources]
    rows = [p.features() for p in pages]
    odds = model.predict(np.concatenate(rows)) if rows else np.empty(0)
    at = 0
    for page, x in zip(pages, rows):
        p = odds[at : at + len(x)]
        at += len(x)
        yield page.text(decode(page.parent, p, 1 + np.minimum(np.expm1(x[:, 0]), 2000) / 400))


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model or fit_on_cluster(spark))  # some thousand numbers

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = list(main_texts(part.column(2).to_pylist(), sent.value))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
