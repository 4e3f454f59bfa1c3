"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Nodes are block elements. A node is positive if main text is anywhere below it, so an ancestor of a positive node
is positive too; decoding takes the likeliest labelling that keeps this order, bottom up and then top down. The
trees are trained on pages from a generator that lays out articles and furniture in many ways, and stored beside
this module.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veridex.llm.common import mapped, ship

# --- parsing ---------------------------------------------------------------------------------

BLOCKS = "html body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset details summary address center dialog menu".split()
#: Elements whose content is never text of the page.
SKIPPED = frozenset("head script style noscript template title svg math iframe object select button textarea canvas audio video datalist xmp noembed noframes".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Start tags that a head may hold; any other ends it.
_IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template noframes".split())
_OPENINGS = re.compile(r"<(/?)(noscript|template|svg|math|object|select|button|canvas|audio|video|datalist)(?=[\s/>])", re.I)
_NESTING = frozenset(("template", "svg", "math", "object"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG_ID = {t: i for i, t in enumerate(BLOCKS)}
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag closes first, and where the search for it ends.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",))}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag with its quotes; possessive, so that it never goes back.
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.!?,;:]")
#: Kinds of attribute tokens.
KINDS = {
    "main": "article content main post entry story body text prose blog page single hentry column",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs crumbs topnav links pager pagination toc tabs",
    "head": "header masthead banner top topbar logo branding hero",
    "foot": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar aside side related rail widget widgets recommended more popular secondary trending archive",
    "comment": "comment comments reply replies discussion respond disqus thread responses feedback",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp teaser",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay warning privacy announcement paywall",
    "form": "form search login signup subscribe newsletter contact input register",
    "share": "share sharing social tags tag meta byline author date follow print tools",
    "hidden": "hidden none invisible",
}
_KIND = {w: 1 << k for k, words in enumerate(KINDS.values()) for w in words.split()}


@dataclass
class Dom:
    """Nodes of one or more pages, in page order; and pieces of text: (run, node, text, in a link)."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)  # inline tags directly in the node
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    pieces: list[list[tuple[int, int, str]]] = field(default_factory=list)

    def node(self, page: int, parent: int, tag: str, depth: int, attributes: str) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(_TAG_ID[tag])
        self.depth.append(depth)
        self.kinds.append(attribute_kinds(attributes) if attributes else 0)
        for x in (self.inline, self.own, self.linked, self.stops):
            x.append(0)
        return len(self.page) - 1

    def add(self, html: str) -> None:
        """Parse one page."""
        page, pieces = len(self.pieces), []
        self.pieces.append(pieces)
        stack = [("html", self.node(page, -1, "html", 0, ""))]
        skip: list[str] = []  # open elements without text
        inner: list[str] = []  # blocks open in them
        opened, inside = Counter(), Counter()  # how many of each name are on the stack, and in inner
        ended: set[int] | None = None  # where elements start that have an end tag
        loose = False  # the outermost open element without text has no end tag
        run, link, at, n = 0, False, 0, len(html)

        def text(a: int, b: int) -> None:
            if skip == ["head"] and b > a and not html[a:b].isspace():
                skip.clear()  # text can't be in a head
            if b > a and not skip:
                s = html[a:b]
                k = stack[-1][1]
                pieces.append((run, k, s))
                size = len(s) if "  " not in s and "\n" not in s else len(" ".join(s.split()))
                if size and not s.isspace():
                    self.own[k] += size
                    self.linked[k] += size if link else 0
                    self.stops[k] += len(_STOPS.findall(s))

        def close(k: int) -> None:
            """Take the stack's elements from the k-th on away."""
            for t, _ in stack[k:]:
                opened[t] -= 1
            del stack[k:]

        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                break
            m = _NAME.match(html, lt)
            if m is None and html.startswith(("<!", "<?"), lt):
                text(at, lt)
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + (4 if comment else 2))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            gt = -1 if m is None else html.find(">", m.end())
            if gt < 0:  # a bare '<' is text
                nxt = html.find("<", lt + 1) if m is None else n
                text(at, nxt if nxt > 0 else n)
                at = nxt if nxt > 0 else n
                continue
            text(at, lt)
            if html.find('"', m.end(), gt) >= 0 or html.find("'", m.end(), gt) >= 0:
                rest = _REST.match(html, m.end())
                gt = rest.end() - 1 if rest else gt  # quotes that don't close are not quotes
            attributes, at = html[m.end() : gt], gt + 1
            name = m[2]
            name, closing = name.lower(), bool(m[1])
            if skip and skip[0] == "head" and (name not in _IN_HEAD if not closing else name in ("body", "html")) and (len(skip) == 1 or loose):
                skip.clear()
            if name in SKIPPED:
                if closing:
                    if name in skip:
                        del skip[skip.index(name) :]
                elif name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = end.start() if end else n
                    if end:
                        gt = html.find(">", at)
                        at = gt + 1 if gt >= 0 else n
                elif not attributes.rstrip().endswith("/"):
                    if ended is None:
                        ended = _ended(html)
                    if not skip:
                        inner.clear()
                        inside.clear()
                    if not skip or skip == ["head"]:
                        loose = name != "head" and lt not in ended
                    if name == "head" or lt in ended or not skip or skip == ["head"]:
                        skip.append(name)
                run += 1
                continue
            if name == "body" and not closing:
                skip.clear()
            if skip and name in _TAG_ID and skip[0] != "head":
                if closing and inside[name]:
                    while (last := inner.pop()) != name:
                        inside[last] -= 1
                    inside[name] -= 1
                elif loose or closing and opened[name] or not closing and skip[0] in ("svg", "math") and not inside["foreignobject"]:
                    skip.clear()  # a block ends what it encloses, and what can't hold it
                elif not closing:
                    inner.append(name)
                    inside[name] += 1
            elif skip and name == "foreignobject" and not closing:
                inner.append(name)
                inside[name] += 1
            if skip:
                continue
            if name not in _TAG_ID:
                if name == "a":
                    link = not closing
                elif name in ("br", "hr"):
                    run += 1
                if not closing:
                    self.inline[stack[-1][1]] += 1
                continue
            run += 1
            if closing:
                if opened[name]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                    link = False
                continue
            if name in ("html",):
                continue
            if stack[-1][0] == "p" or name in _HEADING and stack[-1][0] in _HEADING:
                close(len(stack) - 1)
            if name in _CLOSES and any(opened[t] for t in _CLOSES[name][0]):
                closes, ends = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        break
                    if stack[k][0] in closes:
                        close(k)
                        break
            link = False
            opened[name] += 1
            stack.append((name, self.node(page, stack[-1][1], name, len(stack), attributes)))
        else:
            return
        text(at, n)


def _ended(html: str) -> set[int]:
    """Where the elements without text start that have an end tag of their own."""
    out, opened = set(), {}
    for m in _OPENINGS.finditer(html):
        name = m[2].lower()
        starts = opened.setdefault(name, [])
        if not m[1]:
            if name not in _NESTING:
                starts.clear()  # can't hold itself: the earlier one was never ended
            starts.append(m.start())
        elif starts:
            out.add(starts.pop())
    return out


def attribute_kinds(attributes: str) -> int:
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            out |= _KIND["hidden"]
        if name.lower() == "style" and "none" not in value:
            continue
        for part in _PART.findall(value):
            out |= _KIND.get(part.lower()) or _KIND.get(part.lower().rstrip("s"), 0)
    return out


# --- features --------------------------------------------------------------------------------

_TAGS_USED = [_TAG_ID[t] for t in "article section main nav header footer aside div p ul li table td blockquote pre form figure".split()]
_HEADS = np.array([_TAG_ID[h] for h in sorted(_HEADING)])


class Arrays:
    """Dom as arrays, with the nodes of each depth."""

    def __init__(self, dom: Dom):
        self.page, self.parent, self.tag, self.depth, self.kinds, self.inline, self.own, self.linked, self.stops = (np.array(x, np.int64) for x in (dom.page, dom.parent, dom.tag, dom.depth, dom.kinds, dom.inline, dom.own, dom.linked, dom.stops))
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.astype(np.float64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def features(self) -> np.ndarray:
        n = len(self.page)
        root = np.flatnonzero(self.parent < 0)[self.page]
        up = np.maximum(self.parent, 0)
        text, links, stops, size, inline = (self.up(x) for x in (self.own, self.linked, self.stops, np.ones(n), self.inline))
        paragraphs = self.up(self.tag == _TAG_ID["p"])
        items = self.up(self.tag == _TAG_ID["li"])
        before = np.cumsum(self.own) - self.own
        before = before - before[root]
        total = np.maximum(text[root], 1)
        above = np.zeros(n, np.int64)  # kinds and tags of ancestors
        mark = np.zeros(n, np.int64)
        for k, t in enumerate(("article", "main", "nav", "header", "footer", "aside", "form")):
            mark |= (self.tag == _TAG_ID[t]).astype(np.int64) << (len(KINDS) + k)
        for level in self.levels[1:]:
            p = self.parent[level]
            above[level] = above[p] | self.kinds[p] | mark[p]
        order = np.lexsort((np.arange(n), up, self.parent < 0))
        same = np.zeros(n, bool)
        same[1:] = (up[order[1:]] == up[order[:-1]]) & (self.parent[order[1:]] >= 0)
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - first
        brothers = np.bincount(up, self.parent >= 0, n)[up]
        alike = np.zeros(n)
        key = up * 64 + self.tag
        _, code, count = np.unique(key, return_inverse=True, return_counts=True)
        alike = count[code] / np.maximum(brothers, 1)
        left, right = np.zeros(n), np.zeros(n)
        left[order[1:]] = np.where(same[1:], text[order[:-1]], 0)
        right[order[:-1]] = np.where(same[1:], text[order[1:]], 0)
        words = text / 6
        cols = [
            self.depth, np.log1p(self.own), np.log1p(text), links / np.maximum(text, 1), np.log1p(size), text / size, text / total, before / total,
            place, brothers, alike, np.log1p(left), np.log1p(right), np.log1p(paragraphs), items / size, stops / np.maximum(words, 1), inline / size,
            links[up] / np.maximum(text[up], 1), text / np.maximum(text[up], 1), self.linked / np.maximum(self.own, 1), np.isin(self.tag, _HEADS),
        ]
        cols += [self.tag == t for t in _TAGS_USED]
        cols += [(self.kinds >> k) & 1 for k in range(len(KINDS))]
        cols += [(above >> k) & 1 for k in range(len(KINDS) + 7)]
        return np.stack([np.asarray(c, np.float32) for c in cols], axis=1)

    def decode(self, margin: np.ndarray) -> np.ndarray:
        """The likeliest labels in which no positive node has a negative ancestor; margin: log odds of positive."""
        best = np.log1p(np.exp(-np.abs(margin)))
        yes, no = np.minimum(margin, 0) - best, np.minimum(-margin, 0) - best
        all_no = self.up(no)
        keep = yes.copy()
        for level in self.levels[:0:-1]:
            np.add.at(keep, self.parent[level], np.maximum(keep[level], all_no[level]))
        label = keep > all_no
        for level in self.levels[1:]:
            label[level] &= label[self.parent[level]]
        return label


# --- gradient-boosted trees ------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: a split's feature and cut at each inner node, a value at each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss with splits at quantiles."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code > k: x > cuts[k]
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    out = np.full(n, base)
    inner = (1 << depth) - 1
    model = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), base)
    flat = (code + np.arange(d) * bins).astype(np.int64)
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            lo, many = (1 << level) - 1, 1 << level
            key = ((at - lo)[:, None] * (d * bins) + flat).ravel()
            gs = np.bincount(key, np.repeat(g, d), many * d * bins).reshape(many, d, bins)
            hs = np.bincount(key, np.repeat(h, d), many * d * bins).reshape(many, d, bins)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    model.feature[t, lo + k], model.cut[t, lo + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), model.feature[t, at]] > model.cut[t, at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        model.leaf[t] = value
        out += value[leaf]
    return model


# --- training pages --------------------------------------------------------------------------


class Generator:
    """Pages with an article between furniture; text of the article is marked by a private character."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, a: int, b: int) -> str:
        n = int(self.r.integers(a, b + 1))
        out = ["".join(self.pick("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "la", "que", "ung") for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        return " ".join(w + ("," if self.chance(0.08) else ". " if self.chance(0.08) else "") for w in out).strip().capitalize() + self.pick(".", ".", "", "!", " &amp;")

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(int(self.r.integers(a, b + 1)))]
        return self.pick("<ul><li>" + "</li><li>".join(items) + "</li></ul>", " | ".join(items), "<ol><li>" + "<li>".join(items) + "</ol>", "<div>" + "</div><div>".join(items) + "</div>")

    def named(self, tag: str, kind: str, body: str, bare: float = 0.15) -> str:
        """An element named by its tag or by a token of its kind."""
        token = self.pick(*KINDS[kind].split())
        token = self.pick(token, f"{token}-{self.pick('box', 'wrap', 'area', 'list', 'block')}", f"site-{token}", f"{token}s", token.capitalize())
        if tag != "div" and self.chance(0.6):
            return f"<{tag}>{body}</{tag}>"
        if self.chance(bare) and tag != "div":
            return f"<{tag}>{body}</{tag}>"
        where = self.pick("class", "class", "id", "role")
        return f'<{self.pick(tag, "div") if tag != "div" else "div"} {where}="{token}">{body}</{tag}>' if tag == "div" else f'<{tag} {where}="{token}">{body}</{tag}>'

    def furniture(self, kind: str) -> str:
        para = lambda a, b: self.pick(f"<p>{self.words(a, b)}</p>", self.words(a, b))
        if kind == "menu":
            return self.named(self.pick("nav", "nav", "div", "ul" if self.chance(0.2) else "div"), "menu", self.links(3, 12))
        if kind == "head":
            return self.named(self.pick("header", "div"), "head", self.pick("", f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>") + para(1, 12) + self.pick("", self.links(2, 6)))
        if kind == "foot":
            return self.named(self.pick("footer", "footer", "div"), "foot", self.pick("&copy; ", "") + para(2, 25) + self.pick("", self.links(2, 8)))
        if kind == "side":
            return self.named(self.pick("aside", "aside", "div"), "side", f"<h{self.pick(2, 3, 4)}>{self.words(1, 4)}</h3>" + self.pick(self.links(3, 9), "".join(para(4, 40) for _ in range(int(self.r.integers(1, 4))))))
        if kind == "comment":
            one = lambda: self.pick(f"<li><b>{self.words(1, 2)}</b> <p>{self.words(5, 60)}</p></li>", f'<div class="comment"><p>{self.words(5, 60)}</p></div>', f"<p>{self.words(5, 60)}</p>")
            return self.named(self.pick("section", "div", "div", "ol"), "comment", self.pick("", f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(int(self.r.integers(1, 9)))), bare=0)
        if kind == "advert":
            return self.named(self.pick("div", "div", "aside"), "advert", para(2, 30) + self.pick("", f'<a href="/x">{self.words(1, 4)}</a>'), bare=0)
        if kind == "notice":
            return self.named(self.pick("div", "div", "section", "dialog"), "notice", para(4, 40) + self.pick("", "<button>OK</button>", '<a href="/p">more</a>'), bare=0)
        if kind == "form":
            body = f"{self.pick('', para(2, 15))}<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>"
            return self.pick(f"<form action=/s>{body}</form>", self.named("div", "form", f"<form>{body}</form>"))
        return self.named(self.pick("div", "p", "ul"), "share", self.links(2, 5))

    def paragraph(self) -> str:
        m = self.MARK
        t = m + self.words(1, self.pick(3, 8, 40, 120))
        if self.chance(0.2):
            t += f" <a href='/y'>{self.words(1, 4)}</a> {self.words(1, 20)}"
        if self.chance(0.25):
            t = f"<b>{t}<br>" if self.chance(0.5) else f"<em>{t}</em>"
        return f"<p>{t}" + ("</p>" if self.chance(0.8) else "")

    def article(self) -> str:
        m, out = self.MARK, []
        if self.chance(0.85):
            out.append(f"<h1>{m}{self.words(2, 14)}</h1>")
        for _ in range(int(self.r.integers(1, self.pick(4, 12, 30)))):
            k = self.r.random()
            if k < 0.75:
                out.append(self.paragraph())
            elif k < 0.82:
                out.append(f"<h{self.pick(2, 3)}>{m}{self.words(1, 8)}</h2>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{m}{self.words(2, 25)}</li>" for _ in range(int(self.r.integers(2, 6)))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif k < 0.95:
                out.append(f"<table><tr><td>{m}{self.words(1, 5)}<td>{m}{self.words(1, 5)}</table>")
            elif k < 0.97:
                out.append(f"<pre>{m}{self.words(5, 40)}</pre>")
            else:
                out.append(self.furniture(self.pick("advert", "share", "notice", "form", "side")))
        return "".join(out)

    def page(self) -> str:
        body = self.article()
        inner = body + "".join(self.furniture(k) for k in ("share", "comment", "side", "form") if self.chance(0.15))
        kind = self.r.random()
        if kind < 0.5:
            core = f"<article>{inner}</article>"
        elif kind < 0.85:
            core = self.named("div", "main", inner)
        else:
            core = self.pick(f"<main>{inner}</main>", f"<section>{inner}</section>", f"<div>{inner}</div>")
        if self.chance(0.3):
            core = self.pick(f'<main id="main">{core}{self.furniture("side") if self.chance(0.4) else ""}</main>', f'<div class="wrapper">{core}</div>', f'<div id="page"><div>{core}</div></div>')
        head = "".join(self.furniture(k) for k in self.r.permutation(["menu", "head", "notice", "advert", "form", "share"]) if self.chance(0.4))
        tail = "".join(self.furniture(k) for k in self.r.permutation(["side", "comment", "advert", "menu", "notice", "form", "foot"]) if self.chance(0.4))
        tail += self.furniture("foot") if self.chance(0.7) else ""
        script = "<script>var t='</p><p>no';</script>" if self.chance(0.5) else ""
        whole = head + script + core + tail
        if self.chance(0.2):
            whole = f'<div class="{self.pick("page", "container", "site", "layout")}">{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{whole}" + ("</body></html>" if self.chance(0.9) else "")


def labelled(pages: list[str]) -> tuple[Arrays, np.ndarray, Dom]:
    """Nodes of generated pages; positive where marked text is below."""
    dom = Dom()
    for p in pages:
        dom.add(p)
    a = Arrays(dom)
    own = np.zeros(len(a.page))
    for pieces in dom.pieces:
        for _, k, s in pieces:
            own[k] += Generator.MARK in s
    return a, (a.up(own) > 0).astype(np.float64), dom


TRAIN_PAGES, SEED = 1200, 20240517


def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    g = Generator(seed)
    a, y, _ = labelled([g.page() for _ in range(pages)])
    return boosted(a.features(), y)


#: The trees that `python -m veridex.llm.html_gbt` writes; it prints how well they do on pages that they weren't trained on.
STORED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_trees.json")


def stored() -> Boosted:
    with open(STORED) as f:
        d = json.load(f)
    cuts = np.array([[np.inf if c is None else c for c in row] for row in d["cut"]], np.float32)
    return Boosted(np.array(d["feature"], np.int64), cuts, np.array(d["leaf"]), d["base"])


def store(model: Boosted) -> None:
    cuts = [[float(c) if np.isfinite(c) else None for c in row] for row in model.cut]
    with open(STORED, "w") as f:
        json.dump({"feature": model.feature.tolist(), "cut": cuts, "leaf": model.leaf.tolist(), "base": model.base}, f)


# --- extraction ------------------------------------------------------------------------------


def extracted(htmls: list[str], model: Boosted) -> list[str]:
    """The main text of each page."""
    dom = Dom()
    for h in htmls:
        dom.add(h)
    a = Arrays(dom)
    keep = a.decode(model.margin(a.features())).tolist()
    out = []
    for pieces in dom.pieces:
        runs, last = [], None
        for run, k, s in pieces:
            if not keep[k]:
                continue
            if run != last:
                runs.append([])
                last = run
            runs[-1].append(s)
        blocks = []
        for r in runs:
            s = "".join(r)
            s = " ".join((unescape(s) if "&" in s else s).split())
            if s:
                blocks.append(s)
        out.append(" ".join(blocks))
    return out


def main_texts(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """pages with text and n_chars (code points) of the main content of `html`.

    Null and empty html, and pages without an article, give an empty text. Broken markup is read as far as it can
    be. Whole pages are read, whatever their length; repeated rows are judged alike. Columns named text or n_chars are
    replaced, others stay.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or stored())
    extra = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def fn(b):
        texts = extracted([h or "" for h in b.column("html").to_pylist()], shared.value)
        texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference can name half a pair
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return mapped(pages, fn, extra, "html")


if __name__ == "__main__":
    made = trained()
    store(made)
    other = Generator(SEED + 1)
    a, y, _ = labelled([other.page() for _ in range(300)])
    label = a.decode(made.margin(a.features()))
    print(f"{(label == (y > 0)).mean():.4f} of the nodes of 300 other pages right")
