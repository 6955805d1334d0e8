"""Main text of HTML pages by a tree-structured graphical model.

The page is parsed into a tree whose leaves are text blocks (text between the borders of block elements). Every node has a hidden label:
boilerplate, content, or frame (it holds content but is none itself). A node's own evidence is the likelihood of each label under logistic
models over its tag, the words of its class, id and role, its text and its link density; parent and child are tied by a 3 x 3
potential for each kind of child. Sum-product
messages run once upward and once downward and give every node's exact marginal; blocks whose content marginal is at least 1/2 are the
main text. Evidence and potentials are learned from labelled pages: ``labelled_page`` writes pages of many layouts from a
seed, with the label of every element known. ``fit`` takes any labelled trees.

Scale: one row-wise pass without a shuffle over whole pages; a task holds one Arrow batch and one page's tree. The model (a few
hundred numbers) travels with the tasks. Parsing, messages and output are linear in the page and use no recursion: the page is cut
into tags and text by one forward scan, and the open elements are indexed by name, so neither unclosed tags nor deep nesting are
walked again and again.

Defined results: null or empty html, and pages without content, give an empty text and 0; repeated rows give repeated rows; an empty
table an empty result; other columns do not matter. Omitted head and body tags are implied; a comment or tag that never ends takes the
rest of the page. Never text are HIDDEN elements (scripts, styles, the head, vector graphics, lists to choose from, frames) and the
annotations of formulas; what noscript, object, canvas, audio, video and math hold is judged as any other text. Character references are
decoded, white space inside a block becomes one space, blocks are joined in page order by two line feeds; nothing else is dropped or cut.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template head title svg iframe noframes noembed select datalist annotation annotation-xml".split())
#: Elements that may stand in the head; any other ends it.
IN_HEAD = frozenset("head title base basefont bgsound link meta script style noscript noframes template".split())
#: Elements whose content holds no tags; in the last two character references are decoded.
RAW = frozenset("script style iframe noframes noembed xmp title textarea".split())
DECODED = frozenset("title textarea".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul option legend".split()
)
CLOSES_P = BLOCK - frozenset("html body caption tbody thead tfoot tr td th option legend".split())
#: An opening tag ends these open elements, up to the nearest of the borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}

KINDS = ["block", "html", "body", "article", "main", "section", "div", "p", "heading", "list", "li", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "figure", "inline", "other"]
_KIND_OF = {
    **{t: t for t in ("html", "body", "article", "main", "section", "div", "p", "li", "nav", "header", "footer", "aside", "form")},
    **{f"h{i}": "heading" for i in range(1, 7)}, **{t: "list" for t in ("ul", "ol", "dl", "menu", "dir")}, "dt": "li", "dd": "li",
    **{t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr")}, "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure",
    **{t: "form" for t in ("fieldset", "button", "label", "input", "textarea", "legend", "search", "dialog")},
    **{t: "inline" for t in ("a", "b", "i", "em", "strong", "span", "u", "small", "code", "sub", "sup", "mark", "time", "font", "abbr", "cite", "q")},
    **{t: "other" for t in HIDDEN},
}
KIND = {t: KINDS.index(k) for t, k in _KIND_OF.items()}
OTHER = KINDS.index("inline")  # of elements without a kind: they pass their parent's label on
#: Words of class, id and role attributes, by what they tell of a node.
HINTS = {
    "content": "content article post entry story main body text prose maincontent articlebody bodytext page copy",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs links skip",
    "header": "header masthead banner topbar hero logo branding top",
    "footer": "footer bottom copyright colophon legal foot",
    "sidebar": "sidebar aside widget widgets rail complementary secondary side column",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion commercial adsense dfp",
    "notice": "cookie cookies consent notice alert newsletter subscribe popup modal overlay gdpr message warning toast signup paywall",
    "comment": "comment comments reply replies disqus respond discussion reader readers thread",
    "extra": "share social related recommended tags meta byline more trending popular teaser follow rating",
    "form": "search login form contact input signin register",
}
HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws.split()}
BOILERPLATE, CONTENT, FRAME = range(3)
LABELS = 3
N_FEATURES = len(KINDS) + len(HINTS) + 9
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)  # bit set over HINTS
    text: list[str] = field(default_factory=list)  # of blocks
    linked: list[int] = field(default_factory=list)  # characters inside links, of blocks
    mark: list[str | None] = field(default_factory=list)  # the label attribute, on training pages

    def add(self, tag: str, parent: int, hints: int = 0, text: str = "", linked: int = 0, mark: str | None = None) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.hints, hints), (self.text, text), (self.linked, linked), (self.mark, mark)):
            column.append(value)
        return len(self.tag) - 1


_TAG_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*+")
#: The end of a tag, or one more attribute: its name, then its value in double, single or no quotes.
_ATTRIBUTE = re.compile(r"""[ \t\n\f\r/]*+(?:(/?>)|([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^ \t\n\f\r>]*+)))?+)""")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])", re.I) for t in RAW}
_COMMENT_END = re.compile(r"--!?>")


class _Builder:
    """Cuts a page into tags and text in one scan and builds its tree."""

    def __init__(self):
        self.tree = Tree()
        self.open = [self.tree.add("html", -1)]
        self.names = ["html"]
        self.where: dict[str, list[int]] = defaultdict(list)  # depths at which elements of a name are open
        self.blocks = [0]  # depths of the open block elements
        self.hidden = 0
        self.links = 0
        self.piece: list[str] = []
        self.linked = 0
        self.home = 0

    def feed(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.text(html[at:lt])
            if lt == n:
                return
            following = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt) + 1
                else:
                    end = _COMMENT_END.search(html, lt + 4)
                    at = end.end() if end else n
            elif following in ("!", "?") or (following == "/" and not _TAG_NAME.match(html, lt + 2)):
                if following == "/" and lt + 2 >= n:
                    self.text("</")
                end = html.find(">", lt)
                at = end + 1 if end >= 0 else n
            elif m := _TAG_NAME.match(html, lt + (2 if following == "/" else 1)):
                name = m.group().lower()
                at, attributes = self.attributes(html, m.end())
                if attributes is None:
                    return  # the tag never ends
                if following == "/":
                    self.end_tag(name)
                    continue
                self.start_tag(name, attributes, html.startswith("/>", at - 2))
                if name in RAW and self.names[-1] == name:
                    end = _RAW_END[name].search(html, at)
                    stop = end.start() if end else n
                    self.text(html[at:stop], name in DECODED)
                    at = stop
                elif name == "plaintext":
                    self.text(html[at:], False)
                    return
            else:
                self.text("<")
                at = lt + 1

    @staticmethod
    def attributes(html: str, at: int) -> tuple[int, list[tuple[str, str]] | None]:
        """Where the tag ends and its attributes; None if it never ends. A quote that is never closed ends with the tag."""
        out = []
        while m := _ATTRIBUTE.match(html, at):
            at = m.end()
            if m.group(1):
                return at, out
            if html.startswith("=", at):  # an opening quote without its end
                at = html.find(">", at)
                return (at + 1, out) if at >= 0 else (len(html), None)
            value = m.group(3) or m.group(4) or m.group(5) or ""
            out.append((m.group(2).lower(), unescape(value) if "&" in value else value))
        return len(html), None

    def flush(self) -> None:
        """Closes the block that is being read."""
        if self.piece:
            text = " ".join("".join(self.piece).split())
            if text:
                self.tree.add("block", self.home, text=text, linked=min(self.linked, len(text)))
            self.piece, self.linked = [], 0

    def shut(self, depth: int) -> None:
        """Closes all elements from depth on."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.open.pop()
            self.where[name].pop()
            if name in BLOCK:
                self.flush()
                self.blocks.pop()
            self.hidden -= name in HIDDEN
            self.links -= name == "a"

    def nearest(self, names) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self.where[x][-1] for x in names if self.where[x]), default=0)

    def end_open(self, ends, borders) -> None:
        while (d := self.nearest(ends)) and d > self.nearest(borders):
            self.shut(d)

    def leave_head(self) -> None:
        if (d := self.nearest(("head",))) and d > self.nearest(("template",)):
            self.shut(d)

    def start_tag(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if tag == "html":
            return
        if tag not in IN_HEAD:
            if self.where["head"]:
                self.leave_head()
            if len(self.names) == 1 and tag != "body":
                self.enter("body", 0, None)
            elif tag == "body" and self.where["body"]:
                return
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in CLOSES_P and self.names[self.blocks[-1]] == "p" and self.blocks[-1] > self.nearest(("button", "object")):
            self.shut(self.blocks[-1])
        if tag == "br" and not self.hidden:
            self.begin()
            self.piece.append(" ")
        if tag in VOID or (closed and (self.where["math"] or self.where["svg"])):
            if tag == "hr":
                self.flush()
            return
        if tag == "a" and self.links and self.where["a"][-1] > self.blocks[-1]:
            self.shut(self.where["a"][-1])
        if tag in BLOCK:
            self.flush()
        hints, mark = 0, None
        for k, v in attributes:
            if k in ("class", "id", "role", "itemprop") and v:
                for w in _TOKEN.findall(v):
                    if (h := HINT_OF.get(w.lower())) is not None:
                        hints |= 1 << h
            elif k == "data-label":
                mark = v
        self.enter(tag, hints, mark)

    def enter(self, tag: str, hints: int, mark: str | None) -> None:
        depth = len(self.names)
        self.open.append(self.tree.add(tag, self.open[-1], hints, mark=mark))
        self.names.append(tag)
        self.where[tag].append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def end_tag(self, tag: str) -> None:
        if tag not in ("html", "body") and tag not in VOID and self.where[tag]:
            self.shut(self.where[tag][-1])

    def begin(self) -> None:
        """Hangs what follows under the innermost block element, if a block begins here."""
        if not self.piece:
            self.home = self.open[self.blocks[-1]]

    def text(self, data: str, decoded: bool = True) -> None:
        if self.names[-1] in ("head", "html") and not data.isspace():
            self.leave_head()
            if len(self.names) == 1:
                self.enter("body", 0, None)
        if self.hidden:
            return
        if decoded and "&" in data:
            data = unescape(data)
        self.begin()
        self.piece.append(data)
        if self.links:
            self.linked += len(data.strip())


def parse(html: str) -> Tree:
    b = _Builder()
    b.feed(html)
    b.shut(1)
    b.flush()
    return b.tree


def node_features(t: Tree) -> np.ndarray:
    """Evidence of each node; sums over subtrees run from the last node to the first."""
    n = len(t.tag)
    chars, linked, blocks, stops, long = ([0] * n for _ in range(5))
    for i in range(n):
        if t.tag[i] == "block":
            s = t.text[i]
            chars[i], linked[i], blocks[i] = len(s), t.linked[i], 1
            stops[i] = s.count(". ") + s.count(", ") + (s[-1:] in ".!?")
            long[i] = int(len(s) > 80)
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        for c in (chars, linked, blocks, stops, long):
            c[p] += c[i]
    x = np.zeros((n, N_FEATURES))
    rows = np.arange(n)
    x[rows, [KIND.get(g, OTHER) if g != "block" else 0 for g in t.tag]] = 1
    hints = np.array(t.hints)
    for k in range(len(HINTS)):
        x[:, len(KINDS) + k] = hints >> k & 1
    c, li, b, st, lo = (np.array(v, float) for v in (chars, linked, blocks, stops, long))
    at = len(KINDS) + len(HINTS)
    density = li / np.maximum(c, 1)
    many = np.array([x in ("li", "a") for x in t.tag], float)
    x[:, at : at + 9] = np.stack(
        [np.log1p(c) / 6, density, density > 0.5, np.log1p(c / np.maximum(b, 1)) / 6, st / np.maximum(c / 60, 1), lo / np.maximum(b, 1), c == 0, many * density, np.ones(n)], axis=1
    )
    return x


@dataclass
class Model:
    weights: np.ndarray  # feature, label: log odds less the prior's
    ties: np.ndarray  # kind of the child, label of the parent, label of the child: potentials
    root: np.ndarray  # label

    def marginals(self, t: Tree) -> list[float]:
        """Probability of content for each node by one upward and one downward pass."""
        odds = np.clip(node_features(t) @ self.weights, -8, 8)
        return [p[CONTENT] for p in sum_product(t.parent, np.exp(odds).tolist(), [self.ties[kind_of(g)].tolist() for g in t.tag], self.root.tolist())]


def kind_of(tag: str) -> int:
    return 0 if tag == "block" else KIND.get(tag, OTHER)


def _scaled(v: list[float]) -> list[float]:
    top = max(v)
    return [x / top for x in v]


def sum_product(parent: list[int], evidence: list[list[float]], ties: list[list[list[float]]], root: list[float]) -> list[list[float]]:
    """Exact marginals of all labels in a tree whose parents precede their children; ties[i][label of the parent][label of i]."""
    n, labels = len(parent), range(len(root))
    below = [list(e) for e in evidence]  # what a node and its subtree say of the node's label
    up: list[list[float]] = [[]] * n
    for i in range(n - 1, 0, -1):
        b, p = below[i], below[parent[i]]
        up[i] = m = [sum(map(float.__mul__, row, b)) for row in ties[i]]
        below[parent[i]] = _scaled([p[k] * m[k] for k in labels])
    above: list[list[float]] = [root] * n  # what the rest of the tree says of it
    out = []
    for i in range(n):
        if i:
            p = parent[i]
            rest = _scaled([above[p][k] * below[p][k] / up[i][k] for k in labels])
            t = ties[i]
            above[i] = _scaled([sum(rest[k] * t[k][c] for k in labels) for c in labels])
        mass = [above[i][k] * below[i][k] for k in labels]
        total = sum(mass)
        out.append([x / total for x in mass])
    return out


def labels_of(t: Tree) -> np.ndarray:
    """CONTENT or BOILERPLATE by the nearest mark above or at a node; unmarked nodes that hold content are FRAME."""
    out = np.full(len(t.tag), BOILERPLATE)
    for i in range(len(t.tag)):
        if t.mark[i] is not None:
            out[i] = CONTENT if t.mark[i] == "1" else BOILERPLATE
        elif i and t.parent[i] >= 0 and out[t.parent[i]] == CONTENT:
            out[i] = CONTENT
    for i in range(len(t.tag) - 1, 0, -1):
        p = t.parent[i]
        if out[i] != BOILERPLATE and out[p] == BOILERPLATE and t.mark[p] is None:
            out[p] = FRAME
    return out


def fit(trees: list[Tree], steps: int = 12, ridge: float = 0.5, share: float = 0.3) -> Model:
    """Logistic evidence for each label (Newton steps) without its prior, and tied potentials from counts of (parent, child) labels.

    Nested nodes repeat each other's evidence, so each gives only a share of it.
    """
    x, y = np.concatenate([node_features(t) for t in trees]), np.concatenate([labels_of(t) for t in trees])
    weights = np.zeros((x.shape[1], LABELS))
    for k in range(LABELS):
        w, one = np.zeros(x.shape[1]), (y == k).astype(float)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w += np.linalg.solve(h, x.T @ (one - p) - ridge * w)
        w[-1] -= math.log((one.mean() + 1e-6) / (1 - one.mean() + 1e-6))  # the last feature is constant
        weights[:, k] = share * w
    ties = np.full((len(KINDS), LABELS, LABELS), 0.5)
    for t in trees:
        lab = labels_of(t)
        for i in range(1, len(t.tag)):
            ties[kind_of(t.tag[i]), lab[t.parent[i]], lab[i]] += 1
    ties /= ties.sum(2, keepdims=True)
    root = np.full(LABELS, 0.02)
    root[FRAME] = 0.9
    return Model(weights, ties, root)


def _sentence(rng: random.Random, n: int | None = None) -> str:
    words = ["".join(rng.choice("aeioubcdfglmnprstv") for _ in range(rng.randrange(2, 9))) for _ in range(n or rng.randrange(5, 22))]
    if len(words) > 6 and rng.random() < 0.6:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + "."


def _mark(rng: random.Random, name: str, hints: list[str], label: int, inner: str, plain: float = 0.25) -> str:
    """An element with a telling tag or attribute, most of the time."""
    attr = "" if not hints or rng.random() < plain else f' {rng.choice(("class", "id"))}="{rng.choice(hints)}"'
    return f'<{name}{attr} data-label="{label}">{inner}</{name}>'


def labelled_page(rng: random.Random) -> str:
    """A page whose elements say in data-label whether they are content (the nearest mark above holds)."""
    s = lambda n=None: _sentence(rng, n)
    link = lambda: f'<a href="/x">{s(rng.randrange(1, 4))[:-1]}</a>'
    para = lambda: f"<p>{s(rng.randrange(1, 5)) if rng.random() < 0.2 else ' '.join(s() for _ in range(rng.randrange(1, 6)))}</p>"
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 8))) + "</ul>"

    def menu():
        name = rng.choice(("nav", "nav", "div", "ul"))
        inner = listed() if name != "ul" else "".join(f"<li>{link()}</li>" for _ in range(5))
        return _mark(rng, name, ["menu", "nav", "main-nav", "navbar", "breadcrumb", "top-links"], 0, inner, 0.6 if name == "nav" else 0.2)

    def advert():
        return _mark(rng, rng.choice(("div", "div", "aside", "section")), ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad"], 0, s() + rng.choice(("", link(), para())), 0.02)

    def notice():
        return _mark(rng, rng.choice(("div", "section", "aside", "p")), ["cookie-notice", "notice", "consent", "alert", "newsletter", "gdpr-banner", "message"], 0, rng.choice((s(), s() + " " + s(), f"<p>{s()}</p><button>{s(1)}</button>")), 0.03)

    def sidebar():
        return _mark(rng, rng.choice(("aside", "aside", "div")), ["sidebar", "side", "widget", "right-rail"], 0, rng.choice((f"<h3>{s(2)}</h3>{listed()}", para(), f"<h4>{s(2)}</h4><p>{s()}</p>")), 0.05)

    def header():
        return _mark(rng, rng.choice(("header", "header", "div")), ["header", "masthead", "site-header", "topbar"], 0, rng.choice((f"<h1>{s(3)}</h1>", f"<p>{s(4)}</p>", f"<div>{link()}</div>{menu()}", s(3))), 0.05)

    def footer():
        return _mark(rng, rng.choice(("footer", "footer", "div")), ["footer", "site-footer", "copyright", "bottom"], 0, rng.choice((f"&copy; site &middot; {s()}", f"<p>&copy; {s()}</p>{listed()}", f"<p>{s()} {s()}</p>")), 0.05)

    def form():
        return f'<form data-label="0"><label>{s(2)}</label><input name="q"><button>{s(1)}</button>{rng.choice(("", f"<p>{s()}</p>", f"<textarea>{s()}</textarea>"))}</form>'

    def comments():
        one = lambda: f'<{(k := rng.choice(("div", "li", "article", "p")))} class="{rng.choice(("comment", "reply", "comment-body"))}">{rng.choice((s() + " " + s(), para() if k != "p" else s()))}</{k}>'
        return _mark(rng, rng.choice(("section", "div", "ol")), ["comments", "comment-list", "disqus", "discussion", "reader-comments"], 0, rng.choice(("", f"<h3>{s(2)}</h3>")) + "".join(one() for _ in range(rng.randrange(1, 5))), 0.05)

    def extra():
        return _mark(rng, rng.choice(("div", "ul", "section")), ["share", "related", "social", "tags", "recommended", "byline-meta"], 0, listed() if rng.random() < 0.6 else link(), 0.1)

    body = []
    if rng.random() < 0.8:
        body.append(f"<h{(k := rng.choice((1, 1, 1, 2)))}>{s(rng.randrange(2, 9))}</h{k}>")
    for _ in range(rng.randrange(1, 10)):
        body.append(
            rng.choices(
                (para(), f"<p><b>{s(rng.choice((1, 3, 12)))}<br><p>{s()}</p>", f"<h2>{s(3)}</h2>", f"<ul><li>{s()}</li><li>{s()}</li></ul>", f"<blockquote><p>{s()}</p></blockquote>", f"<table><tr><td>{s(2)}</td><td>{s(3)}</td></tr></table>", f"<div>{s()} {s()}</div>", f"<p>{s(6)} {link()} {s()}</p>", f"<pre>{s()}</pre>", f"<figure><img src=x><figcaption>{s(5)}</figcaption></figure>"),
                (12, 2, 3, 2, 1, 1, 2, 2, 1, 1),
            )[0]
        )
        if rng.random() < 0.1:
            body.append(rng.choice((advert, extra, notice, form))())
    if rng.random() < 0.15:
        body.append(comments())
    bare = rng.random() < 0.1  # the article's parts stand in the body itself
    inner = " ".join(s() for _ in range(rng.randrange(1, 8))) if bare and rng.random() < 0.4 else "".join(body)
    main = inner if bare else _mark(rng, rng.choice(("article", "article", "article", "main", "div", "section", "td")), ["content", "post", "article-body", "entry-content", "story", "main-content"], 1, inner, 0.5)
    if bare:
        pass
    elif "<td" in main[:4]:
        main = f"<table><tr>{main}</tr></table>"
    elif rng.random() < 0.3:
        main = f'<div class="{rng.choice(("wrap", "container", "page", "row"))}">{main}</div>'
    before = [f() for f in (header, menu, advert, notice, form, sidebar) if rng.random() < 0.45]
    after = [f() for f in (comments, sidebar, extra, advert, notice, form, footer, footer) if rng.random() < 0.4]
    rng.shuffle(before)
    return f"<!DOCTYPE html><html><head><title>{s(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body{' data-label="1"' if bare else ""}>{''.join(before)}{main}{''.join(after)}</body></html>"


@lru_cache(maxsize=1)
def model(pages: int = 500, seed: int = 3) -> Model:
    """Trained once in the driver on pages written from a seed."""
    rng = random.Random(seed)
    return fit([parse(labelled_page(rng)) for _ in range(pages)])


def blocks_of(t: Tree, m: Model) -> list[str]:
    return [s for s, tag, p in zip(t.text, t.tag, m.marginals(t), strict=True) if tag == "block" and p >= 0.5]


def main_text(html: str | None, m: Model) -> str:
    return "\n\n".join(blocks_of(parse(html), m)) if html else ""


SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, url, html): its main text (SCHEMA)."""
    bounded_batches(pages.sparkSession)
    m = model()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [blocks_of(parse(h), m) if (h := x.as_py()) else [] for x in part.column(2)]
                texts = ["\n\n".join(f) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(f) for f in found], pa.int64())], schema=out)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
