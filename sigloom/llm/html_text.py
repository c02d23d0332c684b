"""Main text of web pages by a tree-structured graphical model.

Block elements, and inline ones whose class, id or role words are telling, are nodes with two states, content and not. A node's potential
comes from what it is and holds: tag, class, id and role words, length, links, sentences, headings, depth. A parent and its child
share a potential, one table for each kind of child. One upward and one downward pass of sum-product messages give exact marginals. All
weights are fitted together, by the gradient of the labelled pages' likelihood, which the same messages give.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import small_batches
from sigloom.llm.html_layouts import labelled_pages

_NAMES = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)
_START = re.compile(r"[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"""[>"']""")
_VALUE = re.compile(r"=\s*\Z")
#: Fixed lists: block elements; those whose start closes open ones, and which; elements of raw text; elements whose content isn't text of the page.
BLOCKS = set(
    "html head body div article section main nav header footer aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset "
    "blockquote pre figure figcaption address details summary dialog center hgroup search".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_IMPLIED = {"p", "li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
_RAW = {"script", "style", "title", "textarea"}
_DROPPED = {"noscript", "template", "svg", "iframe", "select", "button", "object"}
_VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS = re.compile("</(" + "|".join(sorted(_DROPPED)) + r")(?=[\s/>])", re.I)
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in _RAW}
#: Fixed lists: words of class, id and role attributes that say alike things.
HINTS = {
    "ad": "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion outbrain taboola commercial dfp",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar toc skip",
    "foot": "footer foot copyright colophon contentinfo imprint",
    "head": "header head masthead topbar logo",
    "side": "sidebar side aside related recommended widget rail complementary trending sharing social tags",
    "talk": "comment comments commentlist reply replies respond disqus reactions",
    "note": "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup alert paywall login form search dialog banner",
    "text": "article content post entry story text main body prose",
}
#: Fixed list: words beside a telling one that take nothing from it.
_SHELL = set("box slot wrap wrapper container block area list item items unit inner outer button buttons bar col column row site form panel holder group".split())
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
#: Kinds of nodes: text that goes with what holds it, text that only the page as a whole holds, what groups texts, and boxes, which may well
#: differ from what holds them.
_TEXTS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary pre address".split())
_GROUPS = set("ul ol dl table thead tbody tfoot tr blockquote figure hgroup center".split())
KINDS = ("text", "loose", "group", "box")


class Node:
    __slots__ = ("names", "own", "parent", "links", "tag", "truth", "marks", "rights", "form")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int, truth: int, holder: str = ""):
        self.form = (1 if holder in ("#", "html", "body") else 0) if tag in _TEXTS else 2 if tag in _GROUPS else 3  # index in KINDS
        self.tag, self.names, self.parent, self.truth = tag, names, parent, truth
        self.own = self.links = self.marks = self.rights = 0


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case, whether it ends an element, attributes) of every piece of markup; name "" of comments and the like.

    One pass: what is looked for and not there once is not looked for again, so that broken markup costs no more than whole.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        ahead = page[at + 1 : at + 4]
        if ahead == "!--":
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        ends = ahead[:1] == "/"
        name = _START.match(page, at + 1 + ends) if at < last else None
        if at > last:
            at += 1
            continue
        if not name:
            if ends or ahead[:1] in ("!", "?"):
                end = page.find(">", at) + 1
                yield at, end, "", ends, ""
                at = end
            else:
                at += 1
            continue
        i = start = name.end()
        while quotes:
            m = _STEP.search(page, i)
            if not m:
                quotes, i = False, -1
            elif m[0] == ">":
                i = m.start()
                break
            elif _VALUE.search(page, max(start, m.start() - 8), m.start()):
                i = page.find(m[0], m.end()) + 1
                if not i:
                    quotes = False
            else:
                i = m.end()
        if not quotes:  # a quote or a tag is open to the page's end: from here on > ends tags, wherever it stands
            i = page.find(">", start)
        tag = name[0].lower()
        if tag in _RAW and not ends and not (tag == "title" and page[i - 1] == "/"):
            end = _RAW_END[tag].search(page, i)  # not closed: to the page's end
            i = page.find(">", end.end()) if end else -1
            i = len(page) if i < 0 else i + 1
            yield at, i, "", False, ""
            at = i
            continue
        yield at, i + 1, tag, ends, page[start:i]
        at = i + 1


def _named(attrs: str) -> tuple[str, ...]:
    """Names in class, id and role attributes."""
    return tuple(x for t in _NAMES.findall(attrs) for v in t[1:] for x in v.split())


@lru_cache(65536)
def _says(names: tuple[str, ...]) -> tuple[str, ...]:
    """What names say: a name of telling words alone says it, one of others too has a part that does."""
    out = set()
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        sure = all(v in _HINT or v in _SHELL for v in words)
        out |= {("says:" if sure else "part:") + _HINT[w] for w in words if w in _HINT}
    return tuple(sorted(out))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and the runs of text in page order, each with its node. Markup may be broken in any way."""
    nodes, runs = [Node("#", (), -1, -1)], []
    stack, parts, at, linked = [0], [], 0, 0
    blocks = [0]  # places in the stack of its block elements
    opened: Counter = Counter()
    boxes: list[list] = []  # open inline nodes: [place in the stack, tag, how many of the tag are open]
    last_end = {m[1].lower(): m.start() for m in _ENDS.finditer(page)}
    dropped, depth, inner = "", 0, Counter()  # the element whose content is left out, how many of its name are open, and the blocks in it

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            runs.append((stack[-1], text))
            n = nodes[stack[-1]]
            n.own += len(text)
            n.marks += sum(map(text.count, (". ", "! ", "? ", "… "))) + (text[-1] in ".!?…")
            n.rights |= bool(_RIGHTS.search(text[:200]))

    def shut(i: int) -> None:
        flush()
        for n in stack[i:]:
            opened[nodes[n].tag] -= 1
        del stack[i:]
        while blocks[-1] >= i:
            blocks.pop()
        while boxes and boxes[-1][0] >= i:
            boxes.pop()

    def open_node(tag: str, names: tuple[str, ...], attrs: str) -> None:
        said = _LABEL.search(attrs) if "data-y" in attrs else None
        nodes.append(Node(tag, names, stack[-1], int(said[1]) if said else nodes[stack[-1]].truth, nodes[stack[-1]].tag))
        stack.append(len(nodes) - 1)
        opened[tag] += 1

    for start, end, tag, ends, attrs in _tokens(page):
        if not dropped and start > at:
            parts.append(page[at:start])
            if linked:
                nodes[stack[-1]].links += start - at
        at = end
        if dropped:
            if tag == dropped:
                depth += -1 if ends else not attrs.endswith("/")
                dropped = dropped if depth else ""
                continue
            if not ends:
                inner[tag] += tag in BLOCKS
                continue
            if tag not in BLOCKS or inner[tag]:
                inner[tag] -= 1
                continue
            if not opened[tag]:
                continue
            dropped = ""  # not closed itself, but what holds it is
        if not tag or tag in _RAW:
            continue
        if tag in _DROPPED:
            if not ends and not attrs.endswith("/") and start < last_end.get(tag, -1):
                dropped, depth, inner = tag, 1, Counter()
            if tag in ("select", "button"):
                parts.append(" ")
        elif tag in ("br", "hr"):
            parts.append(" ")
        elif tag == "a":
            linked = not ends
        elif tag in BLOCKS:
            linked = 0
            if ends:
                if opened[tag]:
                    i = len(blocks) - 1
                    while nodes[stack[blocks[i]]].tag != tag:
                        i -= 1
                    shut(blocks[i])
                else:
                    flush()
                continue
            flush()
            if opened["head"] and tag != "head":
                shut(next(i for i in blocks if nodes[stack[i]].tag == "head"))
            if opened["p"] and nodes[stack[blocks[-1]]].tag == "p":
                shut(blocks[-1])
            elif tag[0] == "h" and tag[1:].isdigit() and re.fullmatch("h[1-6]", nodes[stack[blocks[-1]]].tag):
                shut(blocks[-1])
            if tag in _CLOSES:
                i, shuts = len(blocks) - 1, 0
                while i > 0 and (name := nodes[stack[blocks[i]]].tag) in _IMPLIED:
                    if name in _CLOSES[tag]:
                        shuts = i
                        if tag == "li" or name == tag:
                            break
                    i -= 1
                if shuts:
                    shut(blocks[shuts])
            open_node(tag, _named(attrs) if attrs else (), attrs)
            blocks.append(len(stack) - 1)
        elif ends:
            if boxes and boxes[-1][1] == tag:
                boxes[-1][2] -= 1
                if not boxes[-1][2]:
                    shut(boxes[-1][0])
        elif boxes and boxes[-1][1] == tag:
            boxes[-1][2] += 1
        elif attrs and tag not in _VOID and (names := _named(attrs)) and _says(names):
            flush()
            open_node(tag, names, attrs)
            boxes.append([len(stack) - 1, tag, 1])
    if not dropped:
        parts.append(page[at:])
    flush()
    return nodes, runs


def _named_tag(tag: str) -> str:
    return "h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag if tag in BLOCKS else "inline"


def describe(nodes: list[Node]) -> list[tuple[str, ...]]:
    """The features of each node, from itself and all below it, in time proportional to their number."""
    n = len(nodes)
    size, links, marks, heads, paras, depth = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        size[i] += x.own
        links[i] += min(x.links, x.own)
        marks[i] += x.marks
        heads[i] += x.tag == "h1"
        paras[i] += x.tag == "p" and x.own > 0
        if i:
            p = x.parent
            size[p] += size[i]
            links[p] += links[i]
            marks[p] += marks[i]
            heads[p] += heads[i]
            paras[p] += paras[i]
    whole = max(1, size[0])
    out = []
    for i, x in enumerate(nodes):
        depth[i] = depth[x.parent] + 1 if i else 0
        tag, form = f"tag:{_named_tag(x.tag)}", KINDS[x.form]
        if not size[i]:
            out.append((tag, "empty"))
            continue
        link = links[i] / size[i]
        held = [tag, *_says(x.names), f"{form}:links{(link > 0) + (link >= 0.3) + (link >= 0.7)}"]
        if x.rights:
            held.append(f"{form}:rights")
        if x.form > 1:
            share = size[i] / whole
            held += [f"{form}:marks{(marks[i] > 0) + (marks[i] > 2) + (marks[i] > 8)}", f"{form}:share{(share >= 0.03) + (share >= 0.15) + (share >= 0.5)}", f"{form}:long{(size[i] > 60) + (size[i] > 300) + (size[i] > 1200)}"]
        if x.form == 3:
            held += [f"box:heads{min(heads[i], 1)}", f"box:paras{(paras[i] > 0) + (paras[i] > 2)}", f"box:depth{min(depth[i], 4)}", "names" if x.names else "nameless"]
        out.append(tuple(held))
    return out


class TreeModel:
    """weights: of features, for content against not; edges: of (kind of child, parent's state, child's state), as log potentials."""

    def __init__(self, weights: dict[str, float], edges: list[list[list[float]]]):
        self.weights, self.edges = weights, edges
        self.tables = [[[math.exp(v) for v in row] for row in table] for table in edges]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node: sum-product, children to parents and back."""
        n, w = len(nodes), self.weights
        belief = [math.exp(max(-40.0, min(40.0, sum(w.get(f, 0.0) for f in fs)))) for fs in describe(nodes)]
        belief[0] = 1.0
        kinds = [x.form for x in nodes]
        up = [1.0] * n  # odds of content over not; up[i]: the message of i to its parent, as odds
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = self.tables[kinds[i]]
            b = belief[i]
            up[i] = (e10 + e11 * b) / (e00 + e01 * b)
            p = nodes[i].parent
            belief[p] = min(1e30, max(1e-30, belief[p] * up[i]))
        full = belief[:]
        for i in range(1, n):
            (e00, e01), (e10, e11) = self.tables[kinds[i]]
            rest = full[nodes[i].parent] / up[i]
            full[i] = min(1e30, max(1e-30, belief[i] * (e01 + e11 * rest) / (e00 + e10 * rest)))
        return [x / (1 + x) for x in full]


def fit_tree(pages: list[str], steps: int = 600, rate: float = 0.3, ridge: float = 0.1) -> TreeModel:
    """Weights of the greatest penalised likelihood of pages whose markup says data-y="1" (content) or "0"; what says neither goes
    with what holds it, and what holds content is content. All pages' trees run as one forest, level by level, messages as log odds."""
    parent, truth, kind, feats = [], [], [], []
    for page in pages:
        nodes, _ = parse(page)
        holds = [x.truth == 1 for x in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].parent] |= holds[i]
        at = len(parent)
        parent += [x.parent + at if x.parent >= 0 else -1 for x in nodes]
        truth += holds
        kind += [x.form for x in nodes]
        feats += [(), *describe(nodes)[1:]]
    names = sorted({f for fs in feats for f in fs})
    if not names:
        return TreeModel({}, np.zeros((len(KINDS), 2, 2)).tolist())
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(parent), len(names)))
    for i, fs in enumerate(feats):
        x[i, [place[f] for f in fs]] = 1
    parent, truth, kind = np.array(parent), np.array(truth, int), np.array(kind)
    depth = np.zeros(len(parent), int)
    for i in np.flatnonzero(parent >= 0):
        depth[i] = depth[parent[i]] + 1
    order = np.argsort(depth, kind="stable")  # parents first, level by level
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    x, truth, kind, parent = x[order], truth[order], kind[order], np.where(parent >= 0, place[parent], -1)[order]
    ends = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [slice(a, b) for a, b in zip(ends[1:], ends[2:], strict=False)]
    child = slice(ends[1], len(order))
    w, e = np.zeros(len(names)), np.zeros((len(KINDS), 2, 2))
    moments = [np.zeros_like(v) for v in (w, w, e, e)]
    want_w, cells = x.T @ truth, kind[child] * 4
    count = lambda at, weight=None: np.bincount(at, weight, e.size)
    want_e = count(cells + truth[parent[child]] * 2 + truth[child]).reshape(e.shape)
    for t in range(1, steps + 1):
        of = e[kind]
        e00, e01, e10, e11 = of[:, 0, 0], of[:, 0, 1], of[:, 1, 0], of[:, 1, 1]
        inside, up = x @ w, np.zeros(len(x))
        for level in reversed(levels):
            b = inside[level]
            up[level] = np.logaddexp(e10[level], e11[level] + b) - np.logaddexp(e00[level], e01[level] + b)
            above = slice(int(parent[level].min()), int(parent[level].max()) + 1)
            inside[above] += np.bincount(parent[level] - above.start, up[level], above.stop - above.start)
        full = inside.copy()
        rest = np.zeros(len(x))
        for level in levels:
            rest[level] = r = full[parent[level]] - up[level]
            full[level] = inside[level] + np.logaddexp(e01[level], e11[level] + r) - np.logaddexp(e00[level], e10[level] + r)
        p = 1 / (1 + np.exp(-full))
        pair = of[child].reshape(-1, 4).T + np.stack([np.zeros(len(cells)), inside[child], rest[child], inside[child] + rest[child]])
        pair = np.exp(pair - pair.max(0))
        pair /= pair.sum(0)
        got_e = sum(count(cells + j, pair[j]) for j in range(4)).reshape(e.shape)
        for v, g, m, s in ((w, want_w - x.T @ p - ridge * w, *moments[:2]), (e, want_e - got_e - ridge * e, *moments[2:])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate / math.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return TreeModel(dict(zip(names, w.tolist(), strict=True)), e.tolist())


@lru_cache(1)
def default_model() -> TreeModel:
    return fit_tree(labelled_pages())


def main_text(page: str | None, model: TreeModel | None = None) -> str:
    """The content's runs of text, joined by single spaces; of a null or empty page the empty string."""
    if not page:
        return ""
    nodes, runs = parse(page)
    p = (model or default_model()).marginals(nodes)
    return " ".join(text for i, text in runs if p[i] >= 0.5)


def _reader(model: TreeModel):
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x, model) for x in pages.to_pylist()], pa.string())

    return run


def extract_text(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars. A page is handled on its own, whole, so that nothing is
    shuffled and no host is hot; nulls and pages without content give the empty text; repeated rows give repeated rows; further
    columns play no part. labelled: pages to learn from (fit_tree); by default those of labelled_pages()."""
    small_batches(pages.sparkSession)
    model = default_model() if labelled is None else fit_tree(labelled)
    return pages.select("page_id", "url", F.arrow_udf(_reader(model), "string")("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
