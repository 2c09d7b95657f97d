"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded from the top of the tree down.

A page becomes a tree of elements. Each element gets features (tag and attribute tokens, text and link density of its
subtree, depth, place among its siblings) and the trees give the probability that it belongs to, or wraps, the main
text. Decoding maximises the joint likelihood under one rule: an element that is left out takes its whole subtree
with it, so ancestors and descendants cannot contradict each other.

The trees are fitted on the driver to small labelled pages that `training_pages` lays out by fixed rules.

Defined cases: a null or empty page, or one without text, has the empty text; unclosed tags end with their parent;
repeated pages are read row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button option".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var ins del".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "p", "ul", "ol", "li", "table", "h1", "h2", "h3", "blockquote", "pre", "figure", "dialog")
MAIN_WORDS = re.compile("article|content|post|entry|story|main|body|text")
SIDE_WORDS = re.compile(
    "nav|menu|head|foot|side|notice|cookie|consent|banner|promo|sponsor|advert|comment|repl(y|ies)|respon|discuss|disqus|related|share|social|"
    "widget|popup|modal|newsletter|subscri|login|search|breadcrumb|crumb|pagin|legal|copyright|toolbar|alert|recommend|trending|masthead|feedback")
AD_WORD = re.compile("(^|[^a-z])ads?([^a-z]|$)")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)  # somewhere in the attributes; `is_hidden` looks where
NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none(?![\w-])", re.I)
SPACE = re.compile(r"\s+")

ROUNDS, DEPTH, RATE, CUTS = 40, 3, 0.3, 16


class Node:
    __slots__ = ("tag", "names", "parent", "kids", "depth", "at", "hidden", "n_elements")

    def __init__(self, tag: str, names: str, parent: Node | None, hidden: bool = False):
        self.tag, self.names, self.parent, self.hidden = tag, names, parent, hidden
        self.kids: list[Node | str] = []
        self.at = self.n_elements = 0
        self.depth = parent.depth + 1 if parent else 0


def is_hidden(attrs: str) -> bool:
    """Whether there is an attribute `hidden`, or a style without display; other attributes' values do not count."""
    return bool(HIDDEN.search(attrs)) and any(
        name.lower() == "hidden" or name.lower() == "style" and bool(NO_DISPLAY.search(a or b or c)) for name, a, b, c in ATTR.findall(attrs))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree and its elements in page order; raw elements and comments leave no text."""
    root = Node("#root", "", None)
    nodes, here, at = [root], root, 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            here.kids.append(page[at: m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["cdata"]:
            here.kids.append(m["cdata"])
        if not tag:
            continue
        if m["close"]:
            if tag in RAW:
                continue
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag == "br" or tag == "hr":
            here.kids.append("\x00" if tag == "hr" else " ")
            continue
        if tag in VOID:
            continue
        if tag in CLOSED_BY_BLOCK or tag in ("li", "dt", "dd", "tr", "td", "th"):
            up = here
            while up is not root and (up.tag in INLINE):
                up = up.parent
            if up.tag == "p":
                here = up.parent
            elif tag in ("li", "tr", "td", "th", "dt", "dd") and up.tag == tag:
                here = up.parent
        node = Node(tag, " ".join(a or b or c for a, b, c in NAMES.findall(m["attrs"])).lower(), here, is_hidden(m["attrs"]))
        here.kids.append(node)
        nodes.append(node)
        here = here if m["attrs"].endswith("/") else node
    if at < len(page):
        here.kids.append(page[at:])
    return root, nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row per element."""
    index = {id(n): i for i, n in enumerate(nodes)}
    size = len(nodes)
    text, links, blocks, stops, words, total = ([0] * size for _ in range(6))
    for i in range(size - 1, -1, -1):
        node = nodes[i]
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(kid.strip("\x00 \n\t"))
                text[i] += n
                words[i] += kid.count(" ") + (n > 0)
                stops[i] += kid.count(".") + kid.count("!") + kid.count("?") + kid.count(",")
            else:
                k = index[id(kid)]
                text[i] += text[k]
                words[i] += words[k]
                stops[i] += stops[k]
                links[i] += text[k] if kid.tag == "a" else links[k]
                blocks[i] += blocks[k] + (kid.tag not in INLINE)
                total[i] += total[k] + 1
    whole = max(text[0], 1)
    out: list[tuple] = []
    flags: list[tuple] = []
    above: list[tuple] = []
    for i, node in enumerate(nodes):
        # a role in the tag counts like a word in the attributes
        flags.append((node.tag in ("article", "main") or bool(node.names and MAIN_WORDS.search(node.names)),
                      node.tag in ("nav", "aside", "footer", "form", "header", "dialog") or bool(node.names and SIDE_WORDS.search(node.names)),
                      bool(node.names and AD_WORD.search(node.names))))
        parent = index[id(node.parent)] if node.parent else i
        above.append(tuple(a or b for a, b in zip(above[parent], flags[parent], strict=True)) if node.parent else (False,) * 3)
        kin = node.parent.n_elements if node.parent else 1
        size_of, within = max(text[i], 1), max(text[parent], 1)
        out.append((
            text[i], links[i] / size_of, text[i] / max(blocks[i], 1), stops[i] / max(words[i], 1), text[i] / max(words[i], 1),
            text[i] / whole, text[i] / within, total[i], node.depth, node.at / max(kin, 1), kin,
            links[parent] / within, *flags[i], *above[i], node.hidden, node.tag in INLINE, TAGS.index(node.tag) if node.tag in TAGS else -1))
        at = 0
        for kid in node.kids:
            if not isinstance(kid, str):
                kid.at, at = at, at + 1
        node.n_elements = at
    table = np.array(out, float)
    return np.concatenate((table[:, :-1], table[:, -1:] == np.arange(len(TAGS))), axis=1)


class Boosted:
    """Gradient boosting with small trees for a yes or no, by histogram splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-9
            leaf = np.zeros(len(y), int)
            splits: list[tuple[int, float]] = []
            for _ in range(depth):  # one split for all leaves of a level
                best = (-1.0, 0, 0.0)
                for f, own in enumerate(cuts):
                    for cut in own:
                        side = leaf * 2 + (x[:, f] > cut)
                        g, h = np.bincount(side, grad), np.bincount(side, hess)
                        gain = float((g * g / (h + 1)).sum())
                        if gain > best[0]:
                            best = (gain, f, float(cut))
                splits.append(best[1:])
                leaf = leaf * 2 + (x[:, best[1]] > best[2])
            value = rate * np.bincount(leaf, grad, 2 ** depth) / (np.bincount(leaf, hess, 2 ** depth) + 1)
            score += value[leaf]
            self.trees.append(splits)
            self.leaves.append(value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for splits, value in zip(self.trees, self.leaves, strict=True):
            leaf = np.zeros(len(x), int)
            for f, cut in splits:
                leaf = leaf * 2 + (x[:, f] > cut)
            score += value[leaf]
        return 1 / (1 + np.exp(-score))


def training_pages(count: int = 160, seed: int = 5) -> list[str]:
    """Labelled pages: elements of the main text, and their wrappers, carry the attribute data-main."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("ba", "den", "lo", "mir", "tes", "un", "vor", "ka")) for _ in range(rnd.randint(1, 4)))
    prose = lambda low, high: " ".join(". ".join(" ".join(word() for _ in range(rnd.randint(4, 14))) for _ in range(rnd.randint(low, high))).split()) + "."
    m = " data-main=1"
    side_names = ("sidebar", "side-bar widget", "related-posts", "newsletter", "notice", "cookie-notice", "share social", "ad", "ads top", "ad-slot",
                  "advert", "promo", "sponsored", "breadcrumb", "comments", "comment-list", "replies", "login-form", "search", "banner", "popup", "alert", "disqus_thread")
    main_names = ("content", "post", "entry-content", "article-body", "story", "main", "post-content", "text")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))

    def side() -> str:
        name = rnd.choice(side_names)
        tag = rnd.choice(("div", "aside", "section", "div"))
        inner = rnd.choice((lambda: f"<ul>{links(rnd.randint(2, 8))}</ul>", lambda: prose(1, 3), lambda: f"<p>{prose(1, 5)}</p>" * rnd.randint(1, 3),
                            lambda: "".join(f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>' for _ in range(rnd.randint(1, 5)))))()
        kind = rnd.random()
        if kind < 0.15:
            return f"<nav><ul>{links(rnd.randint(3, 9))}</ul></nav>"
        if kind < 0.25:
            return f"<form><label>{word()}</label><p>{prose(1, 1)}</p></form>"
        if kind < 0.4:
            return f"<aside><h2>{word()}</h2><p>{prose(1, 4)}</p></aside>"
        return f'<{tag} class="{name}">{inner}</{tag}>' if rnd.random() < 0.6 else f'<{tag} id="{name.split()[0]}">{inner}</{tag}>'

    def block() -> str:
        kind = rnd.random()
        if kind < 0.7:
            return f"<p{m}>{prose(1, 6)}</p>"
        if kind < 0.78:
            return f"<h2{m}>{word()} {word()}</h2>"
        if kind < 0.86:
            return f"<ul{m}>" + "".join(f"<li{m}>{prose(1, 2)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote{m}><p{m}>{prose(1, 3)}</p></blockquote>"
        return f'<p{m}>{prose(1, 2)} <a{m} href="/x">{word()}</a> {prose(1, 2)}</p>'

    out = []
    for _ in range(count):
        body = "".join(block() if rnd.random() < 0.85 else side() for _ in range(rnd.choice((1, 2, 4, 8, 14))))
        heading = f"<h1{m}>{word()} {word()} {word()}</h1>" if rnd.random() < 0.8 else ""
        wrap = rnd.choice((f"<article{m}>%s</article>", f"<main{m}>%s</main>", f'<div class="{rnd.choice(main_names)}"{m}>%s</div>', f"<div{m}>%s</div>",
                           f"<main{m}><article{m}>%s</article></main>", f'<section id="{rnd.choice(main_names)}"{m}>%s</section>'))
        around = [side() for _ in range(rnd.randint(0, 3))], [side() for _ in range(rnd.randint(0, 3))]
        head = rnd.choice((f"<nav><ul>{links(6)}</ul></nav>", f'<header><h2>{word()}</h2><ul class="menu">{links(4)}</ul></header>', ""))
        foot = rnd.choice((f"<footer>{prose(1, 2)}</footer>", f'<div class="footer"><p>{prose(1, 1)}</p></div>', f"<footer><ul>{links(3)}</ul></footer>", ""))
        out.append(f"<html><body{m}>{head}{''.join(around[0])}{wrap % (heading + body)}{''.join(around[1])}{foot}</body></html>")
    return out


def fit() -> Boosted:
    rows, marks = [], []
    for page in training_pages():
        marked = ["data-main" in m["attrs"] for m in TOKEN.finditer(page) if m["tag"] and not m["close"]]
        _, nodes = parse(page)
        rows.append(features(nodes)[1:])
        marks += marked
    return Boosted(np.concatenate(rows), np.array(marks, float))


def blocks_of(root: Node, nodes: list[Node], inside: list[bool]) -> list[str]:
    """Texts of the kept blocks in page order."""
    index = {id(n): i for i, n in enumerate(nodes)}
    out, now = [], []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag not in INLINE:
            flush()
        if k == len(node.kids):
            if node.tag not in INLINE:
                flush()
            continue
        stack.append((node, k + 1))
        kid = node.kids[k]
        if not isinstance(kid, str):
            if inside[index[id(kid)]]:
                stack.append((kid, 0))
        elif kid == "\x00":
            flush()
        elif inside[index[id(node)]]:
            now.append(kid)
    return out


def chosen(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """The most likely consistent choice: an element is in only if its parent is."""
    index = {id(n): i for i, n in enumerate(nodes)}
    p = np.clip(p, 1e-4, 1 - 1e-4)
    gain_in, gain_out = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = index[id(nodes[i].parent)]
        gain_in[up] += max(gain_in[i], gain_out[i])
        gain_out[up] += gain_out[i]
    inside = [True] * len(nodes)
    for i in range(1, len(nodes)):
        inside[i] = inside[index[id(nodes[i].parent)]] and gain_in[i] > gain_out[i] and not nodes[i].hidden
    return inside


def main_texts(model: Boosted, pages: list[str | None]) -> list[str]:
    """Main texts of some pages, whose elements the trees see as one batch."""
    trees = [parse(page or "") for page in pages]
    rows = [features(nodes) for _, nodes in trees]
    ends = np.cumsum([0, *map(len, rows)])
    probability = model.probability(np.concatenate(rows)) if rows else np.zeros(0)
    out = []
    for (root, nodes), a, b in zip(trees, ends[:-1], ends[1:], strict=True):
        own = probability[a:b]
        own[[n.tag in ("html", "body", "#root") for n in nodes]] = 1.0
        out.append(" ".join(blocks_of(root, nodes, chosen(nodes, own))))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its number of code points for every row."""
    small_batches(pages.sparkSession, 200)
    model = fit()

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            pages = some.tolist()
            yield pd.Series([text for i in range(0, len(pages), 50) for text in main_texts(model, pages[i: i + 50])])

    found = pages.select("page_id", "url", read("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
