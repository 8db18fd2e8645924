"""Main text of web pages by a tree-structured graphical model.

Block elements are nodes of a tree, each either content or not. Potentials of a node come from its tag,
names and text; potentials of an edge tie child to parent. Sum-product messages, upward and then
downward, give each node's marginal. Weights are learned by maximum likelihood from labelled pages.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfold.llm.common import map_arrow, out_batch, slices, texts_of

SCHEMA = "page_id long, url string, text string, n_chars long"
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements of HTML by how they lay out, and those whose text is never shown as prose.
BLOCKS = frozenset("html head title body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset details summary address dialog hgroup center menu search".split())
SILENT = frozenset("script style template noscript svg iframe object audio video canvas select textarea button option".split())
#: Of those the ones that may hold elements of their own kind.
NESTING = frozenset("template svg object".split())
#: Elements whose content is text up to their own end tag, with no tags or comments in it.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figcaption summary".split())
#: A start tag that ends an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head", "title")}


class Node:
    __slots__ = ("tag", "parent", "names", "label", "chars", "linked", "words", "hidden", "depth", "bare", "ended", "within", "box", "box_words", "box_linked", "box_chars", "box_texts", "traits")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.names, self.label, self.hidden, self.bare = (), False, False, True
        self.chars = self.linked = self.words = self.ended = 0  # of its own text; ended: blocks that end as a sentence does
        self.box = self.box_words = self.box_linked = self.box_chars = self.box_texts = 0
        self.within, self.traits = "", ()


def measure(nodes: list[Node]) -> None:
    """What a node's box has: the nearest element upward that isn't bare text or a bare box around it. All
    text of a box counts together, however it is wrapped."""
    for k, x in enumerate(nodes):
        x.box = k if edge_kind(x) else nodes[x.parent].box
        b = nodes[x.box]
        b.box_words += x.words
        b.box_linked += x.linked
        b.box_chars += x.chars
        b.box_texts += x.words > 0
    whole, most = max(1, sum(x.words for x in nodes)), max((x.box_words - x.box_linked // 6 for x in nodes), default=0)
    for x in nodes:
        b = nodes[x.box]
        x.traits = () if not b.box_words else (
            f"box words {_class(b.box_words, 5, 15, 40, 100)}", f"box linked {_class(b.box_linked / max(1, b.box_chars), 0.1, 0.3, 0.6)}", f"box share {_class(b.box_words / whole, 0.05, 0.15, 0.3, 0.6)}",
            f"box texts {_class(b.box_texts, 2, 4)}", "box largest" if b.box_words - b.box_linked // 6 == most else "box smaller", f"box tag {b.tag}",
        )


def next_tag(page: str, at: int):
    """(start, end, name, whether it ends an element, attributes) of the next markup; the name of a comment or
    declaration is "". None where no more markup begins.

    A tag runs to the first ">" outside of quotes; where a quote isn't closed on the page, to the first ">"
    at all. A tag that isn't closed takes the rest of the page, as it does in browsers. Each character
    is looked at a bounded number of times, whatever is left open.
    """
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, len(page) if end < 0 else end + 3, "", False, ""
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            return start, len(page) if end < 0 else end + 1, "", False, ""
        ending = page.startswith("/", start + 1)
        if not (m := NAME.match(page, start + 1 + ending)):
            at = start + 1
            continue
        if (close := page.find(">", m.end())) < 0:
            return start, len(page), "", False, ""
        k = m.end()
        while True:
            k = UNQUOTED.match(page, k).end()
            if k >= len(page) or page[k] == ">":
                break
            if (k := page.find(page[k], k + 1) + 1) == 0:
                k = close
                break
        k = k if k < len(page) else close
        return start, k + 1, m[0].lower(), ending, page[m.end() : k]
    return None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the blocks of text in page order as (element, text)."""
    nodes, blocks = [Node("#page", -1, 0)], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, with the block element each is in
    parts: list[str] = []
    links, at, skip, inside = 0, 0, None, 0
    closed: dict[str, set[int]] = {}  # where silent elements begin that have an end tag of their own

    def is_closed(tag: str, start: int) -> bool:
        """Whether the silent element has an end tag; one that hasn't hides nothing."""
        if tag not in closed:
            closed[tag], open_ = set(), []
            for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    closed[tag].add(open_.pop())
        return start in closed[tag]

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                nodes[stack[-1][1]].linked += len(raw.strip())

    def close_block() -> None:
        if parts:
            words = "".join(parts).split()
            parts.clear()
            if words:
                own, run = stack[-1][1], " ".join(words)
                node = nodes[own]
                node.chars += len(run)
                node.words += len(words)
                node.ended += run[-1] in ".!?…。！？:;\"'”»)"
                blocks.append((own, run))

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag, _ = stack[-1]
            if tag in BLOCKS:
                close_block()
            links -= tag == "a"
            stack.pop()

    while m := next_tag(page, at):
        start, end, tag, ending, inner = m
        if skip is None:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW and not ending and not inner.rstrip().endswith("/"):
            end = RAW[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            if skip is None:
                parts.append(" ")
            continue
        if skip is not None:
            if tag == skip:
                inside += -1 if ending else tag in NESTING
                if inside == 0:
                    skip = None
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                parts.append("" if tag == "wbr" else " ")
            continue
        if ending:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCKS and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in SILENT:
            if not inner.rstrip().endswith("/") and is_closed(tag, start):
                skip, inside = tag, 1
            parts.append(" ")
            continue
        if tag in BLOCKS:
            closes = ("p",) if tag not in ENDS else (*ENDS[tag], "p")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    pop(k)
                elif stack[k][0] in BLOCKS and stack[k][0] not in closes:
                    break
            close_block()
            node = Node(tag, stack[-1][1], nodes[stack[-1][1]].depth + 1)
            node.within = nodes[node.parent].tag
            if inner.strip():
                a = _attributes(inner)
                node.names = tuple(dict.fromkeys(x for c in ("class", "id", "role", "aria-label") for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a.get(c, "")).lower()) if len(x) > 1))
                node.hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "") or a.get("aria-hidden") == "true"
                node.label, node.bare = a.get("data-content") == "1", not node.names
            nodes.append(node)
            stack.append((tag, len(nodes) - 1))
            if tag not in BLOCKS:
                links += tag == "a"
        else:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
    if skip is None:
        text(page[at:])
    pop(1)
    close_block()
    measure(nodes)
    return nodes, blocks


def _class(x: float, *limits: float) -> int:
    return sum(x >= limit for limit in limits)


def features(node: Node, known=None) -> list[str]:
    """By its tag, the tag and names it has, its own text, and its box's text; known: names that count as such."""
    names = [f"name {x}" if known is None or x in known else "name other" for x in node.names]
    out = [f"tag {node.tag}", f"tag {node.tag} in {node.within}", *dict.fromkeys(names), "hidden" if node.hidden else "shown", *node.traits]
    if node.chars:
        out += [f"words {_class(node.words, 3, 8, 20, 50)}", f"linked {round(2 * node.linked / node.chars)}", f"ended {min(1, node.ended)}"]
    return out


def edge_kind(node: Node) -> int:
    """Bare elements of text, and bare boxes around them, follow their parents; sections and elements with names less so."""
    return 0 if node.bare and (node.tag in PLAIN or node.tag == "div") else 1 if node.bare else 2


def _lse(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


#: Pages of the training set that a name has to be on to count as known.
KNOWN = 4


class Model:
    """weights: of features for content against not; edges[kind][parent][child]."""

    def __init__(self, weights: dict[str, float] | None = None, edges: np.ndarray | None = None):
        self.weights, self.edges = weights or {}, np.zeros((3, 2, 2)) if edges is None else edges
        self.known = {f[5:] for f in self.weights if f.startswith("name ")}

    def marginals(self, nodes: list[Node], pairs: bool = False):
        """Chance of content for each node; with pairs also that of each (parent, child) state."""
        n, get = len(nodes), self.weights.get
        own = [[0.0, sum(get(f, 0.0) for f in features(x, self.known))] for x in nodes]
        e = [self.edges[edge_kind(x)].tolist() for x in nodes]
        up: list = [None] * n
        for k in range(n - 1, 0, -1):  # children stand after parents
            (o0, o1), w = own[k], e[k]
            up[k] = (_lse(w[0][0] + o0, w[0][1] + o1), _lse(w[1][0] + o0, w[1][1] + o1))
            p = own[nodes[k].parent]
            p[0] += up[k][0]
            p[1] += up[k][1]
        belief, joint = [None] * n, []
        belief[0] = (own[0][0], own[0][1])
        for k in range(1, n):
            b, w = belief[nodes[k].parent], e[k]
            d0, d1 = b[0] - up[k][0], b[1] - up[k][1]
            belief[k] = (own[k][0] + _lse(d0 + w[0][0], d1 + w[1][0]), own[k][1] + _lse(d0 + w[0][1], d1 + w[1][1]))
            if pairs:
                s = [d0 + w[0][0] + own[k][0], d0 + w[0][1] + own[k][1], d1 + w[1][0] + own[k][0], d1 + w[1][1] + own[k][1]]
                top = max(s)
                s = [exp(x - top) for x in s]
                joint.append([x / sum(s) for x in s])
        chance = [1 / (1 + exp(min(500.0, max(-500.0, b[0] - b[1])))) for b in belief]
        return (chance, joint) if pairs else chance

    @classmethod
    def fit(cls, pages: list[str], passes: int = 20, rate: float = 0.4, decay: float = 1e-3) -> Model:
        """pages: HTML whose content elements have data-content="1"."""
        trees = [parse(p)[0] for p in pages]
        seen = Counter(n for t in trees for n in {n for x in t for n in x.names})
        known = {n for n, k in seen.items() if k >= KNOWN}
        names = sorted({f for t in trees for x in t for f in features(x, known)})
        at = {f: k for k, f in enumerate(names)}
        model, square = cls({f: 0.0 for f in names}), np.full(len(names) + 12, 1e-8)
        value = np.zeros(len(names) + 12)
        rows = [[[at[f] for f in features(x, known)] for x in t] for t in trees]
        for _ in range(passes):
            for first in range(0, len(trees), 20):
                g = -decay * value
                for tree, found in zip(trees[first : first + 20], rows[first : first + 20], strict=True):
                    chance, joint = model.marginals(tree, True)
                    for k, x in enumerate(tree):
                        off = x.label - chance[k]
                        for f in found[k]:
                            g[f] += off
                        if k:
                            base = len(names) + 4 * edge_kind(x)
                            g[base + 2 * tree[x.parent].label + x.label] += 1
                            for j in range(4):
                                g[base + j] -= joint[k - 1][j]
                square += g * g
                value += rate * g / np.sqrt(square)
                model.weights = dict(zip(names, value.tolist(), strict=False))
                model.edges = value[len(names) :].reshape(3, 2, 2)
        return model


#: Names that pages of the training set give to their parts; pages elsewhere use these and other ones.
NAMES = {
    "content": "content post entry story article-body main-content post-content entry-content article text body-text post-body prose markdown".split(),
    "inside": "note callout highlight tip info example lead intro quote pullquote summary-box box code-block figure row column section-body wrapper inner".split(),
    "nav": "nav navbar menu main-menu breadcrumb breadcrumbs pagination toc skip topbar navigation site-nav pager tabs".split(),
    "header": "header site-header masthead branding logo top banner-top page-header".split(),
    "footer": "footer site-footer bottom copyright colophon legal footer-links credits".split(),
    "aside": "sidebar aside widget related recommended popular trending tags share social author-box promo-box read-more rail teaser".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsense ad-slot commercial".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr popup modal warning message subscribe-notice announcement banner disclaimer paywall".split(),
    "form": "newsletter subscribe search login signup contact-form feedback register".split(),
    "comments": "comments comment-list reader-comments discussion responses replies disqus comment thread reviews".split(),
}
ELEMENTS = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"], "ad": ["div", "div", "aside", "section", "p"], "notice": ["div", "div", "section", "p", "dialog"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"]}


def training_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled pages drawn from templates: parts in varied order, elements and names, texts of random letters.

    Articles have an element of their own, with a usual name, another one or none, or stand in the body
    itself; they have one paragraph or many, in boxes or not, with notes and quotes among them.
    """
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeioubcdlmnrstv") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 1, b: int = 40) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", "", ","])

    def mark(on: bool) -> str:
        return ' data-content="1"' if on else ""

    def other_name() -> str:
        return "".join(r.choice("bcdfghkmnpqrtvwxz") for _ in range(r.randint(2, 4))) + r.choice(["", "1", "-x", "_3"])

    def named(kind: str, tag: str, inner: str, on: bool, bare: float, strange: float = 0.0) -> str:
        value = other_name() if r.random() < strange else " ".join(r.sample(NAMES[kind], r.choice([1, 1, 2])))
        name = "" if r.random() < bare else f' {r.choice(["class", "class", "id"])}="{value}"'
        return f"<{tag}{name}{mark(on)}>{inner}</{tag}>"

    def one(on: bool) -> str:
        k = r.random()
        link = f' <a href="/x">{words(1, 3)}</a> ' if r.random() < 0.2 else " "
        if k < 0.72:
            return f"<p{mark(on)}>{sentence()}{link}{sentence()}</p>" if r.random() < 0.8 else f"<p{mark(on)}>{sentence(1, 4)}</p>"
        if k < 0.8:
            return f"<h{(n := r.randint(2, 4))}{mark(on)}>{words(1, 8)}</h{n}>"
        if k < 0.88:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}{mark(on)}>" + "".join(f"<li{mark(on)}>{sentence(1, 15)}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if k < 0.92:
            return f"<blockquote{mark(on)}>{sentence()}</blockquote>"
        if k < 0.95:
            return f"<pre{mark(on)}>{words(2, 20)}</pre>"
        if k < 0.97:
            return f"<table{mark(on)}><tr{mark(on)}><td{mark(on)}>{words(1, 5)}</td><td{mark(on)}>{words(1, 5)}</td></tr></table>"
        return f"<figure{mark(on)}><img src=x><figcaption{mark(on)}>{sentence(1, 12)}</figcaption></figure>"

    def prose(on: bool, a: int, b: int, boxed: float, noted: float) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            block = one(on)
            if r.random() < noted:
                tag = r.choice(["div", "div", "section", "aside", "figure", "blockquote"])
                block = named("inside", tag, block if r.random() < 0.7 else f"<pre{mark(on)}>{words(2, 20)}</pre>", on, 0.2, 0.3)
            elif r.random() < boxed:
                block = f"<div{mark(on)}>{block}</div>"
            out.append(block)
        return "".join(out)

    def part(kind: str) -> str:
        tag = r.choice(ELEMENTS[kind])
        if kind == "nav":
            items = "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(r.randint(2, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(f'<a href="/{k}">{words(1, 2)}</a>' for k in range(5))
        elif kind == "comments":
            item = "li" if tag == "ol" else r.choice(["div", "p", "article"])
            inner = (f"<h3>{words(1, 3)}</h3>" if tag != "ol" else "") + "".join(f"<{item}>{sentence()} {sentence()}</{item}>" if item == "p" or r.random() < 0.5 else f'<{item} class="comment"><p>{sentence()}</p></{item}>' for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f"<p>{sentence(2, 12)}</p><label>{words(1, 2)}</label><input name=q>"
        elif kind in ("header", "footer"):
            inner = r.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{sentence(2, 10)}</p>", f'<div class="logo">{words(1, 2)}</div>', sentence(1, 14)]) if kind == "header" else r.choice([f"&copy; {sentence(2, 12)}", f"&copy; {sentence(2, 30)} {sentence(2, 30)}", f"<p>{sentence(3, 14)}</p>", f"<p>{words(1, 5)}</p><p>{sentence(3, 30)}</p>"])
        else:
            inner = r.choice([sentence(2, 30), f"<p>{sentence(2, 30)}</p>", f"<h3>{words(1, 3)}</h3><p>{sentence()}</p>", "<ul>" + "".join(f'<li><a href="/{k}">{words(2, 6)}</a></li>' for k in range(4)) + "</ul>"]) if tag != "p" else sentence(2, 30)
        return named(kind, tag, inner, False, 0.25 if tag in ("nav", "header", "footer", "aside", "form") else 0.0)

    def page() -> str:
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section", "body"])
        head = f"<h1{mark(True)}>{words(1, 10)}</h1>" if r.random() < 0.8 else ""
        boxed, noted = r.choice([0.0, 0.0, 0.0, 0.3, 1.0]), r.choice([0.0, 0.0, 0.1, 0.3])
        inside = [prose(True, 1, 4, boxed, noted) for _ in range(r.choice([1, 1, 2, 3, 4]))] if r.random() < 0.8 else [f"<p{mark(True)}>{sentence(1, 6)}</p>" if r.random() < 0.3 and tag != "body" else f"<p{mark(True)}>{sentence(8, 30)}</p>"]
        for kind in r.sample(["ad", "aside", "notice", "form", "comments", "nav"], r.choice([0, 0, 1, 2])):
            inside.insert(r.randint(0, len(inside)) if kind != "comments" else len(inside), part(kind))
        body = head + "".join(inside)
        if tag != "body":
            body = named("content", tag, body, True, 0.6 if tag in ("article", "main") else 0.15, 0.5)
            if r.random() < 0.3:
                body = f"<{(w := r.choice(['main', 'div', 'div']))}{'' if r.random() < 0.5 else f' class={other_name()}'}>{body}</{w}>"
        before = [part(k) for k in r.sample(["nav", "header", "ad", "notice", "form"], r.randint(1, 4))]
        after = [part(k) for k in r.sample(["comments", "aside", "ad", "notice", "form", "nav"], r.randint(0, 4))] + [part("footer")] * (r.random() < 0.85)
        return f"<!DOCTYPE html><html><head><title>{words(2, 10)}</title></head><body{mark(tag == 'body')}>{''.join(before)}{body}{''.join(after)}</body></html>"

    return [page() for _ in range(n)]


@functools.cache
def default_model() -> Model:
    return Model.fit(training_pages())


def extract(page: str, model: Model, least: float = 0.5) -> str:
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    chance = model.marginals(nodes)
    return "\n".join(run for k, run in blocks if chance[k] >= least)


def extract_pages(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (blocks of the article joined by line feeds), n_chars.

    A row without html gives an empty text; a page of any length is read whole, in time about linear in
    it. Rows are independent: repeated rows, null keys and an empty table go through as they are; a block
    whose marginal is exactly a half is content; other columns are not looked at. The model is of fixed size.
    """
    model = model or default_model()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in slices(batches, "html"):
            out = [extract(x, model) for x in texts_of(batch, "html")]
            yield out_batch(schema, batch.column("page_id"), batch.column("url"), out, [len(x) for x in out])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, run, SCHEMA)
