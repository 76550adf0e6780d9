"""Main text of web pages by a tree-structured graphical model.

A page is parsed to a tree of elements and text leaves. Every node has a hidden
label, content or not. Its own evidence (tag, words of class, id and role,
length, links, sentences) is a log-linear potential, and each edge has a
potential for the labels of parent and child that depends on the kind of child.
As the graph is a tree, one pass of sum-product messages from the leaves to the
root and one back give exact marginals; a leaf is kept if content is likelier.
All pages of a batch are one forest, passed level by level.

The weights maximise the likelihood of labelled pages. These are made from a
bounded sample of the given pages whose markup names the article: their texts are set in
layouts drawn at random, in which the label of each element is known and telling
names are often missing.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import bounded_batches, query

#: Fixed values of HTML: elements whose content is never text of the page, elements without content, and inline elements.
UNREAD = frozenset("script style template noscript title textarea select iframe svg math object canvas audio video noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr".split())
#: A start tag of the first kind ends open elements of the second, but no further than one of the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"})}
#: Words of class, id, role and aria-label, by what they tell of an element.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip links linklist",
    "head": "header masthead topbar logo branding banner search",
    "foot": "footer foot copyright colophon contentinfo legal",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommend popular trending teaser more tags",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup paywall message privacy announcement",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense outbrain taboola",
    "form": "form login signin register contact feedback poll",
    "comment": "comment comments commentlist disqus reply replies respond discussion responses reviews",
    "share": "share sharing social follow tweet facebook twitter like print",
    "about": "byline author meta date dateline published timestamp tagline",
    "content": "article content post entry story body main text prose page document copy paragraph",
}
_WORD_OF = {w: g for g in reversed(NAMES) for w in NAMES[g].split()}
TAGS = "html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th form fieldset button blockquote pre figure figcaption details summary address center span a other leaf".split()
KINDS = {"leaf": 0, **dict.fromkeys(("p", "blockquote", "pre", "td", "th", "dd", "dt", "li"), 1), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2), **dict.fromkeys(("ul", "ol", "dl", "table", "tbody", "tr", "thead"), 3)}
N_KINDS = 5
_FEATURES = [f"tag {t}" for t in TAGS] + [f"name {g}" for g in NAMES] + [f"{what} {k}" for what, n in (("length", 9), ("links", 5), ("stops", 4), ("below", 9), ("links below", 5), ("share", 5)) for k in range(n)] + ["hidden", "mark", "bias"]
_FEATURES += [f"in {x}" for x in _FEATURES if x.startswith(("tag ", "name "))]
FEATURE = {name: i for i, name in enumerate(_FEATURES)}
_WITHIN = {i: FEATURE[f"in {name}"] for name, i in FEATURE.items() if f"in {name}" in FEATURE}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""\b(class|id|role|aria-label|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOP = re.compile(r"[.!?…]")


class Page:
    """The tree of a page: for each node its parent, tag and features; leaves have a text and the number of their block."""

    __slots__ = ("parent", "tag", "features", "texts", "leaf_of", "block")

    def __init__(self):
        self.parent, self.tag, self.features = [-1], ["html"], [[]]
        self.texts, self.leaf_of, self.block = [], [], []


def _evidence(attributes: str) -> list[int]:
    out = set()
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out.add(FEATURE["hidden"])
        elif key in ("class", "id", "role", "aria-label"):
            for word in _SPLIT.findall(value):
                if (group := _WORD_OF.get(word.lower())) is not None:
                    out.add(FEATURE[f"name {group}"])
    return sorted(out)


def parse_page(source: str) -> Page:
    """The tree of an HTML text; any text has one. Ends of elements that HTML lets one leave out are filled in."""
    page = Page()
    parent, tags, features = page.parent, page.tag, page.features
    stack = [("html", 0)]  # (tag, node); inline elements without names share their parent's node
    open_tags = {"html": 1}
    links = 0
    block, parts, linked = 0, [], 0

    def leaf():
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if not text.isspace():
                page.texts.append(text)
                page.block.append(block)
                page.leaf_of.append(len(parent))
                n = len(text)
                found = [min(8, n.bit_length() - 1), min(4, 5 * linked // (n + 1)), min(3, len(_STOP.findall(text)))]
                features.append([FEATURE["tag leaf"], FEATURE[f"length {found[0]}"], FEATURE[f"links {found[1]}"], FEATURE[f"stops {found[2]}"]] + ([FEATURE["mark"]] if "©" in text or "&copy" in text else []))
                parent.append(stack[-1][1])
                tags.append("leaf")
            elif page.block and page.block[-1] == block:
                page.texts[-1] += text
            parts, linked = [], 0

    def close(upto):
        nonlocal links
        while len(stack) > upto:
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            links -= tag == "a"

    def put(text):
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if not inline:
            leaf()
            block += 1
        if m[1]:
            if open_tags.get(tag) and tag != "html":
                k = len(stack) - 1
                while k > 0 and stack[k][0] != tag:
                    if inline and stack[k][0] not in INLINE:
                        k = 0
                    k -= 1
                if k > 0:
                    if inline and stack[k][1] != stack[k - 1][1]:
                        leaf()
                    close(k)
            continue
        if tag in UNREAD:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(source, at)
            if end is None:
                break
            at = source.find(">", end.end()) + 1 or size
            continue
        if tag in VOID:
            if tag == "br":
                put(" ")
            continue
        if not inline and open_tags.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in ("table", "td", "th", "button"):
                    break
        if tag in IMPLIED:
            ended, bounds = IMPLIED[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in ended:
                    cut = k
            if cut is not None:
                close(cut)
        own = _evidence(m[3]) if m[3].strip() else []
        if inline and not own:
            node = stack[-1][1]
        elif tag == "html":
            continue
        else:
            if inline:
                leaf()
            node = len(parent)
            parent.append(stack[-1][1])
            tags.append(tag)
            features.append([FEATURE.get(f"tag {tag}", FEATURE["tag other"]), *own])
        if m[3].rstrip().endswith("/") and not inline and tag not in TAGS:
            continue
        stack.append((tag, node))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    leaf()
    _sums(page)
    return page


def _sums(page: Page) -> None:
    """Features of what lies below each element."""
    n = len(page.parent)
    size, linked = [0] * n, [0] * n
    for node, text in zip(page.leaf_of, page.texts, strict=True):
        size[node] = len(text)
        linked[node] = next(int(_FEATURES[f].split()[1]) for f in page.features[node] if _FEATURES[f].startswith("links ")) * len(text) // 4
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
    total = size[0] + 1
    for k in range(n - 1, 0, -1):  # a parent's own tag and names, before more is added to it
        page.features[k] += [_WITHIN[f] for f in page.features[page.parent[k]] if f in _WITHIN]
    for k in range(n):
        f = page.features[k]
        f.append(FEATURE["bias"])
        if page.tag[k] != "leaf":
            f.append(FEATURE[f"below {min(8, size[k].bit_length())}"])
            f.append(FEATURE[f"links below {min(4, 5 * linked[k] // (size[k] + 1))}"])
            f.append(FEATURE[f"share {min(4, 5 * size[k] // total)}"])
    page.features[0].append(FEATURE["tag html"])


def page_text(page: Page, keep) -> str:
    """The kept leaves: references decoded, white space of a block as one space, blocks joined by one space."""
    out, now = [], None
    for text, block, kept in zip(page.texts, page.block, keep, strict=True):
        if kept:
            if block == now:
                out[-1] += html.unescape(text)
            else:
                out.append(html.unescape(text))
            now = block
    return " ".join(x for x in (" ".join(x.split()) for x in out) if x)


class Forest:
    """Pages as arrays: parents, levels, kinds of edges and sparse features."""

    def __init__(self, pages: list[Page]):
        base, parent, kind, row, column = 0, [], [], [], []
        self.leaves = []
        for page in pages:
            parent.extend(p + base if p >= 0 else -1 for p in page.parent)
            kind.extend(KINDS.get(t, 4) for t in page.tag)
            for k, f in enumerate(page.features):
                row.extend([base + k] * len(f))
                column.extend(f)
            self.leaves.append(np.asarray(page.leaf_of, np.int64) + base)
            base += len(page.parent)
        self.n = base
        self.parent, self.kind = np.asarray(parent, np.int64), np.asarray(kind, np.int64)
        self.row, self.column = np.asarray(row, np.int64), np.asarray(column, np.int64)
        depth = np.zeros(base, np.int64)
        at = self.parent.copy()
        while (up := at >= 0).any():
            depth += up
            at = np.where(up, self.parent[np.maximum(at, 0)], -1) if depth.max() < 64 else _deep(self.parent, depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if base else []

    def infer(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content of all nodes, and the summed marginals of edges by kind and labels."""
        belief = np.zeros((self.n, 2))
        belief[:, 1] = np.bincount(self.row, weights[self.column], minlength=self.n)
        up = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(belief[level][:, None, :] + edges[self.kind[level]], axis=2)
            np.add.at(belief, self.parent[level], up[level])
        down = np.zeros((self.n, 2))
        pairs = np.zeros_like(edges)
        for level in self.levels[1:]:
            p = self.parent[level]
            rest = belief[p] + down[p] - up[level]
            joint = rest[:, :, None] + edges[self.kind[level]]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            joint = joint + belief[level][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            np.add.at(pairs, self.kind[level], joint / joint.sum(axis=(1, 2), keepdims=True))
        both = belief + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pairs


def _deep(parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Fill in depths where chains are long: parents come before children. Returns an end mark."""
    for k, p in enumerate(parent.tolist()):
        depth[k] = depth[p] + 1 if p >= 0 else 0
    return np.full(len(parent), -1)


def train(pages: list[Page], labels: list[np.ndarray], rounds: int = 140, rate: float = 0.15, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials of highest penalised likelihood, by gradients from the marginals (Adam steps)."""
    forest = Forest(pages)
    y = np.concatenate(labels).astype(np.int64)
    seen = np.bincount(forest.column, y[forest.row], minlength=len(_FEATURES))
    pairs = np.zeros((N_KINDS, 2, 2))
    inner = np.flatnonzero(forest.parent >= 0)
    np.add.at(pairs, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    x = np.zeros(len(_FEATURES) + pairs.size)
    first, second = np.zeros_like(x), np.zeros_like(x)
    scale = 1 / max(1, len(pages))
    for t in range(1, rounds + 1):
        weights, edges = x[: len(_FEATURES)], x[len(_FEATURES) :].reshape(pairs.shape)
        marginal, expected = forest.infer(weights, edges)
        slope = np.concatenate([seen - np.bincount(forest.column, marginal[forest.row], minlength=len(_FEATURES)), (pairs - expected).ravel()]) * scale - decay * x
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        x = x + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return x[: len(_FEATURES)], x[len(_FEATURES) :].reshape(pairs.shape)


def labelled(source: str, is_content) -> tuple[Page, np.ndarray]:
    """A page and its labels: leaves by `is_content(page, node)`, elements by the larger part of their text."""
    page = parse_page(source)
    n = len(page.parent)
    inside, size = np.zeros(n), np.zeros(n)
    for node, text in zip(page.leaf_of, page.texts, strict=True):
        size[node] = len(text)
        inside[node] = len(text) * is_content(page, node)
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        inside[page.parent[k]] += inside[k]
    return page, 2 * inside > size


def under(tag: str):
    """Whether a node lies under an element of a tag."""

    def inside(page, node):
        while node >= 0 and page.tag[node] != tag:
            node = page.parent[node]
        return node >= 0

    return inside


#: Marks a content text in a drawn layout; a private-use character that is taken out before training.
_MARK = "\ue000"
_FILL = ["Words of a sentence stand here and go on for a while.", "Another one follows, as texts do.", "Short one."]


def draw_layout(rng: random.Random, content: list[str], other: list[str]) -> str:
    """An HTML page of a random layout that holds the given texts; content texts carry a mark."""
    hint = rng.random() < 0.75
    esc = lambda s: html.escape(s, quote=False)

    def some(texts, n, words=None):
        picked = [rng.choice(texts or _FILL) for _ in range(n)]
        return [esc(" ".join(t.split()[:words]) if words else t) for t in picked]

    def name(group):
        if not hint or rng.random() < 0.15:
            return rng.choice(["", ' class="row"', ' class="box c2"', ' id="x1"'])
        word = rng.choice(NAMES[group].split())
        shape = rng.choice(["{}", "{}-wrap", "site-{}", "{}_box", "page {}", "c-{}"]).format(word)
        return f' {rng.choice(["class", "id", "class"])}="{shape}"'

    def links(n):
        return [f'<a href="/{k}">{t}</a>' for k, t in enumerate(some(other, n, rng.randint(1, 3)))]

    def linklist(n):
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{a}</li>" for a in links(n)) + "</ul>", lambda: " | ".join(links(n)), lambda: "".join(f"<p>{a}</p>" for a in links(n))])()

    def menu():
        body = linklist(rng.randint(2, 9))
        return rng.choice([f"<nav>{body}</nav>", f"<div{name('menu')}>{body}</div>", f'<div role="navigation">{body}</div>', f"<nav{name('menu')}>{body}</nav>"])

    def head():
        body = rng.choice(["", f"<h1{name('head')}>{some(other, 1, 3)[0]}</h1>", f"<p>{some(other, 1, 5)[0]}</p>", f"<h1>{some(other, 1, rng.randint(1, 3))[0]}</h1>", f'<a href="/">{some(other, 1, 2)[0]}</a>']) + rng.choice(["", menu()])
        return rng.choice([f"<header>{body}</header>", f"<header{name('head')}>{body}</header>", f"<div{name('head')}>{body}</div>"])

    def foot():
        body = rng.choice(["&copy; ", "© 2020 ", "", "&copy;"]) + some(other, 1, rng.randint(2, 14))[0] + rng.choice(["", linklist(rng.randint(1, 4))])
        return rng.choice([f"<footer>{body}</footer>", f"<footer{name('foot')}><p>{body}</p></footer>", f"<div{name('foot')}>{body}</div>"])

    def side():
        body = "".join(rng.choice(["<{0}>{1}</{0}>".format(rng.choice(["h2", "h3", "h4"]), some(other, 1, 3)[0]), linklist(rng.randint(2, 6)), f"<p>{some(other, 1, rng.randint(3, 25))[0]}</p>"]) for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<aside>{body}</aside>", f"<aside{name('side')}>{body}</aside>", f"<div{name('side')}>{body}</div>"])

    def always(group):
        return f' class="{rng.choice(NAMES[group].split())}{rng.choice(["", "-1", " wide", "-inner"])}"'

    def notice():
        body = f"<p>{some(other, 1, rng.randint(4, 30))[0]}</p>" + rng.choice(["", "<button>OK</button>", f"<a href='#'>{some(other, 1, 2)[0]}</a>"])
        return rng.choice([f"<div{always('notice')}>{body}</div>", f'<section role="dialog"{always("notice")}>{body}</section>', f"<aside{always('notice')}>{body}</aside>"])

    def advert():
        text = some(other, 1, rng.randint(2, 25))[0]
        return rng.choice([f"<div{always('ad')}>{text}</div>", f"<div{always('ad')}><p>{text}</p><a href='/buy'>{some(other, 1, 2)[0]}</a></div>", f"<aside{always('ad')}>{text}</aside>", f"<p{always('ad')}>{text}</p>"])

    def form():
        inner = f"<label>{some(other, 1, 3)[0]}</label><input name=q>" + rng.choice(["", f"<p>{some(other, 1, 12)[0]}</p>", "<textarea>x</textarea>"]) + rng.choice(["<button>Go</button>", "<input type=submit>"])
        return f"<form{rng.choice(['', always('form')])}>{inner}</form>"

    def comments():
        h = rng.choice(["h2", "h3", "h4"])
        one = lambda: rng.choice(["<li>{}</li>", "<div class='comment'>{}</div>", "<article class='comment'>{}</article>"]).format(rng.choice(["", f"<b>{some(other, 1, 1)[0]}</b> ", f"<h4>{some(other, 1, 2)[0]}</h4>"]) + "".join(f"<p>{t}</p>" for t in some(content, rng.randint(1, 2), rng.randint(4, 60))))
        body = rng.choice(["", f"<{h}>{some(other, 1, 2)[0]}</{h}>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<section{always('comment')}>{body}</section>", f"<div{always('comment')}><ol>{body}</ol></div>", f"<aside{always('comment')}>{body}</aside>"])

    def share():
        return f"<div{always('share')}>{linklist(rng.randint(2, 5))}</div>"

    def main():
        out = []
        c = lambda words=None: _MARK + some(content, 1, words)[0]
        title = f"<h1>{c(rng.randint(2, 12))}</h1>"
        out.append(rng.choice([title, title, f"<header>{title}</header>", f"<h2>{c(8)}</h2>", ""]))
        style = rng.random()
        if rng.random() < 0.2:  # a short one, which its place and names alone tell
            body = title + "".join(f"<p>{c(rng.randint(1, 3))}</p>" for _ in range(rng.randint(0, 3)))
            return rng.choice([f"<article>{body}</article>", f"<main>{body}</main>", f"<div class='{rng.choice(['content', 'article', 'post', 'entry'])}'>{body}</div>"])
        for _ in range(rng.randint(1, 12)):
            k = rng.random()
            if k < 0.6:
                text = c(rng.choice([None, None, None, rng.randint(1, 8)]))
                if rng.random() < 0.2:
                    text += f' <a href="/z">{c(3)}</a> {c(6)}'
                out.append(f"<p>{text}</p>" if style < 0.7 else f"<div>{text}</div>" if style < 0.85 else f"{text}<br><br>")
            elif k < 0.7:
                out.append("<ul>" + "".join(f"<li>{c(rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif k < 0.77:
                out.append(f"<h2>{c(rng.randint(1, 8))}</h2>")
            elif k < 0.82:
                out.append(f"<blockquote>{rng.choice(['{}', '<p>{}</p>']).format(c())}</blockquote>")
            elif k < 0.86:
                out.append(f"<figure><img src=a><figcaption>{c(10)}</figcaption></figure>")
            elif k < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{c(rng.randint(1, 4))}</td><td>{c(rng.randint(1, 5))}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif k < 0.92:
                out.append(f"<pre>{c()}</pre>")
            else:
                out.append(rng.choice([advert, advert, side, share, form, notice])())
        if rng.random() < 0.1:
            out.append(comments())
        body = "".join(out)
        return rng.choice(
            [f"<article>{body}</article>", f"<article{name('content')}>{body}</article>", f"<main>{body}</main>", f"<div{name('content')}>{body}</div>", f"<section{name('content')}><div>{body}</div></section>", f"<main><article>{body}</article></main>", f"<div>{body}</div>"]
        )

    body = [f() for f in rng.sample([menu, head, notice, advert, form, side], rng.randint(0, 4))]
    core = main()
    if rng.random() < 0.25:
        core += comments()
    if rng.random() < 0.3:
        core = rng.choice([f"<div{name('content')}>{core}{side()}</div>", f"<div>{side()}{core}</div>", f"<table><tr><td>{side()}</td><td>{core}</td></tr></table>"])
    body.append(core)
    body += [f() for f in rng.sample([foot, foot, side, notice, share, form, advert], rng.randint(0, 4))]
    if rng.random() < 0.6:
        body.append(foot())
    return f"<html><head><title>{some(other, 1, 4)[0]}</title></head><body>{''.join(body)}</body></html>"


def training_texts(pages: DataFrame, limit: int, blocks: int = 12, chars: int = 500) -> tuple[list[str], list[str]]:
    """Texts inside and outside the article of at most `limit` pages that mark one, chosen by a hash of the page."""
    marks = pages.select("html").where(F.lower("html").contains("<article"))
    code = F.xxhash64("html")
    step = max(1, marks.count() // (4 * limit))
    picked = marks.withColumn("code", code).where(F.pmod("code", F.lit(step)) == 0).orderBy("code", "html").limit(limit).select("html")

    def cut(batches):
        for batch in batches:
            inside, outside = [], []
            for source in batch.column(0).to_pylist():
                page = parse_page(source)
                within = under("article")
                a, b = [], []
                for node, text in zip(page.leaf_of, page.texts, strict=True):
                    (a if within(page, node) else b).append(" ".join(html.unescape(text[:chars]).split()))
                inside.append(a[:blocks])
                outside.append(b[:blocks])
            yield pa.RecordBatch.from_arrays([pa.array(inside, pa.list_(pa.string())), pa.array(outside, pa.list_(pa.string()))], names=["inside", "outside"])

    got = picked.mapInArrow(cut, "inside array<string>, outside array<string>").toArrow()
    return [t for x in got.column(0).to_pylist() for t in x], [t for x in got.column(1).to_pylist() for t in x]


def learn(pages: DataFrame, limit: int = 400, layouts: int = 1000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights from labelled pages: layouts drawn with the texts of at most `limit` of the pages (a bounded sample; plain words if no page marks an article)."""
    content, other = training_texts(pages, limit)
    rng = random.Random(seed)
    trees, labels = [], []
    for _ in range(layouts):
        page, y = labelled(draw_layout(rng, content, other), lambda p, node: _MARK in p.texts[p.leaf_of.index(node)])
        trees.append(page)
        labels.append(y)
    return train(trees, labels)


def main_text(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], batch_chars: int = 4 << 20) -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars (code points).

    A null html is empty, an empty page has an empty text; every row gives one
    row, repeated or not, whatever its page_id and url. Other columns are left
    out. Whole pages are read; a forest holds pages of about `batch_chars`
    characters at a time, or one longer page.
    """
    bounded_batches(pages.sparkSession, 512)

    def run(batches):
        for batch in batches:
            sources = ["" if x is None else x for x in batch.column(2).to_pylist()]
            texts, lo = [], 0
            while lo < len(sources):
                hi, size = lo, 0
                while hi < len(sources) and (hi == lo or size + len(sources[hi]) <= batch_chars):
                    size += len(sources[hi])
                    hi += 1
                trees = [parse_page(s) for s in sources[lo:hi]]
                forest = Forest(trees)
                marginal = forest.infer(*model)[0]
                texts += [page_text(t, marginal[leaves] > 0.5) for t, leaves in zip(trees, forest.leaves, strict=True)]
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


OP11_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS body FROM a
), t AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(body, '&(quot|lt|gt|amp);?', '&\1;', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


@query("op11_tree_page_text", OP11_SQL)
def op11_tree_page_text(spark, sf_dir):
    """The main text of every page (null html: empty).

    The weights are learned from at most 400 of the pages. The SQL reads what
    the given pages mark as their article; the query does not use that mark
    when it decides.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, learn(pages))
