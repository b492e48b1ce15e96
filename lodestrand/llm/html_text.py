"""HTML main text by a tree-structured graphical model over the DOM.

Block elements of a page form a tree. Each carries a hidden label, content or
boilerplate; a unary potential reads its own features (tag, class words, text
length, link share) and one potential couples it with its parent. Sum-product
messages, upward and then downward, give the exact marginal of each element;
text whose nearest block element is content with probability one half or more
is kept; where none is, the page's dominant block of text stands in (`dominant`).
The weights are trained on labelled pages by maximum likelihood, with expectations from the same messages.

Pages are independent: no shuffle, one pass, time and memory linear in a page.
The labelled pages come from `labelled_pages`, layouts filled with random words,
so the model never reads the corpus it is applied to; `trained` adds pages of a
table with their main texts.

Defined cases: null or empty html gives an empty text and 0 characters; markup
that is not closed, closed twice or cut off is read as far as it goes, and of an
embedded object or form list without an end tag only the tag is left out; a tag
cut off by the page's end has no text; formulas are text; text outside any
element belongs to the page's root; pages of any length are read whole; repeated
rows are independent;
white space is what str.split() splits at, a line break inside a block counts
as such; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: A quote opens a value only after `=`, as in `title="a > b"`; elsewhere it is a character of its own.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Kinds of elements.
INLINE = frozenset("math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded semantics option optgroup a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their text is none of the page's: up to the first end tag, or to the one that matches.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NESTED = frozenset("noscript template select datalist svg object canvas audio video annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LIMITS = frozenset("ul ol dl table article section div main body nav aside".split())
CONTENT_WORDS = frozenset("article content post entry story main body text prose".split())
CLUTTER_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo sidebar side nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot cookie consent notice alert popup modal overlay comment comments reply replies discussion disqus share social related recommended newsletter subscribe signup login search widget toolbar pagination copyright legal".split())
TAG_GROUPS = ({"article", "main"}, {"nav", "menu", "aside", "footer", "header", "form", "button", "fieldset", "dialog"}, {"p", "blockquote", "pre", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"div", "section"}, {"html", "body", ""})
#: Words of classes that only say whether the page has something.
STATE_WORDS = frozenset("has have no not is are with without free open opened closed enabled disabled on off active inactive".split())
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th figcaption".split())
N_FEATURES = 9 + 2 + 5 + 4


@dataclass
class Page:
    """Block elements in document order (a parent before its children) and the text pieces with their element."""

    tag: list[str] = field(default_factory=lambda: [""])
    names: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    blocks: list[list] = field(default_factory=list)  # [element, [pieces]]
    size: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])


class Ends:
    """Where the elements of one name end that hold no text of the page. Tags are looked up once for a page, so unclosed ones cost no search each."""

    def __init__(self, source: str, name: str):
        self.pairs, self.tags, open_at = {}, [], []
        for m in re.finditer(rf"<(/?){re.escape(name)}(?![\w:-])[^>]*(?:>|\Z)", source, re.I):
            if not m.group(1):
                open_at.append(m.start())
                continue
            self.tags.append(m.span())
            if open_at:
                self.pairs[open_at.pop()] = m.end()
        self.nested = name in NESTED

    def after(self, start: int, body: int) -> int | None:
        """The end of the element whose start tag begins at `start` and ends at `body`; None if it has no end tag."""
        if self.nested:
            return self.pairs.get(start)
        k = bisect_left(self.tags, (body, 0))
        return self.tags[k][1] if k < len(self.tags) else None


def parse(source: str) -> Page:
    """Read a page leniently; scripts, styles, comments, embedded objects and form lists leave no text, an unclosed one only its tag."""
    page, stack, links, fresh, at = Page(), [0], 0, True, 0
    n, closed = len(source), {}
    #: Where in the stack the open elements of each name are: no tag looks for what is not open, and each element is closed once.
    places: dict[str, list[int]] = {}

    def close_from(k: int) -> None:
        for element in reversed(stack[k:]):
            places[page.tag[element]].pop()
        del stack[k:]

    def last_of(names: frozenset[str] | tuple[str, ...]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    while at < n:
        m = TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            here = stack[-1]
            piece = html.unescape(piece)
            if fresh or not page.blocks or page.blocks[-1][0] != here:
                page.blocks.append([here, []])
                fresh = False
            page.blocks[-1][1].append(piece)
            page.size[here] += len(piece)
            page.linked[here] += len(piece) if links else 0
            continue
        name, closing = name.lower(), bool(m.group(1))
        if name in RAW or name in NESTED:
            if not closing and not m.group(3).endswith("/"):
                if name not in closed:
                    closed[name] = Ends(source, name)
                end = closed[name].after(m.start(), at)
                # An unclosed script or style goes on to the end of the page, as browsers have it.
                at = end or (n if name in ("script", "style") else at)
            continue
        if name == "br":
            if not fresh and page.blocks:
                page.blocks[-1][1].append(" ")
            continue
        if name in INLINE:
            links = max(0, links + (-1 if closing else 1)) if name == "a" else links
            continue
        fresh = True
        if closing:
            if places.get(name):
                close_from(places[name][-1])
                links = 0
            continue
        if name in CLOSES_P and page.tag[stack[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            close_from(len(stack) - 1)
        if name in SIBLINGS and (k := last_of(SIBLINGS[name])) > last_of(LIMITS):
            close_from(k)
        if name in VOID:
            continue
        page.tag.append(name)
        page.names.append(" ".join(a or b or c for a, b, c in NAMED.findall(m.group(3))) if m.group(3) else "")
        page.parent.append(stack[-1])
        page.size.append(0)
        page.linked.append(0)
        if not m.group(3).endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(len(page.tag) - 1)
    return page


def class_words(names: str) -> set[str]:
    """The words of an element's classes, id and role; a class that states whether something is there, as has-comments or ad-free, says nothing."""
    out: set[str] = set()
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        words = set(re.split(r"[^a-z]+", name))
        if words.isdisjoint(STATE_WORDS):
            out |= words
    return out


def features(page: Page) -> np.ndarray:
    """One row per element: tag group, class words, sizes of its own and its subtree's text, link share, and its part of the page's plain text.

    Plain text is neither linked nor under an element whose tag or class tells of
    clutter; `direct` is that of an element and its paragraph-like children, so
    that the container of an article differs from the wrappers around it.
    """
    n = len(page.tag)
    total, linked = list(page.size), list(page.linked)
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += total[k]
        linked[page.parent[k]] += linked[k]
    out = np.zeros((n, N_FEATURES))
    told, inner, under = [0] * n, [False] * n, [False] * n
    for k in range(n):
        tag, words, up = page.tag[k], class_words(page.names[k]) if page.names[k] else set(), page.parent[k]
        inner[k] = up >= 0 and (inner[up] or page.tag[up] in TAG_GROUPS[0] or told[up] > 0)
        # The head of an article is a part of it.
        head = inner[k] and (tag == "header" or tag not in TAG_GROUPS[1] and "header" in words)
        words = words - {"header"} if head else words
        clutter = not words.isdisjoint(CLUTTER_WORDS)
        told[k] = -1 if clutter or tag in TAG_GROUPS[1] and not head else int(not words.isdisjoint(CONTENT_WORDS))
        under[k] = told[k] < 0 or up >= 0 and under[up]
        out[k, 8 if head else next((g for g, tags in enumerate(TAG_GROUPS) if tag in tags), 8)] = 1
        out[k, 9], out[k, 10] = clutter, told[k] > 0
    plain = [0 if under[k] else page.size[k] - page.linked[k] for k in range(n)]
    direct = list(plain)
    for k in range(n - 1, 0, -1):
        if page.tag[k] in TEXT_TAGS:
            direct[page.parent[k]] += plain[k]
    for k in range(n - 1, 0, -1):
        plain[page.parent[k]] += plain[k]
    for k in range(n):
        share = linked[k] / total[k] if total[k] else 0.0
        out[k, 11] = share
        out[k, 12] = share > 0.5
        out[k, 13] = min(math.log1p(page.size[k]), 8) / 8
        out[k, 14] = min(math.log1p(total[k]), 10) / 10
        out[k, 15] = page.size[k] == 0
        if plain[0]:
            out[k, 16] = plain[k] / plain[0]
            out[k, 17] = direct[k] / plain[0]
            out[k, 18] = direct[k] > 0.5 * plain[0]
        out[k, 19] = inner[k]
    return out


def dominant(page: Page) -> set[int]:
    """The elements of the text block that holds most of a page's plain text: the container with the most direct plain text, and what lies in it outside clutter."""
    x = features(page)
    top = int(np.argmax(x[:, 17]))
    if x[top, 17] < 0.5:
        return set()
    within = {top}
    for k in range(top + 1, len(page.tag)):
        if page.parent[k] in within and not x[k, 9] and not x[k, 1]:
            within.add(k)
    return within


@dataclass(frozen=True)
class Model:
    unary: tuple[float, ...]
    #: Log potentials of (parent, child): both content, neither, only the parent; only the child is 0.
    both: float
    neither: float
    parent_only: float


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def log_odds(page: Page, model: Model) -> list[float]:
    """Log odds of the content marginal of each element, by messages up and down the tree."""
    belief = (features(page) @ np.array(model.unary)).tolist()
    n, parent = len(belief), page.parent
    a, b, c = model.both, model.neither, model.parent_only
    up = [0.0] * n
    for k in range(n - 1, 0, -1):
        up[k] = _add(c, a + belief[k]) - _add(b, belief[k])
        belief[parent[k]] += up[k]
    for k in range(1, n):
        rest = belief[parent[k]] - up[k]
        belief[k] += _add(a + rest, 0.0) - _add(c + rest, b)
    return belief


def train(pages: list[tuple[Page, list[int]]], rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Maximum likelihood: sum-product over all trees at once gives the expected features, level by level."""
    x, y = np.vstack([features(p) for p, _ in pages]), np.concatenate([np.array(own, float) for _, own in pages])
    shifts = np.cumsum([0] + [len(p.tag) for p, _ in pages[:-1]])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for (p, _), s in zip(pages, shifts)])
    depth = np.zeros(len(y), int)
    for k in range(len(y)):
        depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
    levels = [np.nonzero(depth == d)[0] for d in range(1, depth.max() + 1)]
    child = np.nonzero(parent >= 0)[0]
    yp, yc = y[parent[child]], y[child]
    seen = np.array([(yp * yc).sum(), ((1 - yp) * (1 - yc)).sum(), (yp * (1 - yc)).sum()])
    w, pair = np.zeros(x.shape[1]), np.zeros(3)
    m1, m2 = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for t in range(1, rounds + 1):
        a, b, c = pair
        belief, up = x @ w, np.zeros(len(y))
        for at in reversed(levels):
            up[at] = np.logaddexp(c, a + belief[at]) - np.logaddexp(b, belief[at])
            np.add.at(belief, parent[at], up[at])
        below = belief.copy()
        for at in levels:
            rest = belief[parent[at]] - up[at]
            belief[at] = below[at] + np.logaddexp(a + rest, 0.0) - np.logaddexp(c + rest, b)
        rest = belief[parent[child]] - up[child]
        joint = np.stack((a + rest + below[child], np.full(len(child), b), c + rest, below[child]))
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0)).sum(1)
        marginal = 1 / (1 + np.exp(-np.clip(belief, -40, 40)))
        g = np.concatenate((x.T @ (y - marginal), seen - joint[:3])) / len(y) - decay * np.concatenate((w, pair))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, pair = w + step[:-3], pair + step[-3:]
    return Model(tuple(w.tolist()), *pair.tolist())


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Pages of varied layouts with a label for each element: 1 for the article, 0 for all else."""
    r, out = random.Random(seed), []
    words = lambda lo, hi: " ".join("".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))
    links = lambda k: "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))
    for _ in range(n):
        para = lambda: r.choice([f"<p>{words(1, 90)}</p>", f"<p>{words(5, 60)} <a href=x>{words(1, 3)}</a> {words(3, 20)}</p>", f"<p><b>{words(3, 50)}<br>", f"<blockquote>{words(5, 30)}</blockquote>", f"<h2>{words(1, 6)}</h2>", f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(3))}</ul>", f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"])
        clutter = [
            lambda: f"<nav><ul>{links(r.randint(3, 8))}</ul></nav>", lambda: f'<div class="{r.choice(["ad", "advert", "promo banner", "sponsored"])}">{words(3, 40)}</div>',
            lambda: f"<aside>{words(5, 40)}<ul>{links(3)}</ul></aside>", lambda: f'<div class="sidebar"><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></div>',
            lambda: f'<div id="{r.choice(["cookie-notice", "consent", "popup"])}"><p>{words(6, 40)}</p><button>{words(1, 2)}</button></div>',
            lambda: f"<form><p>{words(2, 10)}</p><input name=q><button>{words(1, 1)}</button></form>", lambda: f'<section class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{words(3, 60)}</p></div>' for _ in range(r.randint(1, 5))) + "</section>",
            lambda: f"<footer>&copy; {words(2, 40)}</footer>", lambda: f"<header><div>{words(1, 5)}</div><p>{words(2, 12)}</p></header>", lambda: f'<div class="menu"><ul>{links(5)}</ul></div>', lambda: f'<div class="related"><ul>{links(3)}</ul></div>',
        ]
        opening, closing = r.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article class=post>", "</article></main>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ('<div id="main"><div class="entry-text">', "</div></div>"), ('<section class="story">', "</section>"),
            ("<div>", "</div>"), ("<section>", "</section>"), ('<div class="content ad-free">', "</div>"), ('<article class="post has-comments">', "</article>"), ('<div class="c42">', "</div>"),
        ])
        bare = opening in ("<div>", "<section>", '<div class="c42">')
        title = f"<h1>{words(1, 10)}</h1>"
        inside = [r.choice([title, title, f"<header>{title}<p>{words(2, 8)}</p></header>", f'<header class="entry-header">{title}</header>', f'<div class="entry-header">{title}</div>']) if not bare else title] + [para() for _ in range(r.randint(4 if bare else 1, 20))]
        if bare:
            inside += [f"<p>{words(40, 90)}</p>" for _ in range(3)]
        elif r.random() < 0.1:
            inside = inside[:1] + [f"<p>{' '.join(f'<a href=x>{words(1, 4)}</a>' for _ in range(r.randint(2, 6)))} {words(0, 2)}</p>" for _ in range(r.randint(3, 9))]
        if r.random() < 0.35:
            inside.insert(r.randint(1, len(inside)), f"<!--x-->{r.choice([*clutter[1:7], lambda: f'<div class=c-newsletter-box><p>{words(4, 20)}</p></div>'])()}")
        before, after = "".join(r.choice(clutter)() for _ in range(r.randint(1, 4))), "".join(r.choice([*clutter, lambda: f"<div>{words(3, 20)}</div>"])() for _ in range(r.randint(1, 4)))
        if r.random() < 0.3:
            before, after = "<div id=page><div class=wrap>" + before, after + "</div></div>"
        source = f"<html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body{r.choice(['', '', ' class=\"single comments-open\"'])}>{before}{opening}{''.join(inside)}{closing}{after}</body></html>"
        first = len(parse(f"<html><head></head><body>{before}").tag)
        page = parse(source)
        last = len(parse(source[: source.index(after, source.index(opening, source.index(before)) + len(opening) + sum(map(len, inside)))]).tag)
        heads = {k for k in range(first, last) if page.tag[k] == "header" or "header" in page.names[k]}
        hidden = {k for k in range(first, last) if k not in heads and (page.tag[k] in ("aside", "form", "button", "nav", "footer") or class_words(page.names[k]) & CLUTTER_WORDS)}
        labels = [0] * len(page.tag)
        for k in range(first, last):
            labels[k] = int(k not in hidden and (k == first or page.parent[k] < first or labels[page.parent[k]] == 1))
        out.append((page, labels))
    return out


def labels_of(page: Page, article: str) -> list[int]:
    """Labels of a page's elements from its main text, one block a line: an element is content if more characters under it belong to that text than do not."""
    lines, n = set(article.split("\n")), len(page.tag)
    balance = [0] * n
    for element, pieces in page.blocks:
        t = " ".join("".join(pieces).split())
        balance[element] += len(t) if t in lines else -len(t)
    for k in range(n - 1, 0, -1):
        balance[page.parent[k]] += balance[k]
    return [int(b > 0) for b in balance]


def trained(labelled: DataFrame, source: str = "html", article: str = "text", most: int = 2000) -> Model:
    """A model from labelled pages: `most` of them at most, the first in a hash order, beside the generated layouts."""
    rows = labelled.where(F.col(source).isNotNull() & F.col(article).isNotNull()).select(F.col(source).alias("s"), F.col(article).alias("a"))
    pages = [(parse(r.s), r.a) for r in rows.orderBy(F.xxhash64("s"), "s", "a").limit(most).collect()]
    return train(labelled_pages() + [(p, labels_of(p, a)) for p, a in pages])


def main_text(source: str | None, model: Model) -> str:
    """The blocks of content elements, in page order, one per line."""
    if not source:
        return ""
    page = parse(source)
    odds = log_odds(page, model)
    whole = [(element, " ".join("".join(pieces).split())) for element, pieces in page.blocks]
    kept = [t for element, t in whole if t and odds[element] >= 0]
    if not kept:
        # No element is likelier content than not: a page with one dominant block of text is that block.
        within = dominant(page)
        kept = [t for element, t in whole if t and element in within]
    return "\n".join(kept)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or train(labelled_pages())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return narrow.mapInArrow(work, "page_id long, url string, text string, n_chars long")
