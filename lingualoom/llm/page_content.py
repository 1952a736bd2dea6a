"""The lines of a page that carry its own article.

A page is a tree: containers (div, nav, article ...) hold other containers and lines of text. Each node has a hidden
role (navigation, aside, article, headline, paragraph, byline ...). The roles form a tree-structured graphical model:
a potential for every parent and child, and for every node one that sums what its tag, class, links, length and words
say. Messages pass from the leaves upward and from the root downward (sum-product), which gives exact marginals of
every node; a line is content if the roles headline, subheading, paragraph and list item together have more than half.
Pages whose tags are gone become a tree without branches, each line the child of the line before, with potentials of
their own.

The potentials are trained on labelled pages: those whose markup is plain enough for the rules of ``ARTICLE_BOXES`` and
``BOXES`` to name the role of every node, among the ``MAX_PAGES`` pages of smallest hash of the key. The same pages without their
tags train the branchless model. Scoring covers all pages and all of their lines.

Defined results: null, empty and blank pages have no lines; lines with tags only never count; a page without labelled
pages to learn from (an empty or wholly disguised corpus) is judged by the smoothed potentials of the rules alone;
repeated pages count each; unclosed tags end with what holds them; any length is read whole; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of so many pages those that the rules can label train the potentials.
MAX_PAGES = 2500

BOX_ROLES = ("wrap", "nav", "aside", "teaserbox", "cookie", "foot", "comments", "article", "list", "navlist", "errorbox")
CONTENT_ROLES = ("headline", "subheading", "paragraph", "item")
LINE_ROLES = (
    *CONTENT_ROLES, "title", "navlink", "crumb", "asidehead", "teaser", "teasertext", "cookieline", "footline", "share",
    "commenthead", "comment", "byline", "credit", "ad", "readalso", "errorhead", "errortext", "other",
)
ROLES = (*BOX_ROLES, *LINE_ROLES)
_ROLE = {r: k for k, r in enumerate(ROLES)}
_CONTENT = [_ROLE[r] for r in CONTENT_ROLES]
_FREE = [_ROLE[r] for r in ("paragraph", "comment", "teasertext")]
_N_BOX = len(BOX_ROLES)

#: Markup by which sites name their boxes: (tag or None, attribute words of which one suffices), and the role.
BOXES: list[tuple[str | None, frozenset[str], str]] = [
    ("nav", frozenset(), "nav"), (None, frozenset({"navi", "navigation", "menu"}), "nav"),
    ("aside", frozenset(), "aside"), (None, frozenset({"randspalte", "sidebar"}), "aside"),
    (None, frozenset({"teaser"}), "teaserbox"), (None, frozenset({"cookie-banner", "cookies"}), "cookie"),
    ("footer", frozenset(), "foot"), (None, frozenset({"fuss", "footer"}), "foot"),
    (None, frozenset({"kommentare", "comments"}), "comments"),
]
#: Markup of the box that holds the article.
ARTICLE_BOXES: list[tuple[str | None, frozenset[str]]] = [
    ("article", frozenset({"sectbody", "articleBody"})), ("main", frozenset({"inhalt"})),
    ("div", frozenset({"artikel_details", "content", "inhalt", "copy"})),
]

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*[\"']([^\"']*)[\"']")
_LINK = re.compile(r"<a\b[^<>]*>(.*?)(?:</a>|$)", re.S)
_ANY_TAG = re.compile(r"<[^<>]*>")
_WORDS = re.compile(r"[^\W\d_]+|\d+|[©›|:]")
_DISGUISED = re.compile(r"^x?[0-9a-f]{5,}$")
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
_INLINE = frozenset("a b i em strong span u s small sub sup abbr code mark time cite q font label".split())
_LINE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li title button td th dt dd figcaption".split())


class Page:
    """Nodes of one page: parallel lists; a box has line number 0."""

    __slots__ = ("parent", "line", "tag", "words", "linked", "text", "flat")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.line: list[int] = [0]
        self.tag: list[str] = ["root"]
        self.words: list[tuple[str, ...]] = [()]
        self.linked: list[bool] = [False]
        self.text: list[str] = [""]
        self.flat = False

    def add(self, parent: int, line: int, tag: str, words: tuple[str, ...], linked: bool = False, text: str = "") -> int:
        self.parent.append(parent)
        self.line.append(line)
        self.tag.append(tag)
        self.words.append(words)
        self.linked.append(linked)
        self.text.append(text)
        return len(self.parent) - 1


def _attributes(raw: str) -> tuple[str, ...]:
    return tuple(w for m in _ATTRIBUTE.findall(raw) for w in m.split()) if raw else ()


def _plain(raw: str) -> str:
    t = _ANY_TAG.sub("", raw) if "<" in raw else raw
    return html.unescape(t).strip() if "&" in t else t.strip()


def parse(source: str) -> Page:
    """The tree of a page; every line with text is a leaf of the box that is open there."""
    page = Page()
    lines = source.split("\n")
    if not any(m[2].lower() not in _INLINE for m in _TAG.finditer(source)):
        page.flat = True
        last = 0
        for k, raw in enumerate(lines, 1):
            if text := _plain(raw):
                last = page.add(last, k, "", (), False, text)
        return page
    stack: list[tuple[int, str]] = [(0, "root")]
    for k, raw in enumerate(lines, 1):
        text = _plain(raw)
        if not text:
            for m in _TAG.finditer(raw):
                _box(page, stack, m)
            continue
        # The line's own element: the last block that opens before its text.
        at, own, attributes = 0, "", ()
        for m in _TAG.finditer(raw):
            if raw[at : m.start()].strip():
                break
            name = m[2].lower()
            if name in _INLINE and not (name == "span" and not own):
                at = m.end()
                continue
            if m[1]:
                _box(page, stack, m)
            else:
                if own and own not in _LINE_TAGS:
                    stack.append((page.add(stack[-1][0], 0, own, attributes), own))
                own, attributes = name, _attributes(m[3])
            at = m.end()
        linked = False
        if "<a" in raw:
            inside = sum(len(_plain(m)) for m in _LINK.findall(raw))
            linked = inside * 10 >= len(text) * 8
        page.add(stack[-1][0], k, own, attributes, linked, text)
        # A box that opened with the line and does not close on it stays open.
        if own and own not in _LINE_TAGS and own not in _INLINE and own not in _VOID and f"</{own}" not in raw.lower():
            stack.append((page.add(stack[-1][0], 0, own, attributes), own))
        for m in _TAG.finditer(raw, at):
            if m[1] and m[2].lower() not in _LINE_TAGS and m[2].lower() != own:
                _box(page, stack, m)
    return page


def _box(page: Page, stack: list[tuple[int, str]], m: re.Match[str]) -> None:
    name = m[2].lower()
    if name in _INLINE or name in _VOID or name in _LINE_TAGS:
        return
    if not m[1]:
        stack.append((page.add(stack[-1][0], 0, name, _attributes(m[3])), name))
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][1] == name:
            del stack[k:]
            return


def _squeezed(text: str) -> str:
    return " ".join(text.lower().split())


def _names(tag: str, words: tuple[str, ...], rule: tuple) -> bool:
    return (rule[0] is None or rule[0] == tag) and (not rule[1] or any(w in rule[1] for w in words))


def label(page: Page) -> list[int] | None:
    """The role of every node by the rules of plainly marked pages; None if the page is not one of these."""
    if page.flat or any(_DISGUISED.match(w) for ws in page.words for w in ws):
        return None
    n = len(page.parent)
    roles = [_ROLE["wrap"]] * n
    title = next((_squeezed(t) for t, g in zip(page.text, page.tag) if g == "title"), "")
    articles = []
    for k in range(1, n):
        above = ROLES[roles[page.parent[k]]]
        if page.line[k]:
            continue
        tag, words = page.tag[k], page.words[k]
        role = next((r for *rule, r in BOXES if _names(tag, words, rule)), None)
        if role is None and any(_names(tag, words, rule) for rule in ARTICLE_BOXES):
            role = "article"
        if role is None:
            role = "wrap"
            if tag in ("ul", "ol", "dl") and above in ("nav", "article"):
                role = "navlist" if above == "nav" else "list"
            elif above != "wrap":
                role = above
            elif not words and tag == "div" and page.tag[page.parent[k]] == "main":
                role = "article"
        if role == "article" and above != "article":
            articles.append(k)
        roles[k] = _ROLE[role]
    if len(articles) != 1:
        return None
    head = next((k for k in range(n) if page.line[k] and page.tag[k] == "h1" and ROLES[roles[page.parent[k]]] == "article"), None)
    if head is None:
        return None
    wrong = _squeezed(page.text[head])[:20] not in title
    if wrong:
        roles = [_ROLE["errorbox"] if r == _ROLE["article"] else r for r in roles]
    for k in range(1, n):
        if not page.line[k]:
            continue
        above, tag, words = ROLES[roles[page.parent[k]]], page.tag[k], page.words[k]
        if tag == "title":
            role = "title"
        elif "pfad" in words or "breadcrumb" in words:
            role = "crumb"
        elif "teilen" in words or "share" in words:
            role = "share"
        elif above in ("nav", "navlist"):
            role = "navlink"
        elif above == "cookie":
            role = "cookieline"
        elif above == "foot":
            role = "footline"
        elif above in ("aside", "teaserbox"):
            role = "asidehead" if tag == "h3" else "teaser" if tag != "p" else "teasertext"
        elif above == "comments":
            role = "commenthead" if tag[:1] == "h" else "comment"
        elif above in ("article", "list", "errorbox"):
            if "autor" in words or "author" in words:
                role = "byline"
            elif "bild" in words or "credit" in words:
                role = "credit"
            elif "ad" in words or tag not in ("h1", "h2", "h3", "h4", "p", "li"):
                role = "ad"
            elif page.linked[k]:
                role = "readalso"
            elif wrong:
                role = "errorhead" if tag == "h1" else "errortext"
            else:
                role = "headline" if tag == "h1" else "subheading" if tag[0] == "h" else "item" if tag == "li" else "paragraph"
        else:
            role = "other"
        roles[k] = _ROLE[role]
    return roles


_BINS = (0, 4, 12, 25, 45, 70, 110, 200, 400)
_CLOSED = {".": "stop", "!": "stop", "?": "stop", "“": "quote", "”": "quote", "…": "dots", ":": "colon"}


def features(page: Page) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Per node the discrete features of markup and of text, and its words."""
    title = next((_squeezed(t) for t, g in zip(page.text, page.tag) if g == "title"), "").partition(" | ")[0]
    out = []
    for k in range(len(page.parent)):
        if not page.line[k]:
            words = page.words[k]
            kind = "class=?" if words and all(_DISGUISED.match(w) for w in words) else "class=" + "/".join(words) if words else "class="
            out.append((("box=" + page.tag[k], kind), ()))
            continue
        text = page.text[k]
        size = len(text)
        bin_ = sum(size > b for b in _BINS)
        shape = (f"size={bin_}", "end=" + _CLOSED.get(text[-1], "open"))
        if not page.flat:
            words = page.words[k]
            kind = "class=?" if words and all(_DISGUISED.match(w) for w in words) else "class=" + "/".join(words) if words else "class="
            same = "title=none" if not title else "title=same" if _squeezed(text) == title else "title=differs"
            shape = ("tag=" + page.tag[k], kind, "linked" if page.linked[k] else "unlinked", same if page.tag[k] in ("h1", "h2") else "title=", *shape)
        out.append((shape, tuple("#" if w[0].isdigit() else w for w in _WORDS.findall(text.lower()))))
    return out


class Model:
    """Log potentials: of nodes per feature and word, of parent and child, of the root's child."""

    def __init__(self, pages: list[tuple[Page, list[int]]]) -> None:
        n = len(ROLES)
        shapes: dict[str, np.ndarray] = {}
        words: Counter[str] = Counter()
        seen = []
        pair = np.zeros((n, n))
        for page, roles in pages:
            found = features(page)
            seen.append((found, roles))
            for k in range(1, len(roles)):
                pair[roles[page.parent[k]], roles[k]] += 1
            for (shape, ws), r in zip(found[1:], roles[1:]):
                for f in shape:
                    shapes.setdefault(f, np.zeros(n))[r] += 1
                words.update(set(ws))
        kept = sorted(w for w, c in words.items() if c > 1)
        self.word = {w: k for k, w in enumerate(kept)}
        counts = np.zeros((len(kept) + 1, n))
        for found, roles in seen:
            for (_, ws), r in zip(found[1:], roles[1:]):
                for w in ws:
                    counts[self.word.get(w, len(kept)), r] += 1
        # Free text may be about anything: its roles share their words and differ by where they stand.
        counts[:, _FREE] = counts[:, _FREE].sum(axis=1, keepdims=True)
        counts += 0.1
        self.words = np.log(counts / counts.sum(axis=0))
        # A word that no page has is the same to all roles.
        self.words -= self.words.mean(axis=1, keepdims=True)
        total = np.zeros(n)
        for _, roles in seen:
            total += np.bincount(roles[1:], minlength=n)
        self.shape = {f: np.log((c + 0.05) / (total + 0.5)) for f, c in shapes.items()}
        self.unseen = np.log(0.05 / (total + 0.5))
        self.unseen = np.maximum(self.unseen - self.unseen.max(), -1.0)
        # Disguised class names were not seen with names, so they stand for any name a role has.
        self.shape["class=?"] = np.log((sum((c for f, c in shapes.items() if f.startswith("class=") and f != "class="), np.zeros(n)) + 0.3) / (total + 1.0))
        pair += 0.02
        self.pair = np.log(pair / pair.sum(axis=1, keepdims=True))
        box = np.arange(n) < _N_BOX
        self.box, self.leaf = np.where(box, 0.0, -60.0), np.where(box, -60.0, 0.0)
        if not pages:
            self._untrained(n)

    def _untrained(self, n: int) -> None:
        """Without labelled pages: only that headings and longer closed lines are content."""
        content, rest = np.full(n, -2.0), np.zeros(n)
        content[_CONTENT] = 0.0
        rest[_CONTENT] = -2.0
        self.shape = {"tag=h1": content, "tag=p": content * 0.5, "end=stop": content, "linked": rest * 2, "size=6": content * 0.5, "size=7": content * 0.5, "size=8": content, "size=9": content}
        self.unseen = np.zeros(n)
        self.words = np.zeros((1, n))

    def unary(self, found: list[tuple[tuple[str, ...], tuple[str, ...]]], memory: dict) -> np.ndarray:
        out = np.empty((len(found), len(ROLES)))
        none = len(self.word)
        rows, ids, starts, sizes = [], [], [], []
        for k, (shape, words) in enumerate(found):
            base = memory.get(shape)
            if base is None:
                base = np.sum([self.shape.get(f, self.unseen) for f in shape], axis=0) + (self.box if shape and shape[0].startswith("box=") else self.leaf)
                memory[shape] = base
            out[k] = base
            if words:
                rows.append(k)
                starts.append(len(ids))
                ids += [self.word.get(w, none) for w in words]
                sizes.append(len(words))
        if rows:
            sums = np.add.reduceat(self.words[ids], starts, axis=0)
            # Words of a line are far from independent: long lines count as if they had but a few.
            size = np.array(sizes, float)[:, None]
            out[rows] += sums * np.minimum(1.0, 3.0 * np.sqrt(size) / size)
        return out


def _log_sum(messages: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log(exp(messages) @ pair) row by row, without under- or overflow."""
    top = messages.max(axis=1, keepdims=True)
    return np.log(np.exp(messages - top) @ pair + 1e-300) + top


def marginals(parent: np.ndarray, unary: np.ndarray, log_pair: np.ndarray) -> np.ndarray:
    """Exact marginals of a forest by sum-product, level by level; parents come before their children."""
    n = len(parent)
    depth = np.zeros(n, dtype=np.int64)
    at = parent.copy()
    alive = np.flatnonzero(at >= 0)
    while len(alive):
        depth[alive] += 1
        at[alive] = parent[at[alive]]
        alive = alive[at[alive] >= 0]
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
    levels = [order[a:b] for a, b in zip(bounds, bounds[1:])]
    pair = np.exp(log_pair)
    inside = unary.copy()
    sent = np.zeros_like(unary)
    for nodes in reversed(levels[1:]):
        sent[nodes] = _log_sum(inside[nodes], pair.T)
        np.add.at(inside, parent[nodes], sent[nodes])
    outside = np.zeros_like(unary)
    for nodes in levels[1:]:
        up = parent[nodes]
        outside[nodes] = _log_sum(outside[up] + inside[up] - sent[nodes], pair)
    both = inside + outside
    both -= both.max(axis=1, keepdims=True)
    p = np.exp(both)
    return p / p.sum(axis=1, keepdims=True)


def flattened(page: Page, roles: list[int]) -> tuple[Page, list[int]]:
    """A labelled page without its tags: its lines as a tree without branches."""
    flat = Page()
    flat.flat = True
    own, last = [roles[0]], 0
    for k in range(1, len(page.parent)):
        if page.line[k] and page.tag[k] != "title":
            last = flat.add(last, page.line[k], "", (), False, page.text[k])
            own.append(roles[k])
    return flat, own


def train(sources: list[str]) -> tuple[Model, Model]:
    """Models of trees and of pages without tags, from those of ``sources`` that the rules can label."""
    trees = []
    for source in sources:
        page = parse(source)
        if (roles := label(page)) is not None:
            trees.append((page, roles))
    return Model(trees), Model([flattened(p, r) for p, r in trees])


def content_lines(sources: list[str | None], models: tuple[Model, Model], memory: tuple[dict, dict]) -> list[list[int]]:
    """Numbers of the lines with content of every page."""
    out: list[list[int]] = [[] for _ in sources]
    pages = {k: parse(s) for k, s in enumerate(sources) if s}
    for flat in (False, True):
        model, known = models[flat], memory[flat]
        parents, unaries, lines, owners, base = [], [], [], [], 0
        for k in pages:
            if flat != pages[k].flat or len(pages[k].parent) < 2:
                continue
            page = pages[k]
            parents.append(np.where(np.array(page.parent) >= 0, np.array(page.parent) + base, -1))
            unaries.append(model.unary(features(page), known))
            lines.append(np.array(page.line))
            owners.append(np.full(len(page.parent), k))
            base += len(page.parent)
        if not base:
            continue
        p = marginals(np.concatenate(parents), np.concatenate(unaries), model.pair)
        line = np.concatenate(lines)
        keep = (line > 0) & (p[:, _CONTENT].sum(axis=1) > 0.5)
        for k, x in zip(np.concatenate(owners)[keep].tolist(), line[keep].tolist()):
            out[k].append(x)
    return out


_AT_ONCE = 256


def _judged(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    models, memory = sent.value, ({}, {})
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            found = content_lines(part.column(1).to_pylist(), models, memory)
            keys = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([keys, pa.array([x for f in found for x in f], pa.int32())], names=["key", "line_no"])


def _sample(own: DataFrame) -> list[str]:
    """The plainly marked among the MAX_PAGES pages of smallest hash: keys are chosen first, so that only chosen pages come to the driver."""
    chosen = own.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(MAX_PAGES)
    # At most MAX_PAGES keys. A key that stands on several pages counts with one of them.
    mine = own.join(F.broadcast(chosen), "key", "left_semi")
    # Disguised names and pages without tags teach nothing.
    plain = mine.filter(F.col("html").rlike(r"<(main|article|div)[ >]") & ~F.col("html").rlike(r'class="x?[0-9a-f]{5,}"'))
    return [r.html for r in plain.groupBy("key").agg(F.min("html").alias("html")).orderBy("key").collect()]


def page_content(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, line_no): the lines, counted from 1, that carry each page's own article."""
    own = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("html")).filter(F.col("html").isNotNull())
    sent = pages.sparkSession.sparkContext.broadcast(train(_sample(own)))
    kind = own.dtypes[0][1]
    return own.mapInArrow(lambda it: _judged(it, sent), f"key {kind}, line_no int").withColumnRenamed("key", key)
