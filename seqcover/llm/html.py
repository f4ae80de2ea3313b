"""Main text of web pages: flat text blocks, classified by a decision tree on words and links of a block and its neighbours.

A page is read as a sequence of blocks: runs of text between block tags, with character references decoded and white
space turned into one space. Of each block the tree sees its words, the share of them in links, the same of the two
blocks before and the two after, whether it is a heading or a paragraph, what its surroundings say of themselves (an
article; a menu, header, footer, sidebar, form, advert or notice; reader comments), and whether the page says any of
this at all. The tree is trained on the labelled pages in html_samples, and again on each of them as it looks when one of
the word lists below or all of them are unknown (SILENCED), so that no list decides by itself: where the markup says
nothing, words and links of the neighbourhood do.

Blocks it takes for main text are joined in page order by one space; nothing is dropped or capped besides. Scripts,
styles, comments, titles and other markup are no text. Null and empty pages have an empty text; a page cut off in the
middle counts as far as it goes, and pages of any length are read whole. Each row is judged by itself: repeated rows
give the same text each, null ids and addresses stay null, other columns are left out, no rows give no rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .html_samples import labelled_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|button|title|object|math|audio|video)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |<[a-zA-Z/!?][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_NESTED = frozenset("article main section div nav header footer aside form ul ol dl table tbody tr td dialog details menu figure body".split())
_APART = frozenset("nav footer aside form dialog menu".split())
_MAIN = frozenset("article main".split())
#: Words by which pages name parts of themselves.
_APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidenav footer header masthead topbar share sharing social related recommended popular trending popup modal overlay widget pagination pager login toolbar copyright disclaimer search form contentinfo complementary".split()
)
_COMMENT_NAMES = frozenset("comment comments commentlist respond response responses reply replies disqus discussion".split())
_MAIN_NAMES = frozenset("article content post entry story main".split())
#: Each word list, and the word lists that the tree must do without in turn.
LISTS = {"apart": _APART, "main": _MAIN, "apart_names": _APART_NAMES, "comment_names": _COMMENT_NAMES, "main_names": _MAIN_NAMES}
SILENCED = [(), *((name,) for name in LISTS), ("main", "main_names"), ("apart", "apart_names", "comment_names"), tuple(LISTS)]
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
APART, COMMENT, MAIN = 1, 2, 4
HEADING, PARAGRAPH = 1, 2
FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after", "words_2_before", "links_2_before", "words_2_after", "links_2_after",
    "paragraph", "heading", "main", "apart", "comment", "page_main", "page_apart",
]
#: Splits that the tree begins with; what a leaf of it has at least of rows and at most of the other kind; and how often pages count as they are, beside once without each list.
FIRST = ["page_main", "page_apart"]
LEAF, MIXED, WHOLE = 4, 0.06, 6


def _says(tag: str, attrs: str, inside: int, lists: dict) -> int:
    """What a tag says of all that is in it."""
    flags = APART if tag in lists["apart"] or tag == "header" and lists["apart"] and not inside & MAIN else MAIN if tag in lists["main"] else 0
    if attrs and "=" in attrs:
        names = {x.lower() for m in _MARKED.finditer(attrs) for x in _NAMES.findall(m[1] or m[2] or m[3] or "")}
        flags |= APART * bool(names & lists["apart_names"]) | COMMENT * bool(names & lists["comment_names"]) | MAIN * bool(names & lists["main_names"])
    return flags


def blocks(page: str, lists: dict = LISTS) -> list[tuple[str, int, int, int]]:
    """Text, words in links, flags of the surroundings, and HEADING, PARAGRAPH or neither, of each block."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    around = own = at = kind = 0
    link = False

    def text(chunk: str) -> None:
        if chunk:
            chunk = html.unescape(chunk)
            parts.append(chunk)
            if link:
                linked.append(chunk)

    def close() -> None:
        if parts:
            if words := "".join(parts).split():
                out.append((" ".join(words), min(len(words), len(" ".join(linked).split())), around | own, kind))
            parts.clear()
            linked.clear()

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                link = not m["end"]
            continue
        close()
        own, kind = 0, 0
        if tag in _NESTED:
            if not m["end"]:
                around |= _says(tag, m["attrs"], around, lists)
                stack.append((tag, around))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                around, link = stack[-1][1] if stack else 0, False
        elif not m["end"]:
            own, kind = _says(tag, m["attrs"], around, lists), PARAGRAPH * (tag == "p") + HEADING * (tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    text(page[at:])
    close()
    return out


def features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """FEATURES of each block of one page; before the first and after the last one stand no words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([x[0].count(" ") + 1 for x in found], float)
    links = np.array([x[1] for x in found]) / words
    flags, kind = np.array([x[2] for x in found]), np.array([x[3] for x in found])
    n = len(found)

    def moved(v: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n)
        out[max(0, -by) : max(0, n - by)] = v[max(0, by) : max(0, n + by)]
        return out

    around = [moved(v, by) for by in (-1, 1, -2, 2) for v in (words, links)]
    page = [np.full(n, (flags & flag > 0).any()) for flag in (MAIN, APART)]
    return np.stack([words, links, *around, kind == PARAGRAPH, kind == HEADING, flags & MAIN > 0, flags & APART > 0, flags & COMMENT > 0, *page], 1).astype(float)


class Tree:
    """Binary splits, first by FIRST (whether the page names anything), then of least Gini impurity, down to leaves with at most MIXED of the other kind, of LEAF rows, or of `depth` levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.depth = depth
        self._grow(x, y.astype(float), depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        here = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0))
        best, level = None, self.depth - depth
        if level < len(FIRST):
            f = FEATURES.index(FIRST[level])
            best = 0.0, f, 0.5
        elif depth and len(y) and MIXED < y.mean() < 1 - MIXED:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(v))
                ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
                if not ok.any():
                    continue
                left, right = t[:-1] / n, (t[-1] - t[:-1]) / (len(v) - n)
                cost = np.where(ok, n * left * (1 - left) + (len(v) - n) * right * (1 - right), np.inf)
                k = int(np.argmin(cost))
                if best is None or cost[k] < best[0] - 1e-12:
                    best = cost[k], f, (v[k] + v[k + 1]) / 2
        if best:
            _, f, at = best
            low = x[:, f] <= at
            a, b = self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)
            self.nodes[here] = (f, at, a, b, self.nodes[here][4])
        return here

    def main(self, x: np.ndarray) -> np.ndarray:
        f, at, a, b, p = (np.array(c) for c in zip(*self.nodes, strict=True))
        node = np.zeros(len(x), np.int64)
        while len(x) and (f[node] >= 0).any():
            inner = f[node] >= 0
            node = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f[node], 0)] <= at[node], a[node], b[node]), node)
        return p[node] > 0.5


def trained(pages: list[str] | None = None) -> Tree:
    """From labelled pages: a block of them is main text if it starts with "+", and else starts with "-"."""
    x, y = [], []
    for page in labelled_pages() if pages is None else pages:
        for silent in SILENCED:
            found = blocks(page, LISTS | dict.fromkeys(silent, frozenset()))
            times = 1 if silent else WHOLE
            x += [features(found)] * times
            y += [b[0][0] == "+" for b in found] * times
    return Tree(np.concatenate(x), np.array(y))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    tree = trained()

    def each(batch: pa.RecordBatch) -> dict:
        found = [blocks(x or "") for x in batch.column("html").to_pylist()]
        rows = np.concatenate([features(x) for x in found]) if found else np.zeros((0, len(FEATURES)))
        verdict = iter(tree.main(rows).tolist())
        made = [" ".join(b[0] for b in own if next(verdict)) for own in found]
        return {"page_id": batch.column("page_id").cast(pa.int64()), "url": batch.column("url"), "text": made, "n_chars": [len(x) for x in made]}

    return common.arrow_map(pages.select("page_id", "url", "html"), each, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))
