"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (block elements end a block, inline ones do not, unless they say that they are an advert
or hidden). Each block is described by its word count and link density, those of its neighbours, and what its elements say: boilerplate
or article containers, heading, list item. Classes, ids and roles are read from every element, paragraphs, list items, table cells and
inline ones too, and hold as far as that element does. A decision tree, trained by Gini impurity on the small labelled table below, keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|title|textarea|select|option|button|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.I | re.S,
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that others of their kind end without a closing tag: by tag, the open ones that it ends.
LIGHT = frozenset("p li dt dd tr td th thead tbody tfoot caption".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
BOILER = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "fieldset"))
ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role values. Strong ones mark boilerplate anywhere, in an article too, weak ones only outside an article.
STRONG = frozenset(
    "ad ads adv advert advertisement advertising adverts banner-ad sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr comment comments commentlist respond discussion disqus "
    "replies reply sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay "
    "pagination pager copyright legal disclaimer widget widgets toolbar skip search form complementary contentinfo alert alerts "
    "notice notices warning warnings banner banners message messages teaser teasers tags meta outbrain taboola adsense dfp partner partners".split()
)
WEAK = frozenset("header masthead topbar bar side top bottom".split())
#: Words that say what an element is made as, not what it holds: beside strong words they change nothing.
MADE = frozenset("area box block wrap wrapper container list section inner outer panel links link item items buttons button icons group row col unit slot zone left right main site page global primary secondary bar header top bottom offer offers title label form input small sticky fixed mobile desktop".split())
GOOD = frozenset("article content post entry story main maincontent body text articlebody prose".split())
ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)(?!\s*=\s*[\"']?until-found)|(?:^|\s)aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
PART = re.compile(r"[^A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "words_before", "words_after", "links", "links_before", "links_after", "strong", "weak", "article", "heading", "item", "page_has_article")
#: The labelled table: features in the order above, then 1 for main text. Fixed values, written for this tree.
LABELLED = (
    # words, before, after, links x3, strong, weak, article, heading, item, page has article, main text
    (8, 0, 60, 0.0, 0.0, 0.0, 0, 0, 1, 1, 0, 1, 1),
    (60, 8, 40, 0.0, 0.0, 0.1, 0, 0, 1, 0, 0, 1, 1),
    (3, 60, 40, 0.0, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (1, 12, 2, 0.0, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (2, 30, 9, 0.0, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (5, 90, 0, 0.0, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (25, 4, 11, 0.3, 0.0, 0.9, 0, 0, 1, 0, 0, 1, 1),
    (4, 20, 30, 0.0, 0.1, 0.0, 0, 0, 1, 1, 0, 1, 1),
    (9, 20, 12, 0.0, 0.1, 0.0, 0, 0, 1, 0, 1, 1, 1),
    (6, 9, 7, 0.4, 0.0, 0.0, 0, 0, 1, 0, 1, 1, 1),
    (180, 30, 60, 0.02, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 1),
    (11, 0, 200, 0.0, 0.0, 0.0, 0, 1, 1, 1, 0, 1, 1),
    (7, 90, 6, 0.2, 0.0, 0.0, 0, 1, 1, 0, 0, 1, 1),
    (2, 50, 2, 1.0, 0.0, 1.0, 0, 0, 1, 0, 1, 1, 0),
    (2, 2, 2, 1.0, 1.0, 1.0, 0, 0, 1, 0, 1, 1, 0),
    (3, 40, 0, 1.0, 0.0, 0.0, 0, 0, 1, 0, 0, 1, 0),
    (30, 8, 5, 0.0, 0.0, 0.0, 1, 0, 1, 0, 0, 1, 0),
    (60, 60, 60, 0.0, 0.0, 0.0, 1, 0, 1, 0, 0, 1, 0),
    (5, 60, 60, 0.0, 0.0, 0.0, 1, 0, 1, 1, 0, 1, 0),
    (90, 20, 20, 0.0, 0.0, 0.0, 1, 1, 1, 0, 0, 1, 0),
    (2, 60, 30, 0.0, 0.0, 0.0, 1, 0, 1, 0, 1, 1, 0),
    (1, 1, 1, 1.0, 1.0, 1.0, 1, 0, 0, 0, 1, 1, 0),
    (1, 0, 1, 1.0, 0.0, 1.0, 1, 0, 0, 0, 1, 1, 0),
    (9, 1, 8, 0.0, 1.0, 0.0, 1, 0, 0, 0, 0, 1, 0),
    (40, 1, 8, 0.0, 1.0, 0.0, 1, 0, 0, 0, 0, 1, 0),
    (12, 60, 0, 0.0, 0.0, 0.0, 1, 0, 0, 0, 0, 1, 0),
    (9, 1, 60, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (30, 1, 60, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (120, 9, 60, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 1, 0),
    (6, 0, 9, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0, 1, 0),
    (14, 60, 0, 0.0, 0.0, 0.0, 0, 1, 0, 0, 0, 1, 0),
    (5, 50, 12, 0.0, 0.0, 0.3, 0, 0, 0, 0, 1, 1, 0),
    (8, 0, 60, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (7, 1, 45, 0.0, 1.0, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (5, 40, 30, 0.0, 0.0, 0.0, 0, 0, 0, 1, 0, 0, 1),
    (60, 8, 40, 0.0, 0.0, 0.1, 0, 0, 0, 0, 0, 0, 1),
    (120, 3, 3, 0.05, 0.5, 0.9, 0, 0, 0, 0, 0, 0, 1),
    (35, 70, 2, 0.1, 0.0, 1.0, 0, 0, 0, 0, 0, 0, 1),
    (25, 2, 25, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (20, 25, 20, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (4, 50, 60, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (9, 30, 30, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (10, 14, 12, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 1),
    (9, 25, 10, 0.1, 0.0, 0.0, 0, 0, 0, 0, 1, 0, 1),
    (3, 2, 4, 0.0, 1.0, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (2, 2, 3, 1.0, 1.0, 1.0, 0, 0, 0, 0, 1, 0, 0),
    (4, 40, 2, 1.0, 0.0, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (30, 3, 3, 0.9, 1.0, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (22, 5, 6, 0.6, 0.8, 0.5, 0, 0, 0, 0, 0, 0, 0),
    (6, 30, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (8, 2, 0, 0.0, 1.0, 0.0, 0, 0, 0, 0, 0, 0, 0),
    (3, 2, 2, 0.0, 1.0, 1.0, 0, 0, 0, 1, 0, 0, 0),
    (5, 0, 2, 0.0, 0.0, 1.0, 0, 0, 0, 0, 0, 0, 0),
    (5, 40, 3, 0.0, 0.1, 1.0, 0, 1, 0, 0, 0, 0, 0),
    (25, 3, 40, 0.0, 0.9, 0.0, 0, 1, 0, 0, 0, 0, 0),
    (60, 30, 30, 0.0, 0.0, 0.0, 1, 0, 0, 0, 0, 0, 0),
    (12, 60, 20, 0.0, 0.0, 0.1, 1, 0, 0, 0, 0, 0, 0),
    (5, 60, 60, 0.0, 0.0, 0.0, 1, 0, 0, 1, 0, 0, 0),
    (3, 3, 60, 0.3, 0.5, 0.0, 1, 0, 0, 0, 1, 0, 0),
)


class Tree:
    """A binary decision tree; node i is (feature, threshold, left, right) or (-1, label, 0, 0)."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8):
        self.nodes: list[tuple[int, float, int, int]] = []
        self._grow(rows, labels, depth)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return len(y) * 2 * p * (1 - p)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, float(2 * y.sum() >= len(y)), 0, 0))
        best = (self._gini(y) - 1e-9, -1, 0.0)
        if depth and best[0] > 0:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= t
                    cost = self._gini(y[left]) + self._gini(y[~left])
                    if cost < best[0] - 1e-9:
                        best = (cost, f, float(t))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], depth - 1)
            self.nodes[at] = (best[1], best[2], a, self._grow(x[~left], y[~left], depth - 1))
        return at

    def __call__(self, row) -> bool:
        f, t, a, b = self.nodes[0]
        while f >= 0:
            f, t, a, b = self.nodes[a if row[f] <= t else b]
        return bool(t)


def varied(labelled: tuple = LABELLED) -> np.ndarray:
    """The labelled rows, and such as follow from them: what is inside an article or a boilerplate container keeps its label
    whatever the lengths of it and its neighbours."""
    rows = list(labelled)
    for r in labelled:
        if r[6] or r[8]:
            rows += [(w, b, a, *r[3:]) for w in (1, r[0], 70) for b, a in ((r[2], r[1]), (0, r[2]), (r[1], 0), (2, 2), (60, 60), (0, 0))]
    return np.array(rows, float)


@lru_cache(1)
def default_tree() -> Tree:
    table = varied()
    return Tree(table[:, :-1], table[:, -1])


def _hints(attrs: str) -> tuple[bool, bool, bool, bool]:
    """What an element's attributes say of it: hidden, strong, weak, good.

    A name of several words, such as legal-analysis, is strong only if its last word is, or if its other words are strong, weak or
    about the element's make: article text may be about comments, law or sharing. A name that ends with a strong word and else says only
    where it is, such as article-notice or post-meta, is not good.
    """
    hidden = bool(HIDDEN.search(attrs))
    strong = weak = good = False
    for m in ATTR.finditer(attrs) if "=" in attrs else ():
        for name in (m[1] or m[2] or m[3] or "").split():
            whole = [w.lower() for w in PART.split(name) if w]
            words = [w.lower() for w in PART.split(CAMEL.sub(" ", name)) if w]
            for parts in {tuple(whole), tuple(words)}:
                if not parts:
                    continue
                found = [w for w in parts if w in STRONG]
                strong = strong or bool(found) and (parts[-1] in STRONG or all(w in STRONG or w in WEAK or w in MADE for w in parts))
                weak = weak or any(w in WEAK for w in parts)
                placed = parts[-1] in STRONG and all(w in STRONG or w in WEAK or w in MADE or w in GOOD for w in parts)
                good = good or (not placed and any(w in GOOD for w in parts))
    return hidden, strong, weak, good


_hints = lru_cache(4096)(_hints)


def blocks(page: str) -> list[list]:
    """The page's text blocks in order: [text, words, linked words, strong, weak, article, heading, item]."""
    out: list[list] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements that say something: tag, strong, weak, article
    strong = weak = article = heading = item = False
    links = words_linked = 0
    inside = -1  # blocks open within the open link; -1 where a link ends with its block

    def end() -> None:
        nonlocal words_linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append([text, text.count(" ") + 1, words_linked, strong, weak, article, heading, item])
        words_linked = 0

    def add(raw: str) -> None:
        nonlocal words_linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            words_linked += len(text.split())

    def drop(at: int) -> None:
        nonlocal strong, weak, article
        del stack[at:]
        strong, weak, article = stack[-1][1:] if stack else (False, False, False)

    def close(tag: str) -> bool:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                drop(i)
                return True
        return False

    at = 0
    for m in TOKEN.finditer(page):
        a, b = m.span()
        if a > at:
            add(page[at:a])
        at = b
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["close"] else 1
            inside = 0 if links and "href" in m["attrs"].lower() else -1
        elif tag == "br":
            parts.append(" ")
        if tag in INLINE or tag == "br":
            if m["close"]:
                if any(x[0] == tag for x in stack):
                    end()
                    close(tag)
            elif m["attrs"] and tag not in VOID and not m["attrs"].endswith("/"):
                hidden, bad, _, good = _hints(m["attrs"])
                if hidden or (bad and not good and tag != "a"):  # a link's class says how it looks, and its text is judged by density
                    end()
                    strong = True
                    stack.append((tag, strong, weak, article))
            continue
        end()
        if links and tag not in VOID:
            # A link goes on over the blocks within it, and ends with the block that it stands in.
            if inside < 0 or (m["close"] and not inside):
                links = 0
            elif not m["attrs"].endswith("/"):
                inside += -1 if m["close"] else 1
        if not m["close"]:
            # A block ends an open paragraph, and some end what stands before them in their list or table.
            while stack and (stack[-1][0] in ENDS.get(tag, ()) or (stack[-1][0] == "p" and tag not in VOID) or (stack[-1][0] in INLINE and len(stack) > 1 and stack[-2][0] in ("p", *ENDS.get(tag, ())))):
                drop(len(stack) - 1)
        if tag in HEADINGS:
            heading = not m["close"]
        elif tag in ("li", "dt", "dd"):
            item, heading = not m["close"], False
        elif tag in LIGHT or tag in VOID:
            heading = False
        else:
            heading = item = False
        if m["close"]:
            if tag not in VOID:
                close(tag)
            continue
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        hidden, bad, weak_, good = _hints(m["attrs"]) if m["attrs"] and tag not in ("html", "body") else (False, False, False, False)
        if tag in HEADINGS or tag in LIGHT:
            if hidden or (bad and not good):
                strong = True
                stack.append((tag, strong, weak, article))
            continue
        is_article = tag in ARTICLE or (good and not bad and not weak_)
        strong = strong or hidden or tag in BOILER or (bad and not good and tag not in ARTICLE) or (tag == "header" and not article)
        weak = weak or weak_ or tag == "header"
        article = article or is_article
        stack.append((tag, strong, weak, article))
    if at < len(page):
        add(page[at:])
    end()
    return out


def extract(page: str | None, tree: Tree | None = None) -> str:
    """The main text: kept blocks in page order, joined by a line feed."""
    if not page:
        return ""
    tree = tree or default_tree()
    found = blocks(page)
    has = any(b[5] and not b[3] for b in found)
    n = [0, *(b[1] for b in found), 0]
    density = [0.0, *(min(1.0, b[2] / b[1]) for b in found), 0.0]
    kept = []
    for i, b in enumerate(found, 1):
        if tree((n[i], n[i - 1], n[i + 1], density[i], density[i - 1], density[i + 1], b[3], b[4], b[5], b[6], b[7], has)):
            kept.append(b[0])
    return "\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple = LABELLED) -> DataFrame:
    """id_col, url_col, text, n_chars of every row of pages, each judged by itself. Null or empty html gives ''; markup that is never closed runs to the end of the page."""
    table = varied(labelled)
    tree = Tree(table[:, :-1], table[:, -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "at", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("at"), F.col(html_col).cast("string").alias("body"))
    return rows.mapInArrow(run, "id long, at string, text string, n_chars long").withColumnsRenamed({"id": id_col, "at": url_col})
