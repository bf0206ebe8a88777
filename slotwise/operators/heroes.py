"""Lead and ranked stories of news front pages, by source.

Python only parses: it gives every place of a page where a lead may stand, in the order in which a source looks, with title and link
as they are. What is a story, its clean title, its URL and the choice are columns over these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import story, text, urls
from ..sources import shared
from . import extract
from .extract import Node, anchor_of, json_scripts, meta, select, tree

# Fixed values.
HEADINGS = "main h1 a[href], main h2 a[href], main h3 a[href]"
#: By source: where to look, in order.
SELECTORS = {
    "abc1": ("main [data-testid='prism-card'] a[data-testid='prism-linkbase'][href]", HEADINGS),
    "cbs1": ("main h4.item__hed a[href]", HEADINGS),
    "usat1": ("main a[href*='/story/']", HEADINGS),
    "nbc1": ("main a[href*='-rcna']", "main a[href*='/live-blog/']", HEADINGS),
    "cnn1": (HEADINGS,),
    "guardian1": ("main a[data-link-name*='group-0'][href]", "main a[href*='/live/']", "main .headline-text"),
    "ap1": ("main a[data-key='main-story'][href]", "main a.Link[href]", HEADINGS),
    "latimes1": ("main h1.promo-title a[href]", "main .promo-title a[href]", "main article h1 a[href]"),
    "npr1": ("main article a[href]", HEADINGS),
    "bbc1": ("main a[data-testid='internal-link'][href*='/news/articles/']", "main a[href*='/news/live/']", "main h2 a[href], main h3 a[href]"),
    "fox1": ("main.main-content-primary article.story-1 a[href]", "main.main-content-primary article a[href]", "main h1 a[href], main h2 a[href]"),
    "yahoo1": ("a[data-ylk*='sec:strm'][data-ylk*='ct:story'][href]", "main a[data-ylk*='ct:story'][href]", "main a[href]"),
}
CBS_DOM = ("#component-latest-news article.item a:has(h4.item__hed)", "#component-latest-news h4.item__hed", "article.item.item--type-updating_story a:has(h4.item__hed)", "h4.item__hed")
FOX_ARTICLES = ("main.main-content-primary article.story-1", "article.story-1", "main.main-content-primary article[class*='story-']", "main article[class*='story-']")
FOX_HEADLINES = (".info .title a[href]", ".info h1 a[href], .info h2 a[href], .info h3 a[href]", "header.info-header .title a[href]", "h1.title a[href], h2.title a[href], h3.title a[href]")
KICKERS = r"(?i)^\s*(tables turned|breaking news|watch live)\s*$"
SITE_TITLE = r"(?i)cbs news \| breaking news, top stories"
CBS_REFUSED = r"(?i)/(videos?|watch|account|privacy|terms)\b"
NBC_STORY = r"(?i)-rcna\d+|/live-blog/"
STORY_TYPES, LIST_TYPE = ("newsarticle", "article", "reportage"), "itemlist"
#: Parts of links and titles that the ranked list leaves out.
RANKED_REFUSED_LINK = r"^$|^javascript:|^mailto:|/video|/live/|/live\?|/live$|/search|/account|/newsletters|/shop|/about|/contact"
RANKED_REFUSED_TITLE = r"sign in|subscribe|watch live|abcnl prime|abc news live"
MOST_PLACES = 24

#: What a place may come from, best first: a source's own reading of its page, the selectors, the page's own title.
OWN_DOM, OWN_DATA, SELECTED, PAGE = range(4)


def _title_of(node: Node) -> str:
    """Text of the first heading, else the label, else the title, else the text."""
    first = next((n for n in node.walk() if n.tag in extract.HEADINGS and n is not node), None)
    return (first.text() if first is not None else "") or node.attrs.get("aria-label", "") or node.attrs.get("title", "") or node.text()


def _cbs(root: Node) -> Iterator[tuple]:
    for selector in CBS_DOM:
        for i, node in enumerate(select(root, selector)):
            if i >= MOST_PLACES:
                break
            a = anchor_of(node)
            if a is not None:
                head = next((n for n in a.walk() if n.tag in extract.HEADINGS and n is not a), None)
                yield OWN_DOM, (head.text() if head is not None else "") or a.attrs.get("aria-label", "") or a.text(), a.attrs.get("href", ""), "", selector
    for doc in json_scripts(root):
        for v in extract.objects(doc):
            url = v.get("url") or v.get("@id") or v.get("mainEntityOfPage") or ""
            title = v.get("headline") or v.get("name") or ""
            if isinstance(url, str) and isinstance(title, str):
                yield OWN_DATA, title, url, "", "cbs_jsonld"


def _nbc(root: Node) -> Iterator[tuple]:
    as_list = lambda x: x if isinstance(x, list) else []
    as_dict = lambda x: x if isinstance(x, dict) else {}
    for doc in list(json_scripts(root, name="__NEXT_DATA__"))[:1]:
        props = as_dict(as_dict(doc).get("props"))
        for at in (as_dict(props.get("pageProps")), props):
            layouts = as_list(as_dict(as_dict(as_dict(at.get("initialState")).get("front")).get("curation")).get("layouts"))
            for raw in (r for layout in layouts for package in as_list(as_dict(layout).get("packages")) for r in as_list(as_dict(package).get("items")) if isinstance(r, dict)):
                item = as_dict(raw.get("item")) or raw
                own = as_dict(raw.get("computedValues")) or as_dict(item.get("computedValues"))
                other = as_list(own.get("headlineAlternatives"))
                title = own.get("headline") or (as_dict(other[0]).get("text") if other else "") or item.get("headline") or item.get("name") or ""
                url = own.get("url") or item.get("url") or ""
                if isinstance(url, dict):
                    url = url.get("primary") or url.get("canonical") or ""
                if isinstance(title, str) and isinstance(url, str):
                    yield OWN_DATA, title, url, "", "nbc_next_data_ordered"
            if layouts:
                return


def _fox(root: Node) -> Iterator[tuple]:
    seen = set()
    for selector in FOX_ARTICLES:
        for i, article in enumerate(select(root, selector)):
            if i >= MOST_PLACES:
                break
            if id(article) in seen:
                continue
            seen.add(id(article))
            kicker = next((n.text() for n in select(article, ".kicker, .kicker-text")), "")
            for inner in FOX_HEADLINES:
                a = next(iter(select(article, inner)), None)
                if a is not None:
                    yield OWN_DOM, re.sub(r"(?i)\s*-\s*Fox News\s*$", "", a.text()), a.attrs.get("href", ""), kicker, f"fox_dom:{selector} {inner}"


OWN = {"cbs1": _cbs, "nbc1": _nbc, "fox1": _fox}


def places(page: str | None, source: str) -> Iterator[tuple]:
    """(tier, order, title, href, kicker, selector) of a source's page, in the order in which it looks."""
    root = tree(page)
    n = 0
    for tier, title, href, kicker, selector in OWN[source](root) if source in OWN else ():
        yield tier, n, title, href, kicker, selector
        n += 1
    for selector in SELECTORS.get(source, (HEADINGS,)):
        for i, node in enumerate(select(root, selector)):
            if i >= extract.MOST_MATCHES:
                break
            a = anchor_of(node)
            if a is not None:
                yield SELECTED, n, _title_of(node), a.attrs.get("href", ""), "", selector
                n += 1
    canonical = next((x.attrs.get("href", "") for x in root.walk() if x.tag == "link" and x.attrs.get("rel") == "canonical"), "")
    yield PAGE, n, meta(root, "og:title"), canonical, "", "meta[og:title]+canonical"


def _rows(pages: DataFrame, id_col: str, make, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Pages (id, source, url, html), some at a time, to rows: id, source, url and what `make` yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in extract.few_pages(batches):
            rows = [(i, s, u, *r) for i, s, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in make(h, s or "", u or "")]
            cols = list(zip(*rows, strict=True)) or [()] * (len(columns) + 3)
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), *(c[1] for c in columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "source", "base", *(c[0] for c in columns)])

    shared.small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col("source_id").cast("string").alias("source"), F.col("url").cast("string").alias("base"), F.col("html").cast("string").alias("body"))
    return rows.mapInArrow(run, f"id {kind}, source string, base string, " + ", ".join(f"{n} {k}" for n, _, k in columns))


S, L = pa.string(), pa.int64()


def _cleaned(raw: DataFrame, *keep: str) -> DataFrame:
    """raw with clean titles and normal URLs. They come out of a generator, so that filters on them don't repeat what makes them."""
    link = urls.absolute(F.col("href"), F.col("base"))
    link = raw.select("id", "source", *keep, "title", link.alias("link"))
    both = F.struct(text.strip_noise(F.col("title")).alias("title"), F.when(F.col("link") != "", urls.normalize_url(F.col("link"))).otherwise("").alias("url"))
    return link.withColumn("x", F.explode(F.array(both))).select("id", "source", *keep, "x.title", "x.url")


def _story_rule() -> Column:
    """Whether a place's link and title are a story by its source's rules."""
    url, title, source, tier = F.col("url"), F.col("title"), F.col("source"), F.col("tier")
    pattern = F.lit("^$")
    for name, hosts, *_ in urls.STORY_RULES:
        pattern = F.when(source == name, hosts).otherwise(pattern)
    at_home = F.regexp_like(urls.host(url), pattern)
    cbs = (urls.path(url) != "/") & ~url.rlike(CBS_REFUSED) & ~title.rlike(SITE_TITLE) & ~((tier == OWN_DATA) & url.rlike(r"(?i)/live\b"))
    kicker = (F.lower(title) == F.lower(text.clean_text(F.col("kicker")))) | title.rlike(KICKERS)
    own = F.when(source == "cbs1", cbs).when(source == "nbc1", url.rlike(NBC_STORY)).otherwise(urls.story_url("fox1", url) & ~kicker)
    link = F.when(tier <= OWN_DATA, own).when((tier == SELECTED) & (source == "yahoo1"), urls.story_url("yahoo1", url)).otherwise(urls.url_allowed(url))
    return parsed_title(title) & at_home & link


def parsed_title(title: Column) -> Column:
    return (title != "") & ~text.title_rejected(title)


def hero_candidates(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """All acceptable leads of pages (id_col, source_id, url, html): id_col, source_id, tier, pos, title, url, selector."""
    raw = _rows(pages, id_col, lambda h, s, u: places(h, s), [("tier", L, "long"), ("pos", L, "long"), ("title", S, "string"), ("href", S, "string"), ("kicker", S, "string"), ("selector", S, "string")])
    return _cleaned(raw, "tier", "pos", "kicker", "selector").where(_story_rule()).select(F.col("id").alias(id_col), F.col("source").alias("source_id"), "tier", "pos", "title", "url", "selector")


def heroes(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row for each page: id_col, source_id, ok, error, title, url, selector_used, candidates (that are acceptable, by distinct URL), slot_key.

    The lead is the first acceptable place: a source's own reading of its page goes before its selectors, these before the page's
    own title. Pages without one, null pages too, have ok false and say so in error. Rows that repeat an id make one row.
    """
    best = hero_candidates(pages, id_col).groupBy(id_col).agg(F.min_by(F.struct("title", "url", "selector"), F.struct("tier", "pos")).alias("x"), F.countDistinct("url").alias("candidates"))
    own = pages.groupBy(id_col).agg(F.min("source_id").alias("source_id"))
    out = own.join(best, id_col, "left")
    ok = F.col("x").isNotNull()
    return out.select(
        id_col, "source_id", ok.alias("ok"), F.when(~ok, F.concat(F.col("source_id"), F.lit(": headline not found"))).alias("error"), F.col("x.title").alias("title"), F.col("x.url").alias("url"), F.col("x.selector").alias("selector_used"),
        F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), story.slot_key(F.col("source_id")).alias("slot_key"),
    )


def _listed(doc) -> Iterator[tuple[str, object]]:
    """(title, link) of stories and of list entries in linked data, in order."""
    for node in extract.objects(doc):
        kinds = node.get("@type")
        kinds = {str(k or "").lower() for k in (kinds if isinstance(kinds, list) else [kinds])}
        if kinds & set(STORY_TYPES):
            page = node.get("mainEntityOfPage")
            yield node.get("headline") or node.get("name") or "", node.get("url") or (page.get("@id") if isinstance(page, dict) else page) or ""
        if LIST_TYPE in kinds and isinstance(node.get("itemListElement"), list):
            for entry in node["itemListElement"]:
                entry = entry if isinstance(entry, dict) else {}
                it = entry.get("item") if isinstance(entry.get("item"), dict) else entry
                yield it.get("headline") or it.get("name") or entry.get("name") or "", it.get("url") or it.get("@id") or entry.get("url") or ""


def ranked_places(page: str | None) -> list[tuple]:
    """(pos, title, href): stories of linked data; with fewer than ten of them, links of main, or else of the page, outside header, nav and footer as well."""
    root = tree(page)
    out = [(" ".join(t.split()), u) for doc in json_scripts(root, most=extract.MOST_LD_ROWS) for t, u in _listed(doc) if isinstance(t, str) and isinstance(u, str) and t.strip() and u.strip()]
    if len(out) >= extract.RANKS:
        return [(i, *r) for i, r in enumerate(out[: extract.MOST_LD_ROWS])]
    top = next((n for n in root.walk() if n.tag == "main"), root)
    for i, a in enumerate(n for n in top.walk() if n.tag == "a" and "href" in n.attrs):
        if i >= extract.MOST_LINKS or len(out) >= extract.MOST_ROWS:
            break
        if any(n.tag in ("header", "nav", "footer") or n.attrs.get("role") == "navigation" for n in a.up()):
            continue
        title, href = " ".join((a.attrs.get("aria-label") or a.text()).split()), a.attrs["href"].strip()
        if len(title) >= extract.LEAST_HEADLINE and not re.search(RANKED_REFUSED_LINK, href.lower()) and not re.search(RANKED_REFUSED_TITLE, title.lower()):
            out.append((title, href))
    return [(i, *r) for i, r in enumerate(out)]


def top10(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The ranked list of pages (id_col, url, html): id_col, rank (1 to 10), title, url, fingerprint, related_links.

    Rows are told by their normal URL, the first wins. A row on the first one's page (origin and path) with an entryId and the same,
    non-blank id leaves the ranking for the first rank's related links: 12 at most, and only such as stand before the tenth rank is filled.
    """
    raw = _rows(pages.withColumn("source_id", F.lit("")), id_col, lambda h, s, u: ranked_places(h), [("pos", L, "long"), ("title", S, "string"), ("href", S, "string")])
    rows = _cleaned(raw, "pos").where((F.col("title") != "") & (F.col("url") != "") & ~F.lower("title").rlike("abcnl prime|abc news live") & ~F.lower("url").rlike("^https://abcnews.com/live/?$"))
    rows = rows.groupBy("id", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    w = Window.partitionBy("id").orderBy("pos")  # 80 rows a page at most
    rows = rows.withColumn("lead", F.first("url").over(w))
    key = lambda c: F.lower(F.concat(urls.scheme(c), F.lit("://"), urls.host(c), urls.path(c)))
    own, first = urls.param(F.col("url"), "id"), urls.param(F.col("lead"), "id")
    kin = urls.parsed(F.col("url")) & (key(F.col("url")) == key(F.col("lead"))) & urls.param(F.col("url"), "entryId").isNotNull() & F.coalesce(own == first, F.lit(False))
    rows = rows.withColumn("kin", kin).withColumn("rank", F.sum(F.when(F.col("kin"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    none = F.array().cast("array<struct<title:string,url:string>>")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    related = F.array_sort(F.collect_list(F.when(F.col("kin") & (F.col("rank") < extract.RANKS), F.struct("pos", "title", "url"))).over(whole))
    rows = rows.withColumn("k", related).where(~F.col("kin") & (F.col("rank") <= extract.RANKS))
    related = F.transform(F.slice("k", 1, extract.MOST_RELATED), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")))
    ranked = rows.withColumn("related", F.when(F.col("rank") == 1, related).otherwise(none))
    return ranked.select(F.col("id").alias(id_col), "rank", "title", "url", story.fingerprint(F.col("url"), text.normalize_title(F.col("title"))).alias("fingerprint"), F.col("related").alias("related_links"))
