"""Leads of rendered front pages: each site's ordered chain of fallbacks, as one table of steps evaluated in one pass over all sites' candidates.

A candidate is a place that the browser laid out: page_id, source_id, family (which of the site's ways of looking found it), idx (place within that way,
from 0), pos (document order), title, url (absolute), top_y, boundary_y (where the header ends), nav_last (position of the last navigation link), image, and
`features`, the names of what holds of it. Further columns are ignored. A page is page_id, source_id, page_text and scripts (texts of its inline scripts); one whose text reads
as blocked has no lead.

For each candidate the steps that accept it become rows (step, score, order); a page's lead is the least of these. Only the cluster below a boundary,
the weighing of live stories and a page's own keys need the other rows of the page: these are windows over one page, and a page has few hundred rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import story, text, urls
from . import scoring

# Fixed values.
#: What the lead candidates of a storyline site weigh, over their base.
STORYLINE = {"single_storyline": 110, "lead_storyline": 80, "lead_headline": 170, "lead_column": 160, "image_lead": 90, "headline": 30, "article_url": 35, "live_url": 10}
STORYLINE_BASE, STORYLINE_FALL, STORYLINE_STEP = 180.0, 120.0, 8.0
QUICK = {"below": 95, "above": -25, "fall": 300, "step": 10, "in_main": 40, "storyline": 95, "places": 15, "title": 20}
PAYLOAD = {"base": 700, "fall": 500, "step": 3, "live": 90, "article": 35, "title": 12}
ABC_BASES = {"first_link": 900, "live_block": 700, "heading": 500}
YAHOO_TARGET = 500
WEAK = {
    "cnn1": r"(?i)^(cnn underscored|watch|listen|subscribe|sign in|live tv)$",
    "nbc1": r"(?i)^(live|live updates|latest stories|updates|watch live)$",
    "yahoo1": r"(?i)\b(about our ads|privacy policy|terms of service|advertise with us|ad choices)\b",
}
TOPICS = r"(?i)^(olympics|politics|u\.?s\.?\s*news|world|health|sports|business|science|latest stories|live updates|calendar|newsletter|medal tracker)$"
UTILITIES = r"(?i)(live updates|latest stories|calendar|newsletter|medal tracker|stream on peacock|watch live)"
TOPIC_URL = r"(?i)^https?://(www\.)?nbcnews\.com/(olympics|politics|us-news|world|health|sports|business|science|tech-media)/?$"
ARTICLE_URL = r"(?i)/live-blog/|-rcna\d+|/\d{4}/\d{2}/\d{2}/"
LIVE_BLOG, VIDEO_URL = r"(?i)/live-blog/", r"(?i)/(video|now/video|video/shorts)/"
NEWS_URL = r"(?i)/news/|cbsnews\.com/"
LEAD_IMAGE = r"(?i)/prod-hp\.foxnews\.com/images/.*/720/405/|/720/405/.*/prod-hp\.foxnews\.com/images/"
BLOCKED_TEXT = r"(?i)verify you are human|captcha|access denied|forbidden|request blocked"
INLINE_HEADLINE = r'"headline":"([^"]{12,240})"[\s\S]{0,600}?"url":\{"primary":"(https:\\/\\/www\.nbcnews\.com\\/[^"]+)"'
INLINE_LEAST = 2000
STREAM_LIST = r'(?s)"ntk":\s*\[(.*?)\],\s*"spaceId"'
LIVE_PATH = r"(?i)/news/live/"
#: A rendered page of this site takes more links than its static one: all but these.
NBC_REFUSED = r"(?i)/(account|search|tips|newsletters|video/shorts)(/|$)"
#: Features that a URL or a title has, by site; they need not be named among a row's features.
OF_URL = {
    "bbc1": {"article_url": r"(?i)/news/articles/", "live_url": LIVE_PATH, "numbered_url": r"(?i)^https?://(www\.)?bbc\.(com|co\.uk)/news/[a-z-]+-\d+$", "video_url": r"(?i)/news/(videos|av)/"},
    "nbc1": {"live_url": LIVE_BLOG, "article_url": ARTICLE_URL, "numbered_url": r"(?i)-rcna\d+", "section_url": r"(?i)/(us-news|world|politics|news|sports|business|health|science)/"},
    "fox1": {"video_url": r"(?i)/video/"},
    "yahoo1": {"utility_url": r"(?i)/(search|account|mail|weather)\b"},
    "latimes1": {"live_url": r"(?i)/live(/|$)|/live-updates(/|$)", "story_url": r"(?i)/story/", "list_url": r"(?i)/list(/|$)"},
}
OF_TITLE = {"bbc1": {"generic_title": r"(?i)^(live|video|latest|news|bbc news)$"}, "nbc1": {"section_title": text.SECTION_TITLE, "service_title": r"(?i)watch live|newsletter"}}
ABOVE_NAV = 20

PAGE = ["page_id", "source_id"]


def has(name: str) -> Column:
    return F.array_contains("features", name)


def any_of(*names: str) -> Column:
    return F.arrays_overlap("features", F.array(*map(F.lit, names)))


def weighed(site: str, **found: Column) -> Column:
    """The site's additive score of the features that hold, its title lengths and its layout steps."""
    own = {n: F.col("url").rlike(p) for n, p in OF_URL.get(site, {}).items()} | {n: F.col("title").rlike(p) for n, p in OF_TITLE.get(site, {}).items()} | found
    return scoring.additive(site, {n: own.get(n, has(n)) for n in scoring.WEIGHTS[site]}, F.col("title"), F.col("top_y"))


def fall(distance: Column, most: float, step: float) -> Column:
    return F.least(F.lit(float(most)), F.coalesce(distance, F.lit(0.0)) / float(step))


def topic_banner() -> Column:
    """A link that names a topic and leads to its section, not to a story."""
    url, article = F.col("url"), F.col("url").rlike(ARTICLE_URL)
    return F.trim("title").rlike(TOPICS) | F.col("title").rlike(UTILITIES) | url.rlike(TOPIC_URL) | (url.rlike(r"(?i)/collection/") & ~article) | (has("in_topics") & ~article)


def weak_title(site: str, title: Column) -> Column:
    return (F.length(title) < text.SHORTEST_TITLE) | title.rlike(WEAK[site])


@dataclass(frozen=True)
class Step:
    """A way to the lead: the families it reads, what it accepts, the score, which must be above `least`, and the order, a key of ORDERS."""

    name: str
    families: tuple[str, ...]
    where: Callable[[], Column] = field(default=lambda: F.lit(True))
    score: Callable[[], Column] = field(default=lambda: F.lit(0.0))
    least: float | None = None
    order: str = "score, topmost"
    #: Below boundary_y only, the best of the cluster next to it; of those with one of the preferred features if there are any.
    boundary: bool = False
    preferred: tuple[str, ...] = ()
    #: Of one URL the first only, before the order.
    first_url: bool = False
    #: The top unless it is live without a badge, or no live story is near it.
    live: bool = False


#: Two numbers each, least first and nulls last; then idx and pos decide.
ORDERS = {
    "score, topmost": ("-score", "top_y"), "score": ("-score", "null"), "place": ("idx", "pos"), "selector": ("selector", "idx"), "topmost": ("top_y", "null"), "position": ("pos", "null"), "score, place": ("-score", "idx"),
}


def _title(least: int) -> Column:
    return F.length("title") >= least


def _abc_card() -> Column:
    return F.lit(1500.0) - F.col("idx") * 28 + F.when(has("headline_id"), 140.0).otherwise(0.0) - F.when(has("meta_link"), 40.0).otherwise(0.0) - F.when(F.col("title").rlike(r"(?i)\bwatch live\b"), 220.0).otherwise(0.0)


def _abc() -> Column:
    base = F.when(F.col("family") == "card", _abc_card())
    for name, points in ABC_BASES.items():
        base = base.when(F.col("family") == name, float(points))
    return base


def _storyline() -> Column:
    out = F.lit(STORYLINE_BASE) - fall(F.col("top_y") - F.col("boundary_y"), STORYLINE_FALL, STORYLINE_STEP)
    for name, weight in STORYLINE.items():
        held = {"article_url": F.col("url").rlike(ARTICLE_URL), "live_url": F.col("url").rlike(LIVE_BLOG)}.get(name, has(name))
        out = out + F.when(held, float(weight)).otherwise(0.0)
    return out


def _quick() -> Column:
    below = F.col("top_y") - F.col("boundary_y")
    out = F.when(below >= 0, float(QUICK["below"])).otherwise(float(QUICK["above"])) - fall(F.abs(below), QUICK["fall"], QUICK["step"])
    for held, points in ((has("in_main"), QUICK["in_main"]), (has("in_headline"), QUICK["storyline"]), (F.length("title").between(24, 220), QUICK["title"])):
        out = out + F.when(held, float(points)).otherwise(0.0)
    return out + F.greatest(F.lit(0.0), F.lit(float(QUICK["places"])) - F.col("_quick"))


def _payload() -> Column:
    out = F.lit(float(PAYLOAD["base"])) - F.least(F.lit(float(PAYLOAD["fall"])), (F.col("idx") + 1) * float(PAYLOAD["step"]))
    for held, points in ((F.col("url").rlike(LIVE_BLOG), PAYLOAD["live"]), (F.col("url").rlike(ARTICLE_URL), PAYLOAD["article"]), (F.length("title").between(18, 240), PAYLOAD["title"])):
        out = out + F.when(held, float(points)).otherwise(0.0)
    return out


def _cnn() -> Column:
    return F.lit(11000.0) - F.col("selector") * 1000 - F.col("idx") * 3 + weighed("cnn1") - fall(F.col("top_y"), 260, 8)


def _nav(site: str) -> Column:
    return weighed(site) + scoring.after_nav(F.col("pos"), F.col("nav_last"))


def _yahoo() -> Column:
    return _nav("yahoo1") + F.when(has("target"), float(YAHOO_TARGET)).otherwise(0.0)


def _ap_lead() -> Column:
    return F.lit(scoring.LEAD_BASE) + weighed("ap1") - fall(F.greatest(F.lit(0.0), F.col("top_y") - F.col("boundary_y")), scoring.LEAD_FALL, scoring.LEAD_STEP)


#: By site, its steps in order; a step is asked if those before it found nothing.
CHAINS: dict[str, tuple[Step, ...]] = {
    "abc1": (Step("best_family", ("card", "first_link", "live_block", "heading"), lambda: ~F.col("family").isin("card", "heading") | _title(12), _abc, order="score"),),
    "cbs1": (Step("headline_element", ("headline",), order="place"), Step("first_heading", ("heading",), lambda: _title(12) & (F.col("idx") < 60) & F.col("url").rlike(NEWS_URL), order="place")),
    "nbc1": (
        Step("boundary_cluster", ("lead",), score=_storyline, boundary=True, preferred=("lead_column", "image_lead", "lead_headline")),
        Step("quick_link_story", ("anchor",), lambda: _title(20) & F.col("_quick").isNotNull(), _quick),
        Step("quick_link", ("quick",), lambda: _title(8) & (F.col("idx") == F.col("_first_quick")), order="place"),
        Step("payload", ("payload",), lambda: ~F.col("url").rlike(VIDEO_URL), _payload, order="score, place"),
        Step("story_anchor", ("anchor",), lambda: ~topic_banner(), lambda: weighed("nbc1"), least=-10),
        Step("any_anchor", ("anchor",), score=lambda: weighed("nbc1", banner=topic_banner()), least=-10),
        Step("inline_script", ("script",), lambda: ~topic_banner() | F.col("url").rlike(ARTICLE_URL), order="place"),
    ),
    "cnn1": (Step("direct_lead", ("direct",), lambda: ~weak_title("cnn1", F.col("title")), order="selector"), Step("selectors", ("anchor",), lambda: ~weak_title("cnn1", F.col("title")), _cnn, first_url=True)),
    "guardian1": (Step("boundary_cluster", ("anchor",), lambda: _title(15), lambda: weighed("guardian1"), scoring.LEAST["guardian1"], boundary=True),),
    "usat1": (Step("ranked", ("anchor",), score=lambda: weighed("usat1"), least=scoring.LEAST["usat1"]),),
    "ap1": (
        Step("lead_promo", ("lead",), lambda: F.col("top_y") >= F.greatest(F.lit(0.0), F.coalesce("boundary_y", F.lit(0.0)) - ABOVE_NAV), _ap_lead),
        Step("ranked", ("anchor",), score=lambda: weighed("ap1"), least=0, order="score"),
    ),
    "latimes1": (
        Step("topmost_editorial", ("editorial",), lambda: ~any_of("in_chrome", "streaming"), order="topmost"),
        Step("ranked", ("anchor",), lambda: ~any_of("in_chrome", "streaming"), lambda: weighed("latimes1"), 0, "score"),
    ),
    "npr1": (Step("ranked", ("anchor",), score=lambda: weighed("npr1"), least=0, order="score"),),
    "bbc1": (Step("live_or_article", ("anchor",), score=lambda: weighed("bbc1"), least=0, order="score", live=True),),
    "fox1": (
        Step("lead_image", ("anchor",), lambda: F.col("image").rlike(LEAD_IMAGE) & (F.col("nav_last").isNull() | (F.col("pos") > F.col("nav_last"))), lambda: _nav("fox1"), 0, "position"),
        Step("ranked", ("anchor",), score=lambda: _nav("fox1"), least=0, order="score"),
    ),
    "yahoo1": (
        Step("ranked", ("anchor",), lambda: ~F.col("title").rlike(WEAK["yahoo1"]), _yahoo, 0, "score"),
        Step("inline_script", ("script",), lambda: ~F.col("title").rlike(WEAK["yahoo1"]), order="place"),
    ),
}


def is_story() -> Column:
    """Whether a URL, in its parts _parsed, _host and _path, is a story by the rule of the row's source. abc1 and cbs1 ask for a link only."""
    out = F.when(F.col("source_id").isin("abc1", "cbs1"), F.lit(True))
    for name, hosts, accept, refuse in urls.STORY_RULES:
        if name in CHAINS and name not in ("abc1", "cbs1"):
            path = ~F.col("url").rlike(NBC_REFUSED) if name == "nbc1" else F.col("_path").rlike(accept) & ~F.col("_path").rlike(refuse)
            out = out.when(F.col("source_id") == name, F.col("_host").rlike(hosts) & path)
    return F.col("_parsed") & F.coalesce(out, F.lit(False))


def inline_stories(pages: DataFrame) -> DataFrame:
    """Stories that stand in the texts of inline scripts, as candidates of family `script`: headline and URL pairs of long scripts (nbc1), objects of the stream's list (yahoo1).

    All by expressions: a script is not parsed, only searched. Null scripts give nothing.
    """
    each = pages.where(F.col("source_id").isin("nbc1", "yahoo1")).select(*PAGE, F.posexplode("scripts").alias("_script", "body"))
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(INLINE_HEADLINE), F.lit(1)).alias("title"), F.regexp_extract_all("body", F.lit(INLINE_HEADLINE), F.lit(2)).alias("url"))
    nbc = F.transform(F.when(F.length("body") >= INLINE_LEAST, pairs), lambda x: F.struct(x["title"].alias("title"), F.replace(F.replace(x["url"], F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")).alias("url")))
    # Between the list's brackets, objects follow each other; each is read as JSON, broken ones have neither field.
    objects = F.split(F.regexp_extract("body", STREAM_LIST, 1), r"(?<=\}),(?=\{)")
    yahoo = F.transform(objects, lambda x: F.struct(F.get_json_object(x, "$.title").alias("title"), F.get_json_object(x, "$.url").alias("url")))
    found = each.select(*PAGE, "_script", F.posexplode(F.when(F.col("source_id") == "nbc1", nbc).otherwise(yahoo)).alias("_n", "x"))
    place = (F.col("_script").cast("long") * 1_000_000 + F.col("_n")).alias("idx")
    return found.where("x.title is not null and x.url is not null").select(*PAGE, F.lit("script").alias("family"), place, place.alias("pos"), "x.title", urls.absolute(F.col("x.url"), F.lit("https://www.yahoo.com/news/")).alias("url"))


OPTIONAL = {"idx": "long", "top_y": "double", "boundary_y": "double", "nav_last": "long", "image": "string", "selector": "long", "features": "array<string>"}
_PAGE_STEP = [*PAGE, "_step"]


def _prepared(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """All candidates, those of scripts too, with clean titles; stories of pages that aren't blocked; and what the page's other rows say of them."""
    names = [*PAGE, "family", "pos", "title", "url", *OPTIONAL]
    rows = candidates.withColumns({n: F.lit(None).cast(k) for n, k in OPTIONAL.items() if n not in candidates.columns}).select(*names)
    rows = rows.unionByName(inline_stories(pages), allowMissingColumns=True)
    rows = rows.withColumns({"title": text.clean_text(F.col("title")), "features": F.coalesce("features", F.array().cast("array<string>")), "idx": F.coalesce(F.col("idx").cast("long"), F.lit(0).cast("long"))})
    open_ = pages.where(~(F.coalesce(F.col("source_id") == "yahoo1", F.lit(False)) & F.coalesce(F.col("page_text").rlike(BLOCKED_TEXT), F.lit(False)))).select(*PAGE).distinct()
    # The parts of a URL come out of a generator: each is made once, not for every rule.
    url = F.col("url")
    parts = F.struct(urls.parsed(url).alias("_parsed"), urls.host(url).alias("_host"), F.lower(urls.path(url)).alias("_path"), F.when(F.col("source_id") == "nbc1", urls.compare_key(url)).alias("_key"))
    rows = rows.withColumn("u", F.explode(F.array(parts))).select(*names, "u.*").where((F.col("title") != "") & is_story()).drop("_parsed", "_host", "_path").join(open_, PAGE)
    same = Window.partitionBy(*PAGE, "_key")
    quick, page = F.when(F.col("family") == "quick", F.col("idx")), Window.partitionBy(*PAGE)
    strong = F.when((F.col("family") == "payload") & ~weak_title("nbc1", F.col("title")), F.struct("idx", "title"))
    return rows.withColumns({"_quick": F.min(quick).over(same), "_refined": F.min(strong).over(same)["title"], "_first_quick": F.min(quick).over(page)})


def lead_rows(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every row that a step of its site accepts: page_id, source_id, _step, step, score, o1, o2, idx, pos, title, url, _refined."""
    rows = _prepared(pages, candidates)
    asked, score, o = [], F.lit(None).cast("double"), [F.lit(None).cast("double")] * 2
    steps = [(site, number, s) for site, each in CHAINS.items() for number, s in enumerate(each)]
    for at, (site, number, s) in reversed(list(enumerate(steps))):
        flags = [F.lit(v).alias(n) for n, v in (("boundary", s.boundary), ("first_url", s.first_url), ("live", s.live), ("step", s.name), ("order", s.order))]
        one = F.struct(F.lit(at).alias("at"), F.lit(number).alias("_step"), F.lit(s.least).cast("double").alias("least"), *flags, (any_of(*s.preferred) if s.preferred else F.lit(False)).alias("preferred"))
        asked.append(F.when((F.col("source_id") == site) & F.col("family").isin(*s.families) & F.coalesce(s.where(), F.lit(False)), one))
        score = F.when(F.col("at") == at, s.score().cast("double")).otherwise(score)
    rows = rows.withColumn("s", F.explode(F.array_compact(F.array(*asked)))).select(*rows.columns, "s.*")
    # Scores come out of a generator, so that what compares them doesn't repeat them.
    distance = F.when(F.col("boundary"), F.col("top_y") - F.coalesce("boundary_y", F.lit(0.0)))
    rows = rows.withColumn("s", F.explode(F.array(F.struct(score.alias("score"), distance.alias("distance"))))).select(*PAGE, "idx", "pos", "title", "url", "top_y", "features", "selector", "_refined", "_step", "least", "boundary", "first_url", "live", "step", "order", "preferred", "s.*")
    for name, (first, second) in ORDERS.items():
        o = [F.when(F.col("order") == name, F.expr(x).cast("double")).otherwise(y) for x, y in zip((first, second), o, strict=True)]
    rows = rows.where("least is null or score > least").withColumns({"o1": o[0], "o2": o[1]})
    rows = rows.where("not boundary or distance >= 0")
    w = Window.partitionBy(*_PAGE_STEP)
    # Cluster below the boundary: within the window if any is, else the topmost of all; preferred ones if there are any; near the nearest.
    rows = rows.withColumn("_any", F.max(F.col("distance") <= scoring.WINDOW_BELOW).over(w)).where(f"not boundary or not _any or distance <= {scoring.WINDOW_BELOW}")
    rows = rows.withColumn("_best", F.max("preferred").over(w)).where("not boundary or not _any or preferred or not _best")
    rows = rows.withColumn("_least", F.min("distance").over(w)).where(f"not boundary or not _any or distance <= _least + {scoring.CLUSTER}")
    far = F.col("boundary") & ~F.col("_any")
    rows = rows.withColumns({"o1": F.when(far, F.col("top_y")).otherwise(F.col("o1")), "o2": F.when(far, F.lit(None)).otherwise(F.col("o2"))})
    first = F.row_number().over(Window.partitionBy(*_PAGE_STEP, F.when(F.col("first_url"), F.col("url")).otherwise(F.concat_ws("|", "idx", "pos", "url", "title"))).orderBy("selector", "idx", "pos"))
    rows = rows.withColumn("_n", first).where("_n = 1")  # rows that are repeated go as well
    # Live stories: the top one stays if it is live and has a badge; else the best that isn't live if it is within the margin of the top.
    ranked = w.orderBy(F.desc("score"), "idx", "pos")
    live = F.col("url").rlike(LIVE_PATH)
    rows = rows.withColumns({"_place": F.row_number().over(ranked), "_top": F.max("score").over(w)})
    tier = F.when((F.col("_place") == 1) & live & F.array_contains("features", "live_badge"), 0).when(~live & (F.col("score") >= F.col("_top") - scoring.LIVE_MARGIN), 1).otherwise(2)
    rows = rows.withColumn("tier", F.when(F.col("live"), tier).otherwise(0))
    return rows.select(*PAGE, "_step", "step", "tier", "score", "o1", "o2", "idx", "pos", "title", "url", "_refined")


def heroes(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row for each page: page_id, source_id, ok, error, title, url, step (which way found it), score, candidates (rows that step had), slot_key.

    Repeated pages and candidates count once. Null titles, URLs and features are as if empty; unknown sources, pages without candidates and blocked pages have ok
    false and say so in error. A lead whose URL a payload of its page titles better takes that title (nbc1).
    """
    rows = lead_rows(pages, candidates)
    last = lambda c: F.struct(F.col(c).isNull(), F.col(c))
    order = F.struct("_step", "tier", last("o1"), last("o2"), "idx", "pos", "url", "title")
    counts = rows.groupBy(*PAGE, "_step").agg(F.count("*").alias("n"), F.min_by(F.struct("step", "score", "url", F.coalesce("_refined", "title").alias("title")), order).alias("x"))
    best = counts.groupBy(*PAGE).agg(F.min_by(F.struct("n", "x"), "_step").alias("b"))
    blocked = F.coalesce(F.col("source_id") == "yahoo1", F.lit(False)) & F.coalesce(F.col("page_text").rlike(BLOCKED_TEXT), F.lit(False))
    own = pages.groupBy(*PAGE).agg(F.max(blocked).alias("blocked"))
    out = own.join(best, PAGE, "left")
    ok = F.col("b").isNotNull()
    why = F.concat(F.coalesce("source_id", F.lit("")), F.when(F.col("blocked"), ": blocked or interstitial challenge").otherwise(": top story not found"))
    return out.select(
        *PAGE, ok.alias("ok"), F.when(~ok, why).alias("error"), F.col("b.x.title").alias("title"), urls.normalize_url(F.col("b.x.url")).alias("url"), F.col("b.x.step").alias("step"), F.col("b.x.score").alias("score"),
        F.coalesce("b.n", F.lit(0).cast("long")).alias("candidates"), story.slot_key(F.col("source_id")).alias("slot_key"),
    )
