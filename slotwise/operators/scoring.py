"""Candidate scoring and picking: additive feature weights by site, then one pick for each page by a total order.

A candidate has page_id, pos (document order), title, url, top_y (null if not laid out) and whatever boolean features its site
names. Geometry is input: it can't be had from static HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values. By site: boolean feature and weight; then layout steps (below this top_y, weight; the first that holds counts)
# and title lengths (from, to, weight).
WEIGHTS: dict[str, dict[str, int]] = {
    "bbc1": {"article_url": 220, "live_url": 120, "live_badge": 140, "numbered_url": 80, "headline": 60, "in_main": 60, "in_hero": 25, "video_url": -220, "in_chrome": -280, "in_utility": -120, "generic_title": -140},
    "fox1": {"in_primary": 90, "in_story": 90, "in_collection": 40, "has_image": 45, "upload_image": 25, "lead_image": 35, "large_image": 25, "in_chrome": -220, "video_url": -220},
    "yahoo1": {"stream_section": 180, "story_type": 120, "headline_element": 120, "need_to_know": 60, "stretched": 25, "in_chrome": -260, "utility_url": -200},
    "npr1": {"curation_click": 40, "curated_story": 80, "first_position": 120, "title_inside": 35, "headline": 20, "in_story": 15, "in_chrome": -160},
    "ap1": {"in_lead": 90, "headline": 40, "first_region": 35, "has_icons": 20, "article_url": 15, "live_url": 36, "lead_live": 24, "in_description": -45, "in_chrome": -140},
    "latimes1": {"in_h1": 80, "promo_title": 40, "in_article": 20, "in_main": 30, "live_url": 35, "story_url": 28, "list_url": 24},
    "usat1": {"hero_class": 160, "live_url": 70, "label": 45, "tracked_title": 35, "has_image": 20, "in_main": 25, "in_chrome": -150},
    "guardian1": {"in_main": 45, "card_class": 30, "first_group": 120, "news_group": 70, "live_group": 170, "live_url": 45, "in_chrome": -140},
    "nbc1": {"in_headline": 100, "headline": 25, "in_main": 30, "skipped_tab": 12, "live_url": 28, "article_url": 35, "numbered_url": 20, "section_url": 20, "in_chrome": -150, "banner": -170, "section_title": -120, "service_title": -30},
    "cnn1": {"in_main": 140, "in_lead": 220, "lead_zone": 180, "headline_inside": 80},
    "abc1": {"headline_id": 140, "meta_link": -40, "watch_live": -220},
}
LAYOUT: dict[str, tuple] = {
    "bbc1": ((900, 55), (1700, 20)), "fox1": ((900, 70), (1700, 25)), "yahoo1": ((900, 70), (1700, 25)), "usat1": ((900, 35), (1700, 15)),
    "guardian1": ((900, 50), (1700, 20)), "nbc1": ((900, 65), (1600, 30)), "cnn1": ((450, 160), (900, 90), (1500, 25)),
}
TITLES: dict[str, tuple] = {
    "bbc1": ((24, 240, 16),), "fox1": ((20, 220, 15),), "yahoo1": ((20, 220, 15),), "npr1": ((24, 240, 10),), "ap1": ((24, 240, 12),), "latimes1": ((24, 240, 10),),
    "usat1": ((24, 260, 20), (12, 320, 10)), "guardian1": ((16, 240, 15),), "nbc1": ((20, 220, 12),),
}
#: Least score of a pick.
LEAST = {"guardian1": -10, "usat1": -20}
#: How a site orders what it scored: by score, then top_y where it is known; latimes1 and cbs1 take the topmost or the first instead.
TOPMOST, FIRST = ("latimes1",), ("cbs1",)
POSITIVE = ("bbc1", "fox1", "yahoo1", "npr1", "ap1", "latimes1")
#: Base scores that fall with the position: by site the first, the step and the least.
ORDINAL = {"abc1": (1500.0, 28.0, 0.0), "cnn1": (11000.0, 3.0, 0.0)}
LEAD_BASE, LEAD_FALL, LEAD_STEP = 260.0, 180.0, 6.0
#: Document order against the last navigation link.
AFTER_NAV, NEAR_NAV, BEFORE_NAV = 220, 120, -320
WINDOW_BELOW, CLUSTER, LIVE_MARGIN = 900, 80, 25


def additive(site: str, present: dict[str, Column], title: Column, top_y: Column | None = None) -> Column:
    """The site's score from the features that are given; those left out are absent."""
    unknown = set(present) - set(WEIGHTS[site])
    if unknown:
        raise ValueError(f"{site} has no features {sorted(unknown)}")
    out = F.lit(0.0)
    for name, weight in WEIGHTS[site].items():
        if name in present:
            out = out + F.when(present[name], float(weight)).otherwise(0.0)
    for least, most, weight in TITLES.get(site, ()):
        out = out + F.when(F.length(title).between(least, most), float(weight)).otherwise(0.0)
    if top_y is not None and site in LAYOUT:
        step = F.lit(0.0)
        for below, weight in reversed(LAYOUT[site]):
            step = F.when(top_y < below, float(weight)).otherwise(step)
        out = out + F.coalesce(step, F.lit(0.0))
    return out


def ordinal(base: float, idx: Column, by: float, least: float = 0.0) -> Column:
    """A score that falls with the position."""
    return F.greatest(F.lit(float(least)), F.lit(float(base)) - idx * float(by))


def after_nav(doc_idx: Column, nav_last: Column) -> Column:
    """Behind the last navigation link 220, and up to 120 more the nearer it is; before it -320; without one 0."""
    delta = doc_idx - nav_last
    return F.coalesce(F.when(delta > 0, F.lit(float(AFTER_NAV)) + F.greatest(F.lit(0.0), float(NEAR_NAV) - F.least(F.lit(float(NEAR_NAV)), delta))).otherwise(F.when(delta <= 0, float(BEFORE_NAV))), F.lit(0.0))


def pick(candidates: DataFrame, order: list, page: str = "page_id") -> DataFrame:
    """One candidate for each page. `order` must end in the document position, as a stable sort would."""
    w = Window.partitionBy(page).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_url(candidates: DataFrame, page: str = "page_id", url: str = "url", pos: str = "pos") -> DataFrame:
    """First wins: of candidates of one URL on a page the earliest stays."""
    w = Window.partitionBy(page, url).orderBy(pos)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def boundary_pick(candidates: DataFrame, prefer: str | None = None) -> DataFrame:
    """Below the page's boundary_y, within 900 if any is, preferred ones if any are, within 80 of the nearest: the best score, then the topmost; if that is still beyond 900, the topmost of all."""
    w = Window.partitionBy("page_id")
    c = candidates.withColumn("distance", F.col("top_y") - F.col("boundary_y")).where("distance >= 0")
    c = c.withColumn("_near", F.col("distance") <= WINDOW_BELOW).withColumn("_any", F.max("_near").over(w)).where("_near or not _any")
    if prefer:
        c = c.withColumn("_best", F.max(prefer).over(w)).where(F.col(prefer) | ~F.col("_best")).drop("_best")
    c = c.withColumn("_least", F.min("distance").over(w))
    kept = c.where(F.col("distance") <= F.col("_least") + CLUSTER)
    far = Window.partitionBy("page_id").orderBy(F.when(F.col("_least") > WINDOW_BELOW, F.col("top_y")), F.desc("score"), "top_y", "pos")
    return kept.withColumn("_n", F.row_number().over(far)).where("_n = 1").drop("_n", "_near", "_any", "_least")


def live_or_article(candidates: DataFrame) -> DataFrame:
    """A live story with a badge wins; else the best article if it is within 25 of the top score; else the top."""
    w = Window.partitionBy("page_id")
    c = candidates.where("score > 0").withColumn("_top", F.max("score").over(w))
    tier = F.when(F.col("is_live") & F.col("live_badge"), 0).when(F.col("is_article") & (F.col("score") >= F.col("_top") - LIVE_MARGIN), 1).otherwise(2)
    return pick(c.withColumn("tier", tier), ["tier", F.desc("score"), "pos"]).drop("_top")


def widest_source(srcset: Column) -> Column:
    """The URL of the widest image of a srcset; the first of equals. Entries without a width count as 0."""
    entries = F.filter(F.transform(F.split(F.coalesce(srcset, F.lit("")), r",\s+|,$"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.transform(entries, lambda x, i: F.struct(F.coalesce(F.regexp_extract(x, r"\s(\d+)w$", 1).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("i"), F.regexp_extract(x, r"^(\S+)", 1).alias("u")))
    return F.array_max(parsed)["u"]


def hero(site: str, candidates: DataFrame) -> DataFrame:
    """A site's lead for each page. candidates: page_id, pos, title, url, top_y, and any of the site's features as boolean columns;
    boundary_y and a `lead` flag for the sites that cut at a boundary, is_live, live_badge and is_article for the one that weighs live stories, nav_last
    for those that go by document order. A page on which nothing scores enough has no row."""
    features = {n: F.coalesce(F.col(n), F.lit(False)) for n in WEIGHTS.get(site, {}) if n in candidates.columns}
    score = additive(site, features, F.col("title"), F.col("top_y")) if site in WEIGHTS else F.lit(0.0)
    if site in ORDINAL:
        score = score + ordinal(ORDINAL[site][0], F.col("pos"), *ORDINAL[site][1:])
    if site == "cnn1":
        score = score - F.least(F.lit(260.0), F.coalesce("top_y", F.lit(0.0)) / 8)
    if site == "ap1" and "boundary_y" in candidates.columns:
        below = F.greatest(F.lit(0.0), F.col("top_y") - F.col("boundary_y")) / LEAD_STEP
        score = F.when(F.col("top_y") >= F.col("boundary_y"), score + LEAD_BASE - F.least(F.lit(LEAD_FALL), below)).otherwise(score)
    if "nav_last" in candidates.columns:
        score = score + after_nav(F.col("pos"), F.col("nav_last"))
    c = first_by_url(candidates.withColumn("score", score))
    if site in POSITIVE:
        c = c.where("score > 0")
    elif site in LEAST:
        c = c.where(F.col("score") > LEAST[site])
    if site in ("nbc1", "guardian1") and "boundary_y" in c.columns:
        return boundary_pick(c, "lead" if site == "nbc1" and "lead" in c.columns else None)
    if site == "bbc1" and {"is_live", "live_badge", "is_article"} <= set(c.columns):
        return live_or_article(c)
    if site in FIRST:
        return pick(c, ["pos"])
    if site in TOPMOST:
        c = c.where(~F.coalesce("in_chrome", F.lit(False))) if "in_chrome" in c.columns else c
        return pick(c, [F.asc_nulls_last("top_y"), F.desc("score"), "pos"])
    return pick(c, [F.desc("score"), F.asc_nulls_last("top_y"), "pos"])


def first_available(picks: list[DataFrame], page: str = "page_id") -> DataFrame:
    """A chain of fallbacks: for each page the row of the first list that has one, with its place in the chain as `tier`."""
    rows = None
    for i, p in enumerate(picks):
        p = p.withColumn("tier", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    return pick(rows, ["tier", "pos"], page)


def banner(candidates: DataFrame, payload: DataFrame) -> DataFrame:
    """Candidates with the title of the payload story of the same comparison key, unless that names a section only; `title` stays where there is none."""
    from ..functions import text, urls

    best = payload.withColumn("_key", urls.compare_key(F.col("url"))).where(~text.section_title(F.col("title")) & (F.length("title") >= text.SHORTEST_TITLE))
    best = best.groupBy("_key").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("_title"))
    return candidates.withColumn("_key", urls.compare_key(F.col("url"))).join(best, "_key", "left").withColumn("title", F.coalesce("_title", "title")).drop("_key", "_title")
