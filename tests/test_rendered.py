"""Leads of rendered pages: each step of each site's chain, and odd input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slotwise.operators import rendered

PAGES = "page_id long, source_id string, page_text string, scripts array<string>"
CANDIDATES = "page_id long, source_id string, family string, idx long, pos long, title string, url string, top_y double, boundary_y double, nav_last long, image string, selector long, features array<string>"
LONG = "A headline that is long enough to count as one"


def c(source, family, idx, url, title=LONG, page=1, pos=None, top_y=None, boundary_y=None, nav_last=None, image=None, selector=None, features=()):
    return (page, source, family, idx, idx if pos is None else pos, title, url, top_y, boundary_y, nav_last, image, selector, list(features))


def leads(spark, candidates, source, text_="", scripts=(), pages=None):
    p = spark.createDataFrame(pages or [(1, source, text_, list(scripts))], PAGES)
    return rendered.heroes(p, spark.createDataFrame(candidates, CANDIDATES)).collect()


CASES: list[tuple] = []


def case(candidates, source, want, text_="", scripts=()):
    """A page of its own; all are asked in one job."""
    n = len(CASES)
    CASES.append(((n, source, text_, list(scripts)), [(n, *x[1:]) for x in candidates], want))


@pytest.fixture(scope="module")
def found(spark):
    for f in (nbc, bbc, fox, yahoo, others):
        f()
    rows = leads(spark, [x for _, r, _ in CASES for x in r], "", pages=[p for p, _, _ in CASES])
    return {r.page_id: (r.step, r.url.split(".com/")[1]) if r.ok else r.error for r in rows}


def test_cases(found):
    assert len(found) == len(CASES) == 30
    wrong = [(p, found[n], want) for n, (p, _, want) in enumerate(CASES) if found[n] != want]
    assert not wrong


NBC = "https://www.nbcnews.com/"


def nbc():
    lead_near = c("nbc1", "lead", 0, NBC + "a-rcna1", top_y=210.0, boundary_y=100.0)
    lead_flag = c("nbc1", "lead", 1, NBC + "b-rcna2", top_y=260.0, boundary_y=100.0, features=["lead_column"])
    above = c("nbc1", "lead", 2, NBC + "c-rcna3", top_y=50.0, boundary_y=100.0, features=["lead_column", "image_lead"])
    far = [c("nbc1", "lead", 0, NBC + "far-rcna1", top_y=1200.0, boundary_y=100.0), c("nbc1", "lead", 1, NBC + "farther-rcna1", top_y=1300.0, boundary_y=100.0, features=["lead_column"])]
    quick = c("nbc1", "quick", 0, NBC + "politics/x?icid=1", title="Topic one")
    match = c("nbc1", "anchor", 5, NBC + "politics/x/", top_y=300.0, boundary_y=100.0)
    payload = [c("nbc1", "payload", 3, NBC + "live-blog/p3"), c("nbc1", "payload", 0, NBC + "plain/p0"), c("nbc1", "payload", 1, NBC + "video/p1")]
    topic = c("nbc1", "anchor", 0, NBC + "health/", title="Health live updates all day long", top_y=20.0, features=["in_headline", "in_main", "headline"])
    anchor = c("nbc1", "anchor", 1, NBC + "d-rcna4", top_y=2000.0)
    script = '{"headline":"A headline from the script itself","k":{},"url":{"primary":"https:\\/\\/www.nbcnews.com\\/e-rcna5?a=1\\u0026b=2"}}' + " " * 2000
    case([lead_near, lead_flag, above, match], "nbc1", ("boundary_cluster", "b-rcna2"))
    case([lead_near, above], "nbc1", ("boundary_cluster", "a-rcna1"))
    case(far, "nbc1", ("boundary_cluster", "far-rcna1"))  # none within the window: the topmost of all
    case([above, quick, match, *payload, anchor], "nbc1", ("quick_link_story", "politics/x"))
    case([quick, *payload, anchor], "nbc1", ("quick_link", "politics/x?icid=1"))
    case([*payload, anchor], "nbc1", ("payload", "live-blog/p3"))
    case([topic, anchor], "nbc1", ("story_anchor", "d-rcna4"))
    case([topic], "nbc1", ("any_anchor", "health"))
    case([above], "nbc1", ("inline_script", "e-rcna5?a=1&b=2"), scripts=["short", script])
    case([above], "nbc1", "nbc1: top story not found", scripts=[script.strip()])


def test_nbc_takes_the_payloads_title(spark):
    rows = [c("nbc1", "lead", 0, NBC + "a-rcna1/", title="Live", top_y=210.0, boundary_y=100.0), c("nbc1", "payload", 0, NBC + "a-rcna1", title="Watch live"), c("nbc1", "payload", 1, NBC + "A-rcna1?x=1", title="The full headline of the story")]
    got = leads(spark, rows, "nbc1")[0]
    assert (got.step, got.title) == ("boundary_cluster", "The full headline of the story")


BBC = "https://www.bbc.com/news/"


def bbc():
    for rows, want in (
        ((("live/x", ["live_badge", "headline", "in_main"]), ("articles/c1", ["headline"])), "live/x"),
        ((("live/x", ["headline", "in_main"]), ("articles/c1", ["headline", "in_main"])), "articles/c1"),
        # A badge helps the top story only: here an article is the top.
        ((("live/x", ["live_badge", "in_chrome"]), ("articles/c1", ["headline", "in_main"])), "articles/c1"),
        # The best article is too far behind a live story without a badge.
        ((("live/x", ["headline", "in_main", "in_hero"]), ("world-us-12345", ["in_hero"])), "live/x"),
        ((("live/x", ["headline", "in_main", "in_hero"]), ("articles/c1", ["in_chrome"])), "live/x"),
    ):
        case([c("bbc1", "anchor", i, BBC + u, features=f) for i, (u, f) in enumerate(rows)], "bbc1", ("live_or_article", "news/" + want))


def fox():
    home, img = "https://www.foxnews.com/", "//prod-hp.foxnews.com/images/a/720/405/x.jpg"
    strong = c("fox1", "anchor", 9, home + "us/strong", nav_last=3, features=["in_primary", "in_story", "lead_image", "has_image"])
    case([strong, c("fox1", "anchor", 12, home + "us/imaged", nav_last=3, image=img)], "fox1", ("lead_image", "us/imaged"))
    case([strong, c("fox1", "anchor", 2, home + "us/imaged", nav_last=3, image=img)], "fox1", ("ranked", "us/strong"))
    case([c("fox1", "anchor", 2, home + "us/above", nav_last=3)], "fox1", "fox1: top story not found")


def yahoo():
    y = "https://www.yahoo.com/"
    a, b = c("yahoo1", "anchor", 5, y + "news/one-story", nav_last=2, features=["stream_section", "story_type"]), c("yahoo1", "anchor", 9, y + "news/target", nav_last=2, features=["target"])
    case([a, b], "yahoo1", ("ranked", "news/target"))
    case([a, b], "yahoo1", "yahoo1: blocked or interstitial challenge", text_="Please verify you are human")
    script = 'x("ntk":[{"title":"About our ads and more","url":"/news/ads-b"},{"title":"broken},{"title":"The story of the stream","url":"/news/c-d"}], "spaceId":1)'
    case([c("yahoo1", "anchor", 0, y + "news/one-story", nav_last=5)], "yahoo1", ("inline_script", "news/c-d"), scripts=[script])


def others():
    abc, cnn, ap, la = "https://abcnews.com/", "https://www.cnn.com/2026/01/05/", "https://apnews.com/article/", "https://www.latimes.com/world/story/"
    case([c("abc1", "card", 0, abc + "a", title="Watch live: " + LONG), c("abc1", "card", 3, abc + "b", features=["headline_id"]), c("abc1", "first_link", 0, abc + "c")], "abc1", ("best_family", "b"))
    case([c("abc1", "card", 0, abc + "a", title="Too short"), c("abc1", "heading", 0, abc + "d"), c("abc1", "live_block", 0, abc + "l", title="Live")], "abc1", ("best_family", "l"))
    cbs = "https://www.cbsnews.com/"
    case([c("cbs1", "heading", 0, cbs + "news/a"), c("cbs1", "headline", 0, cbs + "news/b", title="Short")], "cbs1", ("headline_element", "news/b"))
    case([c("cbs1", "heading", 0, "https://other.com/x"), c("cbs1", "heading", 60, cbs + "news/z"), c("cbs1", "heading", 2, cbs + "news/a")], "cbs1", ("first_heading", "news/a"))
    case([c("cnn1", "direct", 0, cnn + "a", selector=2), c("cnn1", "direct", 4, cnn + "b", selector=1), c("cnn1", "anchor", 0, cnn + "c", selector=0)], "cnn1", ("direct_lead", "2026/01/05/b"))
    # Of one URL the first place counts, though the later one scores more.
    case([c("cnn1", "anchor", 0, cnn + "a", selector=1, top_y=5000.0), c("cnn1", "anchor", 0, cnn + "a", selector=1, pos=7, top_y=0.0, features=["in_main", "in_lead"]), c("cnn1", "anchor", 1, cnn + "b", selector=1, top_y=800.0)], "cnn1", ("selectors", "2026/01/05/b"))
    case([c("cnn1", "direct", 0, cnn + "a", title="CNN Underscored")], "cnn1", "cnn1: top story not found")
    case([c("ap1", "lead", 0, ap + "a", top_y=900.0, boundary_y=100.0), c("ap1", "lead", 1, ap + "b", top_y=85.0, boundary_y=100.0), c("ap1", "lead", 2, ap + "c", top_y=79.0, boundary_y=100.0, features=["in_lead"])], "ap1", ("lead_promo", "article/b"))
    case([c("latimes1", "editorial", 0, la + "a", top_y=900.0), c("latimes1", "editorial", 1, la + "b", top_y=500.0), c("latimes1", "editorial", 2, la + "c", top_y=5.0, features=["streaming"])], "latimes1", ("topmost_editorial", "world/story/b"))


def test_odd_input(spark):
    pages = [(1, "npr1", None, None), (1, "npr1", None, None), (2, None, None, None), (None, "bbc1", None, None), (3, "nowhere", "x", ["y"])]
    rows = [(1, "npr1", "anchor", 0, 0, None, "https://www.npr.org/2026/01/05/x", None, None, None, None, None, None), c("npr1", "anchor", 1, None), c("npr1", "anchor", 2, "https://www.npr.org/2026/01/05/y"), c("npr1", "anchor", 2, "https://www.npr.org/2026/01/05/y"),
            c("nowhere", "anchor", 0, "https://x.org/a", page=3)]
    got = {(r.page_id, r.source_id): (r.ok, r.candidates) for r in leads(spark, rows, "", pages=pages)}
    assert got == {(1, "npr1"): (True, 1), (2, None): (False, 0), (None, "bbc1"): (False, 0), (3, "nowhere"): (False, 0)}
    few = spark.createDataFrame(rows, CANDIDATES).select("page_id", "source_id", "family", "pos", "title", "url", F.lit(1).alias("step"), F.lit(1).alias("score"))
    assert rendered.heroes(spark.createDataFrame(pages, PAGES).withColumn("title", F.lit(1)), few).where("ok").count() == 1
    assert rendered.heroes(spark.createDataFrame([], PAGES), few).count() == 0
