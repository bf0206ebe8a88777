"""Operators on small tables, with ties, repeats, nulls and empty inputs."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from slotwise.functions import story, text
from slotwise.operators import diff, extract, frames, heroes, history, matching, scoring
from slotwise.plans import catalog, ingest, publish
from slotwise.sources import readers, registry, sinks
from slotwise.streaming import streams

ITEMS = "source_id string, run_id string, observed_at timestamp_ntz, rank int, title string, url string, fingerprint string"


def at(minute, day=1):
    return dt.datetime(2026, 2, day, 12, 0) + dt.timedelta(minutes=minute)


def run(name, minute, *stories, source="s"):
    return [(source, name, at(minute), i, t, f"https://x/{f}", f) for i, (f, t) in enumerate(stories, 1)]


def events(df):
    return sorted((r.run_id, r.event_type, r.key, r.from_rank, r.to_rank) for r in df.collect())


def test_diff(spark):
    rows = run("r1", 0, ("a", "A"), ("b", "B"), ("c", "C")) + run("r2", 5, ("b", "B!"), ("a", "A"), ("d", "D"))
    got = events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS)).where("run_id = 'r2'"))
    assert got == [("r2", "EDIT", "b", 2, 1), ("r2", "ENTER", "d", None, 3), ("r2", "EXIT", "c", 3, None), ("r2", "MOVE", "a", 1, 2), ("r2", "MOVE", "b", 2, 1)]
    first = events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS)).where("run_id = 'r1'"))
    assert [e[1] for e in first] == ["ENTER"] * 3


def test_diff_does_not_depend_on_row_order(spark):
    rows = run("r1", 0, ("a", "A"), ("b", "B")) + run("r2", 5, ("b", "B"), ("c", "C")) + run("r3", 9, ("c", "C"))
    assert events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS))) == events(diff.snapshot_diff(spark.createDataFrame(rows[::-1], ITEMS)))


def test_runs_of_one_instant_are_not_compared(spark):
    rows = run("r1", 0, ("a", "A")) + run("r2", 0, ("b", "B")) + run("r3", 5, ("b", "B"))
    prev = {r.run_id: r.prev_run_id for r in diff.previous_runs(spark.createDataFrame(rows, ITEMS)).collect()}
    assert prev == {"r1": None, "r2": None, "r3": "r2"}


def test_failed_runs(spark):
    empty = [("s", "r2", at(5), None, None, None, None)]
    rows = spark.createDataFrame(run("r1", 0, ("a", "A")) + empty + run("r3", 9, ("a", "A")), ITEMS)
    assert [(e[0], e[1]) for e in events(diff.snapshot_diff(rows))] == [("r1", "ENTER"), ("r2", "EXIT"), ("r3", "ENTER")]
    assert [(e[0], e[1]) for e in events(diff.snapshot_diff(rows, skip_failed_runs=True))] == [("r1", "ENTER")]


def test_sources_are_apart(spark):
    rows = run("r1", 0, ("a", "A")) + run("q1", 3, ("b", "B"), source="t") + run("r2", 5, ("a", "A"))
    assert events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS)).where("event_type <> 'ENTER'")) == []


def test_repeated_key_compares_the_last(spark):
    rows = run("r1", 0, ("a", "A"), ("a", "A2")) + run("r2", 5, ("a", "A2"))
    assert events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS)).where("run_id = 'r2'")) == [("r2", "MOVE", "a", 2, 1)]


def test_hero_swaps(spark):
    rows = run("r1", 0, ("a", "A")) + run("r2", 5, ("b", "B")) + [("s", "r3", at(6), 1, "t", "u", None)] + run("r4", 7, ("b", "B"))
    got = {r.run_id: r.hero_swap for r in diff.hero_swaps(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {"r1": False, "r2": True, "r3": False, "r4": False}


OBS = "source_id string, id long, observed_at timestamp_ntz, url string, title string, img string, ok boolean"


def obs(spark, rows):
    return spark.createDataFrame([("s", i, at(m), u, t, g, ok) for i, (m, u, t, g, ok) in enumerate(rows)], OBS)


def test_islands(spark):
    o = obs(spark, [(0, "a", "A", None, True), (1, "a", "A", "g1", True), (2, None, None, None, False), (3, "a", "A", None, True), (4, "a", "A2", None, True), (5, "b", "B", "g", True), (6, "a", "A", None, True)])
    got = [(r.island, r.url, r.title, r.seen_count, r.img) for r in history.islands(o, ["url", "title"], ["img"]).orderBy("island").collect()]
    assert got == [(1, "a", "A", 3, "g1"), (2, "a", "A2", 1, None), (3, "b", "B", 1, "g"), (4, "a", "A", 1, None)]
    since = history.current_since(o.where("id < 5")).first()
    assert (since.url, since.first_seen_at, since.seen_count, since.seconds_in_top) == ("a", at(0), 4, 240)
    assert history.islands(o.limit(0), ["url"]).collect() == []


def test_state_and_changes(spark):
    o = obs(spark, [(0, "a", "A", None, True), (1, "", "A", None, True), (1, None, "A", None, True), (2, None, "E", None, False)])
    s = history.current_state(o, ["url", "title"]).first()
    assert (s.ok, s.stale, s.title, s.updated_at, s.good_at) == (False, True, "A", at(2), at(1))
    assert [r.id for r in history.changed_only(o, ["url", "title", "ok"]).orderBy("id").collect()] == [0, 1, 3]


def test_upsert(spark):
    base, change = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int"), spark.createDataFrame([(1, "x", 1), (2, "y", 4), (3, "z", 1)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in history.upsert(base, change, "k", "n").collect()) == [(1, "x"), (2, "b"), (3, "z")]


def test_frames(spark):
    rows = [(1, "s", at(0), "hero:1", None, "H", "u", "f"), (2, "s", at(1), "top10:2", "", "T2", "u", "f2"), (3, "s", at(2), "top10:1", None, "T1", "u", "f1"), (4, "s", at(3), "hero:1", "run9", "R", "u", "g"), (5, "s", None, "hero:1", None, "x", "u", "g"), (6, "s", at(4), "hero:1", None, "H2", "u", "f")]
    got = {r.frame.split(":")[0]: r for r in frames.frames(spark.createDataFrame(rows, "id long, source_id string, observed_at timestamp_ntz, slot_key string, run_id string, title string, url string, fingerprint string")).collect()}
    assert got["bucket"].hero.title == "H2" and [t.title for t in got["bucket"].top10] == ["T1", "T2"] and got["bucket"].n_rows == 4
    assert got["run"].hero.title == "R" and got["run"].top10 == []


def test_keyword_match_thresholds(spark):
    cases = [(["a", "b", "c"], ["a", "b", "x"], True), (["a", "b"], ["a", "x"], False), (list("abcdef"), list("abcxyz"), True), (list("abcdefgh"), list("abcuvwxy"), False), ([], [], False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    assert [r.m for r in df.select("i", matching.keywords_match(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()] == [c[2] for c in cases]


def test_similar_with_repeats(spark):
    rows = [(0, ["a", "b", "c"]), (1, ["c", "b", "a"]), (20, ["a", "b", "c"]), (3, ["a", "b", "z"]), (4, ["q"]), (5, [])]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    got = {r.id: (r.n_anchors, r.best_anchor, r.best_score) for r in matching.similar(df, df.where("id % 20 = 0")).collect()}
    assert got == {0: (1, 20, 1.0), 20: (1, 0, 1.0), 1: (2, 0, 1.0), 3: (2, 0, 0.5)}


def test_similar_equals_brute_force(spark):
    """Lists of all lengths over words of very uneven frequency, with repeated lists."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    lists = [list(dict.fromkeys(rng.choices(words, weights, k=30)))[: rng.randint(0, 12)] for _ in range(240)]
    rows = list(enumerate(lists + lists[:40]))
    df = spark.createDataFrame(rows, "id long, keywords array<string>")

    def matched(a, b):
        o, u = len(set(a) & set(b)), len(set(a) | set(b))
        return u > 0 and ((o >= 2 and o / u >= 0.24) if min(len(a), len(b)) <= 5 else (o >= 3 and o / u >= 0.30))

    want = {}
    for i, a in rows:
        met = [(round(len(set(a) & set(b)) / len(set(a) | set(b)), 9), -j) for j, b in rows if j % 20 == 0 and i != j and matched(a, b)]
        if met:
            want[i] = (len(met), -max(met)[1], max(met)[0])
    got = {r.id: (r.n_anchors, r.best_anchor, r.best_score) for r in matching.similar(df, df.where("id % 20 = 0")).collect()}
    assert len(want) > 100 and got == want


def test_normal_form_and_cleaning(spark):
    """As if white space were cleaned first, and as if every run of it were replaced."""
    import re

    texts = ["  A\u00a0\u2003b \t c ", " ", "", None, "x y  z", "\ufeffEinÜber Große\u2028Tür—nein ", "a \u00a0", "one\u3000two three"]
    space = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", text.clean_text(F.col("t")).alias("c"), text.normalize_title(F.col("t")).alias("n")).collect():
        clean = re.sub(space, " ", texts[r.i] or "").strip(" ")
        assert r.c == clean
        assert r.n == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", clean.lower(), flags=re.ASCII)).strip(" ")


CAND = "page_id int, pos int, title string, url string, top_y double, boundary_y double, score double, lead boolean"


def test_boundary_pick(spark):
    rows = [(1, 0, "t", "u", 50.0, 100.0, 900.0, True), (1, 1, "t", "u", 150.0, 100.0, 10.0, False), (1, 2, "t", "u", 200.0, 100.0, 50.0, False), (1, 3, "t", "u", 500.0, 100.0, 99.0, False),
            (2, 0, "t", "u", 1500.0, 100.0, 10.0, False), (2, 1, "t", "u", 1560.0, 100.0, 50.0, False), (3, 0, "t", "u", 300.0, 100.0, 1.0, False), (3, 1, "t", "u", 400.0, 100.0, 0.0, True)]
    df = spark.createDataFrame(rows, CAND)
    assert {r.page_id: r.pos for r in scoring.boundary_pick(df, "lead").collect()} == {1: 2, 2: 0, 3: 1}


def test_scores(spark):
    df = spark.createDataFrame([(0, "A headline of some thirty chars", 100.0), (1, "short", None)], "i int, title string, top_y double")
    got = [r.s for r in df.select("i", scoring.additive("bbc1", {"in_main": F.lit(True), "video_url": F.col("i") == 1}, F.col("title"), F.col("top_y")).alias("s")).orderBy("i").collect()]
    assert got == [60 + 16 + 55, 60 - 220]
    with pytest.raises(ValueError, match="no features"):
        scoring.additive("bbc1", {"nonsense": F.lit(True)}, F.col("title"))
    df = spark.createDataFrame([(5, 3), (200, 3), (2, 3), (1, None)], "d int, n int")
    assert [r.s for r in df.select(scoring.after_nav(F.col("d"), F.col("n")).alias("s")).collect()] == [338.0, 220.0, -320.0, 0.0]
    df = spark.createDataFrame([("a.jpg 100w, b.jpg 300w, c.jpg 300w",), ("x.jpg",), (None,)], "s string")
    assert [r.u for r in df.select(scoring.widest_source(F.col("s")).alias("u")).collect()] == ["b.jpg", "x.jpg", None]


def test_live_or_article(spark):
    rows = [(1, 0, 100.0, False, False, True), (1, 1, 120.0, False, False, False), (2, 0, 90.0, False, False, True), (2, 1, 120.0, False, False, False), (3, 0, 10.0, True, True, False), (3, 1, 200.0, False, False, True), (4, 0, 0.0, True, True, False)]
    df = spark.createDataFrame(rows, "page_id int, pos int, score double, is_live boolean, live_badge boolean, is_article boolean")
    assert {r.page_id: r.pos for r in scoring.live_or_article(df).collect()} == {1: 0, 2: 1, 3: 0}


def test_heroes_of_all_sites(spark):
    rows = [(1, 0, "A nav link that is long enough", "https://x/n", 20.0, 100.0, False, True, False), (1, 1, "The leading story of this very day", "https://x/a", 150.0, 100.0, True, False, True),
            (1, 2, "The leading story once again here", "https://x/a", 160.0, 100.0, True, False, False), (1, 3, "A lesser story further down", "https://x/b", 2000.0, 100.0, True, False, False)]
    df = spark.createDataFrame(rows, "page_id int, pos int, title string, url string, top_y double, boundary_y double, in_main boolean, in_chrome boolean, headline boolean")
    df = df.withColumn("is_live", F.lit(False)).withColumn("live_badge", F.lit(False)).withColumn("is_article", F.col("in_main")).withColumn("in_lead", F.col("headline")).withColumn("in_story", F.col("in_main")).withColumn("in_h1", F.col("headline"))
    for site in scoring.WEIGHTS:
        got = [(r.page_id, r.pos) for r in scoring.hero(site, df).collect()]
        assert got == [(1, 0 if site in ("abc1",) else 1)] or site == "yahoo1", site
    ordered = df.withColumn("nav_last", F.lit(0))
    assert [r.pos for r in scoring.hero("fox1", ordered).collect()] == [1] == [r.pos for r in scoring.hero("yahoo1", ordered).collect()]
    assert [r.pos for r in scoring.hero("cbs1", df).collect()] == [0]


def test_fallbacks(spark):
    a = spark.createDataFrame([(1, 3, "x")], "page_id int, pos int, title string")
    b = spark.createDataFrame([(1, 0, "y"), (2, 1, "z")], "page_id int, pos int, title string")
    assert {r.page_id: (r.title, r.tier) for r in scoring.first_available([a, b]).collect()} == {1: ("x", 0), 2: ("z", 1)}


def test_banner_title(spark):
    c = spark.createDataFrame([(1, 0, "Live", "https://x.org/a/?q=1"), (1, 1, "Own", "https://x.org/b")], "page_id int, pos int, title string, url string")
    p = spark.createDataFrame([("A refined headline", "https://x.org/a"), ("Politics", "https://x.org/b")], "title string, url string")
    assert {r.pos: r.title for r in scoring.banner(c, p).collect()} == {0: "A refined headline", 1: "Own"}


def test_publish(spark, tmp_path):
    o = obs(spark, [(0, "https://x/a", "A", None, True), (1, None, None, None, False), (2, "https://x/b", "B", None, True)]).withColumn("slot_key", F.lit("hero:1")).withColumn("error", F.lit(None).cast("string"))
    items = spark.createDataFrame(run("r1", 0, ("a", "A"), ("b", "B")) + run("r2", 5, ("b", "B")), ITEMS)
    publish.publish_all(o, items, "2026-02-01 13:00:00", str(tmp_path))
    read = lambda n: spark.read.json(str(tmp_path / n)).collect()
    assert read("unified")[0].url == "https://x/b" and read("current")[0].slot_key == story.slot_key_of("s")
    assert [r.seen_count for r in sorted(read("history"), key=lambda r: r.island)] == [1, 1]
    assert len(read("timeline")) == 3 and len(read("top10_history")) == 3 and len(read("top10_latest")) == 1
    assert {r.event_type for r in read("top10_events_24h")} == {"ENTER", "EXIT", "MOVE"}
    with pytest.raises(Exception, match="ok"):
        publish.publish_all(o.drop("ok"), items, "2026-02-01 13:00:00", str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad" / "failure")).first().ok is False


BASE = "https://news.example/"


def test_lead_candidates():
    page = """<nav><a href="/politics/x">Politics section here</a></nav><main><h1><a href="/a/story-one">The first headline of it</a></h1><h2><a href="/live/b">A live headline of some length</a></h2>
    <h2><a href="/a/story-one">The first headline once more</a></h2><h2><a href="/c/story-two" aria-label="Another headline label"></a></h2></main>"""
    got = extract.lead_candidates(page, BASE, ["h1 a", "h2 a"])
    assert [(t, u, s) for t, u, s, _ in got] == [("The first headline of it", BASE + "a/story-one", 2000), ("Another headline label", BASE + "c/story-two", 980)]


def test_lead_fallback():
    page = '<head><meta property="og:title" content="The page title"><link rel="canonical" href="/x/y"></head><body></body>'
    assert extract.lead_candidates(page, BASE, ["h1 a"]) == [("The page title", BASE + "x/y", 1, "og:title")]
    assert extract.lead_candidates(None, None, ["a"]) == []


def hero_of(spark, source, html, url):
    df = spark.createDataFrame([(1, source, url, html)], "page_id long, source_id string, url string, html string")
    r = heroes.heroes(df).first()
    return (r.title, r.url, r.selector_used) if r.ok else r.error


def test_own_readings_of_sites(spark):
    cbs = """<script type="application/ld+json">{"@graph":[{"name":"CBS News | Breaking news, top stories","url":"/"},{"headline":"Live from linked data it is","url":"https://www.cbsnews.com/live/x"},{"headline":"One  two from linked data","mainEntityOfPage":"/news/a"}]}</script><script type="application/ld+json">broken</script>"""
    assert hero_of(spark, "cbs1", cbs, "https://www.cbsnews.com/") == ("One two from linked data", "https://cbsnews.com/news/a", "cbs_jsonld")
    dom = '<div id="component-latest-news"><article class="item"><a href="/video/x"><h4 class="item__hed">A video goes by here</h4></a></article><article class="item"><a href="/news/b/"><h4 class="item__hed">The latest of the news</h4></a></article></div>'
    assert hero_of(spark, "cbs1", dom + cbs, "https://www.cbsnews.com/")[:2] == ("The latest of the news", "https://cbsnews.com/news/b")
    nbc = """<main><a href="/x-rcna9">A link of the page itself</a></main><script id="__NEXT_DATA__" type="application/json">{"props":{"initialState":{"front":{"curation":{"layouts":[{"packages":[{"items":[
    {"headline":"Not a story url here","url":"https://www.nbcnews.com/y"},{"item":{"computedValues":{"headlineAlternatives":[{"text":"The story that counts"}],"url":{"primary":"https://www.nbcnews.com/a-rcna123"}}}}]}]}]}}}}}</script>"""
    assert hero_of(spark, "nbc1", nbc, "https://www.nbcnews.com/") == ("The story that counts", "https://nbcnews.com/a-rcna123", "nbc_next_data_ordered")
    assert hero_of(spark, "nbc1", "<main><a href='/x-rcna9'>A link of the page itself</a></main>", "https://www.nbcnews.com/")[1] == "https://nbcnews.com/x-rcna9"
    fox = """<article class="story-1"><span class="kicker">Special coverage tonight</span><div class="info"><h2 class="title"><a href="/politics/kick">Special coverage tonight</a></h2><h3 class="title"><a href="/shows/a-b">A show that is not it</a></h3></div></article>
    <article class="story-2"></article><main class="main-content-primary"><article class="story-3"><div class="info"><h2 class="title"><a href="/politics/real-story">The real headline of the story - Fox News</a></h2></div></article></main>"""
    assert hero_of(spark, "fox1", fox, "https://www.foxnews.com/")[:2] == ("The real headline of the story", "https://foxnews.com/politics/real-story")
    assert hero_of(spark, "fox1", None, "https://www.foxnews.com/") == "fox1: headline not found"


def test_top10_cases(spark):
    links = "".join(f'<a href="/n/story-{i}">Headline number {i} of the day</a>' for i in range(12))
    page = f"""<script type="application/ld+json">[{{"@type":"NewsArticle","headline":"From linked data it is","url":"/ld/1?id=4"}},{{"@type":"Organization","name":"Some organisation","url":"/org"}}]</script><main><nav><a href="/nav/1">A link of the navigation</a></nav>
    <a href="/ld/1?id=4&entryId=5">A related entry of the story</a><a href="/n/x?entryId=5">An entry of another story</a>{links}<a href="/ld/1?id=4&entryId=6">A related entry too late</a></main>"""
    df = spark.createDataFrame([(1, BASE, page), (2, BASE, None)], "page_id long, url string, html string")
    got = sorted(heroes.top10(df).collect(), key=lambda r: r.rank)
    assert len(got) == 10 and (got[0].title, got[0].url) == ("From linked data it is", BASE + "ld/1?id=4") and got[1].url == BASE + "n/x?entryId=5" and got[2].url == BASE + "n/story-0"
    assert [x.url for x in got[0].related_links] == [BASE + "ld/1?entryId=5&id=4"] and got[1].related_links == []
    assert got[2].fingerprint == hashlib.sha1((BASE + "n/story-0|headline number 0 of the day").encode()).hexdigest()


def test_ingest(spark, tmp_path):
    """Two runs of one source: what did not change is not stored again, and the documents tell what did."""
    page = lambda *names: "<main>" + "".join(f"<h2><a href='/US/story-{x}/x'>The headline of story {x}</a></h2>" for x in names) + "</main>"
    make = lambda *r: spark.createDataFrame([(i, "abc1", "https://abcnews.com/", h, t) for i, (h, t) in enumerate(r)], "page_id long, source_id string, url string, html string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    first, second, third = (page("a", "b"), "2026-02-01 10:00:00"), (page("a", "b"), "2026-02-01 11:00:00"), (page("c", "a"), "2026-02-01 12:00:00")
    for part in ((first,), (second,), (second, third)):
        ingest.run(make(*part), str(tmp_path), "2026-02-01 13:00:00")
    read = lambda n: spark.read.parquet(str(tmp_path / n)).collect()
    assert sorted(str(r.observed_at)[11:16] for r in read("attempts")) == ["10:00", "11:00", "12:00"]
    assert sorted(str(r.observed_at)[11:16] for r in read("runs"))[:2] == ["10:00", "12:00"] and '"run_kind":"hero"' in read("runs")[0].raw
    assert len(read("events")) == 3 * 3 and len(read("items")) == 6
    changes = {(r.event_type, r.to_rank) for r in read("changes") if str(r.observed_at)[11:16] == "12:00"}
    assert changes == {("ENTER", 1), ("EXIT", None), ("MOVE", 2), ("HERO_SWAP", None)}
    doc = spark.read.json(str(tmp_path / "published/current")).first()
    assert doc.url == "https://abcnews.com/US/story-c/x" and doc.ok


def test_moment_parameters(spark):
    e = spark.createDataFrame([(1, at(0), "cnn1", "hero:1", "Storms flood the coast", "https://x/a"), (2, at(10), "bbc1", "hero:1", "Coast flood: storms rage", "https://y/b"), (3, at(20), "npr1", "other", "Storms flood the coast", "https://x/a"), (4, at(500), "npr1", "hero:1", "Storms flood the coast", "https://x/a")], "id long, observed_at timestamp_ntz, source_id string, slot_key string, title string, url string")
    got = catalog.moment(e, "2026-02-01 23:00:00", event_id=2)
    assert sorted((r.id, r.source_name) for r in got.collect()) == [(1, "CNN"), (2, "BBC")]
    assert [r.id for r in catalog.moment(e, "2026-02-01 23:00:00", event_id=2, start_earliest=False).collect()] == [2]
    assert catalog.moment(e, "2026-02-01 23:00:00", event_id=99).collect() == []


def test_sinks_and_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    assert sinks.append_new(df, path, "id") == 2 and sinks.append_new(df, path, "id") == 0
    assert readers.relation(spark, path, ["id"], 1).first().id == 1
    assert readers.point(spark.read.parquet(path), "id", 2).count() == 1
    assert readers.cache_state(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "c.json").write_text('{"sources":{"bbc1":{"id":"bbc1","ok":true,"item":{"title":"T","url":"u"}}}}')
    cache = readers.cache_state(spark, str(tmp_path / "c.json"))
    assert cache.first().item.title == "T"
    assert readers.cached_results(cache, registry.sources(spark)).count() == 0
    assert readers.cached_results(cache, registry.sources(spark).where("id = 'bbc1'")).count() == 1
    assert readers.json_or(spark, str(tmp_path / "no.json"), "a int").count() == 0
    picked = readers.pick_columns(spark.createDataFrame([("", "x", None)], "a string, b string, c string"), {"v": ["a", "b"], "w": ["zz", "c"]})
    assert picked.first() == ("x", None)
    sinks.publish(df, str(tmp_path / "out"))
    sinks.failure(spark, str(tmp_path / "bad"), ValueError("no"))
    assert spark.read.json(str(tmp_path / "bad")).first().error == "no"


def test_retry():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("fetch failed")
        return "done"

    assert sinks.with_retry(work, base_ms=1) == "done" and len(calls) == 3
    with pytest.raises(ValueError, match="bad"):
        sinks.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")), transient=lambda e: False)


def test_ranked_event_rows(spark):
    rows = run("r1", 0, *[(f"f{i}", f"T{i}") for i in range(12)])
    df = spark.createDataFrame(rows, ITEMS).withColumn("rank", F.when(F.col("rank") == 3, F.lit("x")).otherwise(F.col("rank").cast("string")))
    assert sinks.ranked_events(df).count() == 11 and sinks.ranked_events(df, batch=True).count() == 10  # the first ten of finite rank
    runs, items = sinks.run_and_items(spark.createDataFrame(rows, ITEMS).drop("run_id"))
    assert runs.count() == 1 and items.select("run_id").distinct().count() == 1


def test_append_changed_looks_at_what_is_stored(spark, tmp_path):
    make = lambda *r: spark.createDataFrame([(i, "s", f"2026-02-01 10:{i:02}:00", t, u, True, None) for i, t, u in r], "id long, source_id string, observed_at string, title string, url string, ok boolean, error string").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    at = str(tmp_path / "runs")
    for rows in ([(1, "a", "u")], [(2, "a", "u")], [(3, "a", "u"), (4, "b", "u")], [(5, "b", "u"), (6, "a", "u")]):
        sinks.append_changed(make(*rows), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [1, 4, 6]


def test_ranked_events_take_the_first_ten(spark):
    items = spark.createDataFrame([("s", "2026-02-01 10:00:00", str(r), f"title {r}", f"https://x.org/{r}") for r in range(5, 20)] + [("s", "2026-02-01 10:00:00", "x", "none", "https://x.org/n")], "source_id string, observed_at string, rank string, title string, url string")
    assert sorted(int(r.slot_key[6:]) for r in sinks.ranked_events(items, batch=True).collect()) == list(range(5, 15))
    assert sinks.ranked_events(items).count() == 15


def test_diff_events_with_swaps(spark):
    items = spark.createDataFrame([("s", r, f"2026-02-01 1{r}:00:00", 1, f"t{k}", f"https://x.org/{k}", k) for r, k in (("0", "a"), ("1", "a"), ("2", "b"))], "source_id string, run_id string, observed_at string, rank int, title string, url string, story string")
    got = sinks.diff_events(diff.snapshot_diff(items, "story"), diff.hero_swaps(items, "story")).collect()
    assert sorted((r.run_id, r.event_type, r.key) for r in got) == [("0", "ENTER", "a"), ("2", "ENTER", "b"), ("2", "EXIT", "a"), ("2", "HERO_SWAP", "b")] and len({r.id for r in got}) == 4


def test_islands_across_days(spark):
    """Runs that go on over midnight, days without rows, and changes at a day's first row."""
    at = ["01 23:58", "01 23:59", "02 00:00", "02 12:00", "05 00:00", "05 00:01", "06 09:00", "06 10:00", "07 01:00"]
    urls_ = ["a", "a", "a", "b", "b", "a", "a", "c", "a"]
    obs = spark.createDataFrame([(i, "s", f"2026-02-{t}:00", u, "t") for i, (t, u) in enumerate(zip(at, urls_, strict=True))], "id long, source_id string, observed_at string, url string, title string").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    got = sorted((r.island, r.url, r.seen_count) for r in history.islands(obs, ["url"]).collect())
    assert got == [(1, "a", 3), (2, "b", 2), (3, "a", 2), (4, "c", 1), (5, "a", 1)]
    assert sorted(r.id for r in history.changed_only(obs, ["url"]).collect()) == [0, 3, 5, 7, 8]


def test_stream_history_out_of_order(spark, tmp_path):
    """Rows that come late, but before the watermark has passed them, find their place; a row that comes twice counts once."""
    rows = [(i, "s", f"2026-02-01 10:{10 * i:02}:00", u) for i, u in enumerate("aabba")]
    make = lambda n, *ids: spark.createDataFrame([(*rows[i], "t") for i in ids], "id long, source_id string, observed_at string, url string, title string").withColumn("observed_at", F.col("observed_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    make(0, 0, 4)
    make(1, 3, 1, 4)
    make(2, 2)
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    import os
    import time

    for n in range(3):  # files are taken in order of their time
        for f in (tmp_path / f"in/{n}").iterdir():
            os.utime(f, (time.time() - 100 + 10 * n,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = streams.latest_history(streams.run_to_files(streams.history(stream), str(tmp_path / "out"), str(tmp_path / "check"), "update"))
    assert sorted((r.island, r.url, r.seen_count) for r in got.collect()) == [(1, "a", 2), (2, "b", 2), (3, "a", 1)]


def test_stream_history_by_slices(spark, tmp_path):
    """Over hours and days, in parts, with rows out of order, delivered again, and without source, time or URL: what the batch twin gives, and no row goes through Python."""
    import os
    import random
    import time

    r = random.Random(3)
    rows = [(i, r.choice(["s", "t", None]), f"2026-02-{1 + m // 1440:02}T{m // 60 % 24:02}:{m % 60:02}:00" if i % 50 else None, r.choice(["a", "b"]) if i % 7 else None, None if i % 5 == 0 else "t") for i, m in enumerate(r.choices(range(4000), k=600))]
    come = sorted(rows, key=lambda x: (int(x[2][8:10]) * 1440 + int(x[2][11:13]) * 60 + int(x[2][14:16]) if x[2] else 3000) + r.randrange(120))
    schema = "id long, source_id string, observed_at timestamp, url string, title string"
    make = lambda x: spark.createDataFrame(x, "id long, source_id string, observed_at string, url string, title string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for n in range(5):
        again = [(i, s, at, "other", "t") for i, s, at, u, _ in come[120 * n - 20 : 120 * n] if u and at]
        make(come[120 * n : 120 * (n + 1)] + come[max(0, 120 * n - 40) : 120 * n] + again).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for f in (tmp_path / f"in/{n}").iterdir():
            os.utime(f, (time.time() - 100 + 10 * n,) * 2)
    stream = streams.history(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), "3 hours")
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    given = streams.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "check"), "update")
    assert given.where("slice is not null").groupBy("source_id", "slice").agg(F.countDistinct("n").alias("calls")).where("calls > 1").count() > 0
    got = streams.latest_history(given).select("source_id", "island", "url", "title", "first_seen_at", "last_seen_at", "seen_count").collect()
    want = history.islands(make(rows).fillna("", ["title"]), ["url", "title"]).select("source_id", "island", "url", "title", "first_seen_at", "last_seen_at", "seen_count").collect()
    assert len(want) > 200 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_stream_history_slice_is_exact_at_its_edges(spark, tmp_path):
    """A run over three slices is one island; equal runs with another between them are two; rows without id are all counted."""
    rows = [(0, "a", "09:59:59"), (1, "a", "10:00:00"), (2, "a", "11:59:59"), (3, "b", "11:59:59"), (4, "a", "12:00:00"), (None, "a", "12:00:01"), (None, "a", "12:00:01")]
    spark.createDataFrame([(i, "s", f"2026-02-01 {at}", u, "t") for i, u, at in rows], "id long, source_id string, observed_at string, url string, title string").withColumn("observed_at", F.col("observed_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, source_id string, observed_at timestamp, url string, title string").parquet(str(tmp_path / "in"))
    got = streams.latest_history(streams.run_to_files(streams.history(stream), str(tmp_path / "out"), str(tmp_path / "check"), "update")).collect()
    assert sorted((r.island, r.url, r.seen_count, str(r.first_seen_at)[11:], str(r.last_seen_at)[11:]) for r in got) == [(1, "a", 3, "09:59:59", "11:59:59"), (2, "b", 1, "11:59:59", "11:59:59"), (3, "a", 3, "12:00:00", "12:00:01")]


def test_pages_go_through_python_few_at_a_time_and_once(spark):
    """Large batches are cut, none of their rows lost; the ranked list parses each page once."""
    import pyarrow as pa

    from slotwise.operators import extract, heroes

    got = list(extract.few_pages(iter([pa.record_batch({"x": list(range(1000))}), pa.record_batch({"x": [1000]})])))
    assert max(b.num_rows for b in got) <= 64 and [x for b in got for x in b.column(0).to_pylist()] == list(range(1001))
    pages = spark.createDataFrame([(1, "https://x.example/", "<main><a href='/s/1'>A story of some length</a></main>")], "page_id long, url string, html string")
    out = heroes.top10(pages)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.rank, r.title, r.related_links) for r in out.collect()] == [(1, "A story of some length", [])]
