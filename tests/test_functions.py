"""Scalar functions against tables of cases, quirks included, and against properties."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotwise.functions import story, text, urls
from slotwise.sources import registry


def values(spark, make, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def sha(s):
    return hashlib.sha1(s.encode()).hexdigest()


def check(spark, make, cases):
    assert values(spark, make, [c[0] for c in cases]) == [c[1] for c in cases]


def test_clean_text(spark):
    check(spark, text.clean_text, [(None, ""), ("", ""), ("  a  b\n\tc ", "a b c"), ("﻿x　y", "x y"), ("plain", "plain")])


def test_strip_noise_keeps_its_quirk(spark):
    check(spark, text.strip_noise, [
        ("Storm hits coast 5 mins ago", "Storm hits coast"), ("Storm updated 3 hours ago", "Storm updated"), ("A 2026-02-18T14:00:00Z B", "A B"), ("A 2026-02-18T14:00:00.123Z", "A 2026-02-18T14:00:00.123Z"),
        ("Title 2026-02-18 9:30 |", "Title"), ("Title - | ;", "Title"), (None, ""),
    ])


def test_normalize_title(spark):
    check(spark, text.normalize_title, [("Trump’s  NEW plan: 50%!", "trump s new plan 50"), ("漢字", ""), (None, ""), ("Éa", "a")])


def test_keywords(spark):
    check(spark, lambda c: F.array_join(text.keywords(c), " "), [
        ("the storms hits the glass coast", "storm hits glass coast"), ("boss buses bus", "boss buse bus"), ("news said new", ""), ("", ""), (None, ""), ("aa bbb bbb ccc", "bbb ccc"),
        (" ".join(f"word{i}" for i in range(20)), " ".join(f"word{i}" for i in range(12))), ("videos whens", ""),
    ])


def test_content_type(spark):
    cases = [(("https://x/video/1", "t"), "video"), (("https://x/liverpool", "t"), "live"), (("https://x/a", "Watch LIVE now"), "live"), (("https://x/a", "alive"), "news"), (("https://x/opinion/a", ""), "opinion"), (("https://x/analysis/a", ""), "analysis"), (("https://x/photos", ""), "gallery"), ((None, None), "news")]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, u string, t string")
    assert [r.y for r in df.select("i", text.content_type(F.col("u"), F.col("t")).alias("y")).orderBy("i").collect()] == [c[1] for c in cases]


def test_blocked(spark):
    cases = [((403, None, None, None), "http_403"), ((429, None, None, None), "http_429"), ((200, "https://x", "Please verify you are human", None), "captcha"), ((200, None, "Access denied", None), "interstitial"),
             ((200, "https://x/privacy-law-story", "News", None), "consent"), ((200, "u", "Subscribe to read", None), "paywall"), ((200, "https://x", "Front page", None), None), ((None, None, None, None), None)]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, s int, u string, t string, e string")
    got = df.select("i", text.blocked_reason(F.col("s"), F.col("u"), F.col("t"), F.col("e")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [c[1] for c in cases]


def test_titles(spark):
    check(spark, text.title_rejected, [("Short", True), ("Subscribe to our paper today", True), ("Watch live: the big event", True), ("About Our Ads", True), ("A headline that is fine", False), (None, True)])
    check(spark, text.section_title, [("  U.S. News ", True), ("Politics", True), ("Politics as usual", False)])
    check(spark, text.without_breaking, [("BREAKING: Storm | Fox News", "Storm"), ("Breaking bad", "Breaking bad")])


def test_errors(spark):
    check(spark, text.compact_error, [("<html><title> 522 </title>x", "522"), ("<p>a</p>  b", "a b"), ("x" * 300, "x" * 220), (None, "")])
    check(spark, text.outage, [("Status=522 x", True), ("fetch failed", True), ("bad request", False)])


URLS = [
    ("https://www.Example.com/a//b/?b=2&a=1&utm_source=x#top", "https://example.com/a/b?a=1&b=2"), ("http://example.com", "http://example.com/"), ("http://example.com:80/x/", "http://example.com/x"), ("https://example.com:8443/x", "https://example.com:8443/x"),
    ("https://user@www.example.com/x?fbclid=1&UTM_Medium=2", "https://www.example.com/x"), ("https://x.org/p?a", "https://x.org/p?a="), ("https://x.org/p?b=1&a=2&a=1", "https://x.org/p?a=2&a=1&b=1"), ("https://x.org/p?q=a%20b", "https://x.org/p?q=a+b"),
    (" not a url ", "not a url"), ("", ""), (None, ""), ("/relative", "/relative"),
]


def test_normalize_url(spark):
    cases = [c for c in URLS if not (c[0] or "").startswith("https://user@")]
    check(spark, urls.normalize_url, cases)


def test_canonicalize_url(spark):
    check(spark, urls.canonicalize_url, [("https://www.Example.com/a//b//?b=2&a=1&cid=3#t", "https://www.example.com/a//b?b=2&a=1"), ("https://x.org/", "https://x.org"), ("x/y/?z#w", "x/y"), ("", None), (None, None), ("https://x.org/?ocid=1", "https://x.org?ocid=1")])


def test_compare_key_and_params(spark):
    check(spark, urls.compare_key, [("HTTPS://X.org/News/Abc/?a=1", "https://x.org/news/abc"), (None, "")])
    check(spark, lambda c: urls.param(c, "entryId"), [("https://x/?id=1&entryId=7#a", "7"), ("https://x/?notentryId=7", None)])


def test_absolute(spark):
    base = F.lit("https://x.org/news/list?p=1")
    check(spark, lambda c: urls.absolute(c, base), [("/a", "https://x.org/a"), ("//y.org/b", "https://y.org/b"), ("c", "https://x.org/news/c"), ("./c", "https://x.org/news/c"), ("https://z.org", "https://z.org"), ("?q=2", "https://x.org/news/list?q=2"), ("#t", "https://x.org/news/list?p=1#t"), ("mailto:a@b", ""), (None, "")])
    check(spark, lambda c: urls.absolute(c, base), [("../x", "https://x.org/x"), ("../../x?a=../b", "https://x.org/x?a=../b"), ("a/./b/../c", "https://x.org/news/a/c"), ("..", "https://x.org/"), (".", "https://x.org/news/"), ("/a/../b", "https://x.org/b"), ("a..b", "https://x.org/news/a..b")])


def test_url_allow(spark):
    check(spark, urls.url_allowed, [("https://x.org/news/a", True), ("https://x.org/", False), ("https://x.org/abc", True), ("https://x.org/ab", False), ("https://x.org/live/a", False), ("https://x.org/liverpool-win", True), ("https://x.org/advertise", True), ("nope", False), (None, False)])
    assert values(spark, lambda c: urls.url_allowed(c, r"(^|\.)bbc\.com$"), ["https://www.bbc.com/news/a", "https://abbc.org/news/a"]) == [True, False]


@pytest.mark.parametrize(("source", "good", "bad"), [
    ("bbc1", "https://www.bbc.com/news/articles/c0x1", "https://www.bbc.com/news/videos/a"), ("nbc1", "https://www.nbcnews.com/politics/a-rcna12345", "https://www.nbcnews.com/video/a-rcna1"), ("cnn1", "https://www.cnn.com/2026/02/18/politics/a", "https://www.cnn.com/videos/a"),
    ("npr1", "https://www.npr.org/2026/02/18/nx/a", "https://www.npr.org/podcasts/1"), ("ap1", "https://apnews.com/article/a-1", "https://apnews.com/hub/a"), ("fox1", "https://www.foxnews.com/politics/a-b", "https://www.foxnews.com/politics"),
    ("guardian1", "https://www.theguardian.com/us-news/2026/feb/18/a", "https://www.theguardian.com/football/live/2026/feb/18/a"), ("usat1", "https://www.usatoday.com/story/news/a", "https://www.usatoday.com/videos/a"), ("latimes1", "https://www.latimes.com/world/story/a", "https://www.latimes.com/b2b/story/a"),
    ("cbs1", "https://www.cbsnews.com/news/a", "https://www.cbsnews.com/videos/a"), ("yahoo1", "https://www.yahoo.com/news/articles/a-1", "https://www.yahoo.com/about/our-ads"), ("abc1", "https://abcnews.com/US/story", "https://abcnews.com/video/1"),
])
def test_story_rules(spark, source, good, bad):
    assert values(spark, lambda c: urls.story_url(source, c), [good, bad, None]) == [True, False, False]


def test_story_rules_look_at_host_and_path(spark):
    assert values(spark, lambda c: urls.story_url("bbc1", c), ["https://other.example/?u=/news/articles/x", "https://www.bbc.com/?u=/news/articles/x", "https://www.bbc.com.evil.example/news/articles/x"]) == [False] * 3
    assert values(spark, lambda c: urls.story_url("abc1", c), ["https://abcnews.com/videos/1", "https://abcnews.go.com/US/story?id=1"]) == [False, True]


def test_identity(spark):
    df = spark.createDataFrame([("u", "t"), ("u", ""), (None, "t"), (None, None)], "u string, t string")
    assert [r.f for r in df.select(story.fingerprint(F.col("u"), F.col("t")).alias("f")).collect()] == [sha("u|t"), sha("u"), sha("t"), sha("unknown")]
    check(spark, story.slot_key, [("abc1", "5be6806db8a5")])
    r = spark.createDataFrame([("https://www.x.org/a/", "Storms hit; coast")], "u string, t string").select(story.story(F.col("u"), F.col("t"), F.lit(3)).alias("s")).first().s
    assert (r.canonical_url, r.title_norm, r.keywords, r.slot_rank) == ("https://x.org/a", "storms hit coast", ["storm", "hit", "coast"], 3) and r.fingerprint == sha("https://x.org/a|storms hit coast")


def test_stored_fields(spark):
    check(spark, lambda c: story.stored_or(c, "k", F.lit("else")), [('{"k":" v "}', "v"), ('{"k":null}', "else"), ('{"k":""}', "else"), ("{}", "else"), (None, "else")])
    check(spark, lambda c: F.array_contains(F.json_object_keys(c), "k"), [('{"k":null}', True), ('{"j":1}', False)])


def test_slots(spark):
    check(spark, story.slot_rank, [("top10:7", 7), ("TOP10:12", 12), ("hero:1", 1), ("HERO:1", 1), ("hero:2", None), (None, None)])
    assert values(spark, lambda c: story.slot_rank(F.lit("top10:7"), c), ["3", None, "x"]) == [3, 7, 7]
    check(spark, story.hero_slot, [("", "hero:1"), (None, "hero:1"), ("5be6806db8a5", "hero:1"), ("top10:1", "top10:1"), ("5be6", "5be6")])


def test_times(spark):
    check(spark, story.iso_millis, [("2026-02-18T14:00:00.123Z", 1771423200123), ("no", 0), (None, 0)])
    assert values(spark, story.short_duration, [-5, 59, 60, 3600, 3660, 90000, 200000], "long") == ["0m", "0m", "1m", "1h 0m", "1h 1m", "1d 1h", "2d 7h"]
    check(spark, lambda c: story.pacific(c.cast("timestamp")), [("2026-02-18T20:05:00Z", "Feb 18, 12:05 PM PT"), ("2026-07-01T00:00:00Z", "Jun 30, 5:00 PM PT")])
    check(spark, lambda c: story.run_id(F.lit("abc"), c.cast("timestamp")), [("2026-02-18T20:05:00Z", "abc_2026-02-18T20-05-00-000Z")])


def test_parameters():
    assert [story.bounded("hours", v) for v in (None, "x", 0, 5.9, 100, "nan", "inf")] == [12, 12, 1, 5, 72, 12, 12]
    assert [story.bounded("lookback_minutes", v) for v in (1, 9999)] == [5, 720]
    assert [story.flag(v) for v in ("1", "YES", "off", "0", "", None, "maybe")] == [True, True, False, False, True, True, True]
    assert story.flag("maybe", False) is False


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", " "], ["b", "c"]), ([], []), (None, ["a"]), (["a", "a"], ["a"])], "a array<string>, b array<string>")
    s, o = text.jaccard(F.col("a"), F.col("b"))
    t, _ = text.jaccard(F.col("b"), F.col("a"))
    assert [(round(r.s, 6), r.o, round(r.t, 6)) for r in df.select(s.alias("s"), o.alias("o"), t.alias("t")).collect()] == [(0.333333, 1, 0.333333), (0.0, 0, 0.0), (0.0, 0, 0.0), (1.0, 1, 1.0)]


def test_registry(spark):
    check(spark, registry.canonical_id, [("Reuters", "guardian1"), ("wapo", "yahoo1"), ("bbc1", "bbc1"), (None, "")])
    assert values(spark, registry.checked_id, ["CNN1"]) == ["cnn1"]
    with pytest.raises(Exception, match="unknown source"):
        values(spark, registry.checked_id, ["zzz"])
    assert registry.sources(spark).count() == 12
    named = registry.with_name(spark.createDataFrame([("npr1",), ("zz",)], "source_id string"))
    assert {r.source_id: r.source_name for r in named.collect()} == {"npr1": "NPR", "zz": "zz"}


parts = st.text("abz", min_size=1, max_size=3)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(parts, st.lists(parts, max_size=3), st.lists(st.tuples(st.sampled_from(["a", "utm_x", "b", "gclid"]), parts), max_size=4)), min_size=30, max_size=60))
def test_normalize_is_idempotent(spark, drawn):
    made = [f"https://www.{h}.org/{'/'.join(p)}{'/' * (len(p) % 3)}?{'&'.join(f'{k}={v}' for k, v in q)}" for h, p, q in drawn]
    once = values(spark, urls.normalize_url, made)
    assert values(spark, urls.normalize_url, once) == once
    assert not any(re.search("utm_x|gclid|www", u) for u in once)
