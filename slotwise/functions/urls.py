"""URLs: parsing, the two canonical forms, comparison key, parameters, allow rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING = ("fbclid", "gclid", "dclid", "igshid", "mc_cid", "mc_eid", "ocid", "_ga", "_gl", "spm")
TRACKING_BATCH = ("fbclid", "gclid", "cmpid", "cid")
SECTIONS = r"/(video|videos|live|search|account|privacy|terms|about|contact|advertis|newsletter|shop)\b"
#: By source: its hosts, accepted paths and refused ones.
STORY_RULES = (
    ("abc1", r"(^|\.)abcnews(\.go)?\.com$", r"^/.", r"/video|/live/|/live$|/search|/account|/newsletters|/shop|/about|/contact"),
    ("cbs1", r"(^|\.)cbsnews\.com$", r"^/.", r"/(videos?|watch|account|privacy|terms)\b"),
    ("nbc1", r"(^|\.)nbcnews\.com$", r"/live-blog/|-rcna\d+|/\d{4}/\d{2}/\d{2}/", r"/(account|search|tips|newsletters?|video|shorts)\b"),
    ("cnn1", r"(^|\.)cnn\.com$", r"^/\d{4}/\d{2}/\d{2}/", r"/(audio|videos?|profiles|newsletters?|account|live-tv|subscription|access|shopping)\b"),
    ("guardian1", r"(^|\.)theguardian\.com$", r"/\d{4}/[a-z]{3}/\d{1,2}/|/live/", r"/football/live\b"),
    ("usat1", r"(^|\.)usatoday\.com$", r"/(story|live-story)/", r"/videos?/"),
    ("ap1", r"(^|\.)apnews\.com$", r"^/(article|live)/", r"^$"),
    ("latimes1", r"(^|\.)latimes\.com$", r"/(story|list|live|live-updates)\b", r"/b2b/"),
    ("npr1", r"(^|\.)npr\.org$", r"^/\d{4}/\d{2}/\d{2}/", r"/(podcasts?|newsletters?|shop|donate|series|sections|programs|music)\b"),
    ("bbc1", r"(^|\.)bbc\.(com|co\.uk)$", r"^/news/(articles/[a-z0-9]+|live/.|[a-z-]+-\d+)", r"^/news/(videos?|av|topics|special-reports)\b"),
    ("fox1", r"(^|\.)foxnews\.com$", r"^/[a-z0-9-]+/[a-z0-9-]+", r"^/(live|search|category|shows|video|fox-nation|weather|sports/odds|person|about|newsletter|apps)(/|$)"),
    ("yahoo1", r"(^|\.)yahoo\.com$", r"^/[a-z0-9-]+/[a-z0-9-]+|^/news/articles/", r"\b(about-our-ads|our-ads|adchoices|privacy|legal|terms|account|member-center|subscriptions)\b|^/(search|news|finance|sports|entertainment|lifestyle|mail|weather|video|autos)/?$"),
)

PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _raw(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def parsed(c: Column) -> Column:
    """Whether the URL has a scheme and a host; nothing here raises on a bad URL."""
    return _raw(c).rlike(PARTS) & ~F.regexp_extract(_raw(c), PARTS, 2).rlike(r"\s")


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(_raw(c), PARTS, 1))


def host(c: Column) -> Column:
    """Host in lower case, with its port unless that is the scheme's own, without user information."""
    h = F.regexp_replace(F.lower(F.regexp_extract(_raw(c), PARTS, 2)), "^.*@", "")
    return F.when((scheme(c) == "http") & h.endswith(":80"), F.regexp_replace(h, ":80$", "")).when((scheme(c) == "https") & h.endswith(":443"), F.regexp_replace(h, ":443$", "")).otherwise(h)


def path(c: Column) -> Column:
    p = F.regexp_extract(_raw(c), PARTS, 3)
    return F.when(p == "", "/").otherwise(p)


def params(c: Column) -> Column:
    """Parameters as key=value in order; a key alone gets an equals sign, an escaped space becomes a plus sign."""
    q = F.regexp_replace(F.regexp_extract(_raw(c), PARTS, 4), r"^\?", "")
    parts = F.filter(F.split(q, "&"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))), r"%20| ", "+"))


def _key(x: Column) -> Column:
    return F.regexp_extract(x, r"^([^=]*)=", 1)


def normalize_url(c: Column) -> Column:
    """Host without www., no fragment, single slashes, no trailing slash but the root's, no tracking parameters, the others sorted by name. What is no URL stays as it is, trimmed."""
    p = F.regexp_replace(path(c), "/{2,}", "/")
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    kept = F.filter(params(c), lambda x: ~F.lower(_key(x)).startswith("utm_") & ~F.lower(_key(x)).isin(*TRACKING))
    order = F.array_sort(F.transform(kept, lambda x, i: F.struct(_key(x).alias("k"), i.alias("i"), x.alias("x"))))
    query = F.array_join(F.transform(order, lambda s: s["x"]), "&")
    out = F.concat(scheme(c), F.lit("://"), F.regexp_replace(host(c), r"^www\.", ""), p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(parsed(c), out).otherwise(_raw(c))


def canonicalize_url(c: Column) -> Column:
    """The batch job's form: www. stays, all trailing slashes go, fewer tracking parameters, order kept. Null for blank."""
    kept = F.filter(params(c), lambda x: ~F.lower(_key(x)).startswith("utm_") & ~F.lower(_key(x)).isin(*TRACKING_BATCH))
    query = F.array_join(kept, "&")
    out = F.concat(scheme(c), F.lit("://"), host(c), F.regexp_replace(path(c), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    rest = F.regexp_replace(F.regexp_replace(_raw(c), r"[?#].*$", ""), "/+$", "")
    return F.nullif(F.when(parsed(c), out).otherwise(rest), F.lit(""))


def compare_key(c: Column) -> Column:
    """Origin and path in lower case, without query and trailing slashes."""
    return F.when(parsed(c), F.lower(F.concat(scheme(c), F.lit("://"), host(c), F.regexp_replace(path(c), "/+$", "")))).otherwise(F.lower(F.regexp_replace(F.regexp_replace(_raw(c), r"[?#].*$", ""), "/+$", "")))


def param(c: Column, name: str) -> Column:
    """Value of a parameter, null if there is none."""
    return F.nullif(F.regexp_extract(_raw(c), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def _without_dots(p: Column) -> Column:
    """A path with its . and .. segments taken out."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    out = F.array_join(kept, "/")
    folder = last.isin(".", "..") & ~out.endswith("/")
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.when(folder, F.concat(out, F.lit("/"))).otherwise(out)).otherwise(p)


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against an absolute base: absolute, protocol-relative, rooted, query, fragment and path-relative links, dot segments too. Other schemes give ''."""
    h, b = _raw(href), _raw(base)
    origin = F.concat(scheme(b), F.lit("://"), host(b))
    folder = F.regexp_replace(path(b), "[^/]*$", "")
    own, tail = F.regexp_extract(h, r"^([^?#]*)(.*)$", 1), F.regexp_extract(h, r"^([^?#]*)(.*)$", 2)
    return (
        F.when(h == "", "").when(h.rlike(r"(?i)^https?://"), h).when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h)).when(h.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(h.startswith("?"), F.concat(origin, path(b), h)).when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h)).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "")
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), tail))
    )


def url_allowed(c: Column, host_pattern: str | None = None) -> Column:
    """A parseable URL on a matching host whose path has 4 characters and names no section such as video, live or shop."""
    p = F.lower(path(c))
    ok = parsed(c) & (F.length(p) >= 4) & ~p.rlike(SECTIONS)
    return ok & host(c).rlike(host_pattern) if host_pattern else ok


def story_url(source: str, c: Column) -> Column:
    """One source's own rule for what is a story: by its hosts, and by the path in lower case."""
    for name, hosts, accept, refuse in STORY_RULES:
        if name == source:
            p = F.lower(path(c))
            return parsed(c) & host(c).rlike(hosts) & p.rlike(accept) & ~p.rlike(refuse)
    raise ValueError(f"no rule for {source}")


def host_pattern(source: str) -> str:
    return next(hosts for name, hosts, _, _ in STORY_RULES if name == source)
