"""Headline text: cleaning, normal form, keywords, content type, refusal and block rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: White space as ECMAScript understands it.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOPWORDS = (
    "the and for with this that from into about after before amid over under latest update updates live news story stories video photos photo says said new today will "
    "just more than what when where why how who are was were has have had its their they them his her our your"
).split()
UNITS = "(sec|secs|second|seconds|min|mins|minute|minutes|hr|hrs|hour|hours|day|days)"
NOISE = (r"\b20\d{2}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\b", r"\b20\d{2}-\d{2}-\d{2}\s+\d{1,2}:\d{2}(:\d{2})?\b", rf"(?i)\b\d+\s*{UNITS}\s+ago\b", rf"(?i)\b(updated|posted)\s+\d+\s*{UNITS}\s+ago\b")
NOISE_TAIL = r"[|•\-:;, ]+$"
REFUSED_TITLE = r"\b(sign in|subscribe|watch live|about our ads|privacy policy|terms of service|advertise with us)\b"
BLOCKS = (("captcha", "captcha|are you a robot|verify you are human"), ("consent", "consent|gdpr|privacy"), ("paywall", "paywall|subscribe to read"), ("interstitial", "interstitial|access denied|forbidden|blocked"))
TRANSIENT_STATUS = (408, 425, 429, 500, 502, 503, 504, 520, 522, 524)
TRANSIENT_TEXT = ("connection timed out", "error code 522", "etimedout", "econnreset", "fetch failed", "network error", "temporarily unavailable")
OUTAGE_TEXT = ("status=522", "status=520", "status=524", "connection timed out", "temporarily unavailable", "fetch failed")
SECTION_TITLE = r"(?i)^\s*(Olympics|Politics|U\.?S\.?\s*News|World|Health|Sports|Local|Business|Science)\s*$"
BREAKING_PREFIX = r"(?i)^\s*breaking(\s+news)?\s*[:\-–—]\s*"
SITE_SUFFIX = r"(?i)\s*[|\-–—]\s*fox news\s*$"

SHORTEST_TITLE, MOST_KEYWORDS = 12, 12


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_text(c: Column) -> Column:
    """White space, no-break space too, collapsed and trimmed. Null is ''. A space that stands alone is not matched, as it stays."""
    other = WS.replace(" ", "")
    return F.trim(F.regexp_replace(_text(c), f"{other}{WS}*| {WS}+", " "))


def strip_noise(c: Column) -> Column:
    """Without time stamps, freshness badges and trailing separators. The badge goes before "updated" or "posted" is looked for, so such a word stays behind."""
    t = clean_text(c)
    for pattern in NOISE:
        t = F.regexp_replace(t, pattern, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), NOISE_TAIL, ""))


def normalize_title(c: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces: white space of any kind is among what becomes a space, so it needs no cleaning first."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def keywords(title_norm: Column, most: int = MOST_KEYWORDS) -> Column:
    """Ordered distinct words of a normal title: plural s cut from words of more than 4 letters, then 3 letters at least and no stopword."""
    words = F.split(F.coalesce(title_norm, F.lit("")), " ")
    stem = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 4) & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    kept = F.filter(stem, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def jaccard(a: Column, b: Column) -> tuple[Column, Column]:
    """Similarity and overlap of the sets of non-blank elements of two arrays; two empty sets have similarity 0."""
    solid = lambda x: F.array_distinct(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda w: F.trim(w) != ""))
    overlap = F.size(F.array_intersect(solid(a), solid(b)))
    union = F.size(F.array_union(solid(a), solid(b)))
    return F.when(union > 0, overlap / union).otherwise(F.lit(0.0)), overlap


def content_type(url: Column, title: Column) -> Column:
    u, t = F.lower(_text(url)), F.lower(_text(title))
    return (
        F.when(u.contains("/video") | u.contains("video."), "video").when(u.contains("/live") | t.rlike(r"\blive\b"), "live").when(u.contains("/opinion") | u.contains("/editorial"), "opinion")
        .when(u.contains("/analysis"), "analysis").when(u.contains("/photo") | u.contains("/gallery"), "gallery").otherwise("news")
    )


def blocked_reason(status: Column, final_url: Column, page_title: Column, error: Column) -> Column:
    """http_403, http_429, captcha, consent, paywall, interstitial, or null; a substring anywhere in URL, title or error counts."""
    hay = F.lower(F.concat_ws(" ", _text(final_url), _text(page_title), _text(error)))
    out = F.when(status == 403, "http_403").when(status == 429, "http_429")
    for reason, pattern in BLOCKS:
        out = out.when(hay.rlike(pattern), reason)
    return out


def title_rejected(c: Column) -> Column:
    t = F.lower(_text(c))
    return (F.length(t) < SHORTEST_TITLE) | t.rlike(REFUSED_TITLE)


def section_title(c: Column) -> Column:
    """A title that only names a section."""
    return _text(c).rlike(SECTION_TITLE)


def _any(t: Column, parts: tuple) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | t.contains(p)
    return out


def transient_error(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False)) | _any(F.lower(_text(message)), TRANSIENT_TEXT)


def outage(summary: Column) -> Column:
    return _any(F.lower(_text(summary)), OUTAGE_TEXT)


def compact_error(message: Column) -> Column:
    """The title of an HTML error page, else its text in 220 characters."""
    m = _text(message)
    title = F.regexp_extract(m, r"(?i)<title>([^<]+)</title>", 1)
    plain = F.left(F.trim(F.regexp_replace(F.regexp_replace(m, r"<[^>]+>", " "), r"\s+", " ")), F.lit(220))
    return F.when(title != "", F.trim(title)).otherwise(plain)


def without_breaking(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), BREAKING_PREFIX, ""), SITE_SUFFIX, "")
