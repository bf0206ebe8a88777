"""Story identity, slots, times and parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

# Fixed values.
SLOT_TOP = r"(?i)^top10:(\d+)$"
SLOT_HEX = r"(?i)^[0-9a-f]{12,40}$"
#: name: default, least, most.
LIMITS = {"hours": (12, 1, 72), "lookback_minutes": (120, 5, 720), "forward_minutes": (30, 0, 360)}


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def fingerprint(canonical_url: Column, title_norm: Column) -> Column:
    """sha1 of URL and title, or of the one that is there; stories without either share one."""
    u, t = _text(canonical_url), _text(title_norm)
    return F.sha1(F.when((u != "") & (t != ""), F.concat_ws("|", u, t)).when(u != "", u).when(t != "", t).otherwise("unknown").cast("binary"))


def slot_key(source_id: Column) -> Column:
    """The slot of a source's lead story: 12 hex digits."""
    return F.substring(F.sha1(F.concat(F.coalesce(source_id, F.lit("")), F.lit("|top")).cast("binary")), 1, 12)


def slot_key_of(source_id: str) -> str:
    """The same for one id, on the driver."""
    return hashlib.sha1(f"{source_id}|top".encode()).hexdigest()[:12]


def story(url: Column, title: Column, slot_rank: Column | None = None) -> Column:
    """canonical_url, title_norm, fingerprint, keywords, slot_rank. A null rank stays null."""
    u, t = urls.normalize_url(url), text.normalize_title(title)
    rank = (slot_rank if slot_rank is not None else F.lit(None)).cast("int")
    return F.struct(F.nullif(u, F.lit("")).alias("canonical_url"), F.nullif(t, F.lit("")).alias("title_norm"), fingerprint(u, t).alias("fingerprint"), text.keywords(t).alias("keywords"), rank.alias("slot_rank"))


def stored_or(raw: Column, field: str, otherwise: Column) -> Column:
    """A non-blank field of a JSON bag, or else a computed value."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object(raw, f"$.{field}")), F.lit("")), otherwise)


def first_filled(*cs: Column) -> Column:
    """The first value that is not blank, as it is."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs])


def slot_rank(slot: Column, stored: Column | None = None) -> Column:
    """A stored rank if there is one, else that of `top10:N`, 1 for `hero:1`, null for others. A stored null counts as missing."""
    of_slot = F.regexp_extract(F.coalesce(slot, F.lit("")), SLOT_TOP, 1).try_cast("int")
    out = F.coalesce(of_slot, F.when(F.lower(slot) == "hero:1", 1))
    return F.coalesce(stored.try_cast("int"), out) if stored is not None else out


def hero_slot(slot: Column) -> Column:
    """Blank and hashed slots are the lead's."""
    s = _text(slot)
    return F.when((s == "") | s.rlike(SLOT_HEX), "hero:1").otherwise(s)


def iso_millis(c: Column) -> Column:
    """Milliseconds of an ISO instant, 0 if it is none."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0).cast("long"))


def bucket_start(ts: Column, minutes: int = 5) -> Column:
    return F.window(ts, f"{minutes} minutes").start


def run_id(prefix: Column, ts: Column) -> Column:
    """Prefix and instant; the characters that file names dislike become dashes."""
    return F.concat(prefix, F.lit("_"), F.translate(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--"))


def short_duration(seconds: Column) -> Column:
    """`2d 3h`, `3h 4m` or `4m`; nothing below 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    text_ = lambda c, u: F.concat(c.cast("string"), F.lit(u))
    return F.when(d > 0, F.concat_ws(" ", text_(d, "d"), text_(h, "h"))).when(h > 0, F.concat_ws(" ", text_(h, "h"), text_(m, "m"))).otherwise(text_(m, "m"))


def pacific(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "America/Los_Angeles"), "MMM d, h:mm a"), F.lit(" PT"))


def bounded(name: str, value: object = None) -> int:
    """A numeric parameter, floored and held within its limits; the default for what is no number."""
    default, least, most = LIMITS[name]
    try:
        n = float(value)  # type: ignore[arg-type]
        n = default if n != n or n in (float("inf"), float("-inf")) else n
    except (TypeError, ValueError):
        n = default
    return max(least, min(most, int(n // 1)))


def flag(value: object, default: bool = True) -> bool:
    s = "" if value is None else str(value).strip().lower()
    return True if s in ("1", "true", "yes", "on") else False if s in ("0", "false", "no", "off") else default
