"""From front pages to observations, ranked events, changes and published documents.

Pages come as rows (page_id, source_id, url, html, observed_at) and, where the fetcher knows them, final_url, http_status, duration_ms,
page_title and profile. Fetching them is outside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import story, text
from ..operators import diff, heroes, history
from ..sources import shared, sinks
from . import publish

HERO = "hero:1"


#: What a fetcher may say of an attempt, by its type; columns that pages don't have are null.
FETCHED = {"final_url": "string", "http_status": "int", "duration_ms": "bigint", "page_title": "string", "profile": "string"}


def fetched(pages: DataFrame) -> list[Column]:
    return [(F.col(c).try_cast(t) if c in pages.columns else F.lit(None).cast(t)).alias(c) for c, t in FETCHED.items()]


def enriched(raw: DataFrame) -> DataFrame:
    """raw with a JSON bag of what the attempt says of itself and of its story. Fields without a value are left out, but for blocked, has_item
    and is_live_blog, which are always there; blocked is judged by status, address, page title and error, so an error may block a page that has a story."""
    meta = story.story(F.col("url"), F.col("title"), F.col("rank"))
    given = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast(FETCHED.get(name, "string"))
    content = text.content_type(F.col("url"), F.col("title"))
    reason = text.blocked_reason(given("http_status"), given("final_url"), given("page_title"), given("error"))
    hero = F.col("slot_key") == HERO
    fields = {
        "source_id": given("source_id"), "run_id": given("run_id"), "run_kind": F.when(hero, "hero").otherwise("top10"), "module": F.when(hero, "homepage_hero").otherwise("top10"), "rank": F.col("rank"),
        "duration_ms": given("duration_ms"), "final_url": given("final_url"), "http_status": given("http_status"), "blocked": reason.isNotNull(), "blocked_reason": reason, "profile": F.coalesce(given("profile"), F.lit("desktop")),
        "has_item": F.coalesce(F.col("title"), F.col("url")).isNotNull(), "content_type": content, "is_live_blog": F.coalesce(content == "live", F.lit(False)), "scraper_error": given("error"),
    }
    own = [F.col(c) for c in ("selector_used", "candidates") if c in raw.columns]
    story_fields = [meta[c].alias(c) for c in ("canonical_url", "title_norm", "fingerprint", "keywords", "slot_rank")]
    return raw.withColumn("raw", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], *story_fields, *own)))


def observations(pages: DataFrame) -> DataFrame:
    """One attempt for each page: id, run_id, source_id, observed_at, slot_key, title, url, ok, error, raw."""
    found = heroes.heroes(pages).drop("slot_key", "source_id", *FETCHED)
    # A page that says nothing of redirects was read where it was asked for.
    said = pages.select("page_id", "source_id", "observed_at", F.col("url").alias("asked"), *fetched(pages)).withColumn("final_url", F.coalesce("final_url", "asked")).drop("asked")
    rows = said.join(found, "page_id").withColumn("slot_key", F.lit(HERO)).withColumn("rank", F.lit(1))
    key = sinks.run_key(F.col("source_id"), F.col("observed_at"))
    return enriched(rows.withColumn("run_id", key)).select(key.alias("id"), "run_id", "source_id", "observed_at", "slot_key", "title", "url", "ok", "error", "raw")


def ranked(pages: DataFrame) -> DataFrame:
    """The ranked rows of each page: source_id, run_id, observed_at, rank, title, url, fingerprint, related_links."""
    rows = pages.select("page_id", "source_id", "observed_at").join(heroes.top10(pages), "page_id")
    return rows.select("source_id", sinks.run_key(F.col("source_id"), F.col("observed_at")).alias("run_id"), "observed_at", "rank", "title", "url", "fingerprint", "related_links")


# ---- tables by day and source


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("observed_at"))


def _in_days(days: list) -> Column:
    known = [d for d in days if d is not None]
    return F.col("day").isin(known) | (F.col("day").isNull() if None in days else F.lit(False))


def _days(rows: DataFrame) -> list:
    return sorted((r.day for r in rows.select("day").distinct().collect()), key=str)


def stored(spark: SparkSession, path: str, schema: StructType, days: list | None = None) -> DataFrame:
    """The rows of a table, of the given days only: no other day's files are listed or read."""
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows if days is None else rows.where(_in_days(days))


def _replace(rows: DataFrame, path: str, emptied: DataFrame | None = None) -> None:
    """Rows take the place of all that their days and sources hold. Partitions named in `emptied` (source_id, day) of which rows has none are removed."""
    spark = rows.sparkSession
    rows = shared.settle(rows, "replace")
    if emptied is not None:
        for r in emptied.join(rows.select("source_id", "day").distinct(), ["source_id", "day"], "left_anti").distinct().collect():
            sinks.drop_partition(spark, path, {"day": r.day, "source_id": r.source_id})
    # Files by partition: one for each day and source, however the rows came.
    rows.repartition("day", "source_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "source_id").parquet(path)


def merge(new: DataFrame, path: str, key: str) -> None:
    """Add rows whose key is not stored yet to their days and sources; only these are read and written, and a second call changes nothing."""
    there = stored(new.sparkSession, path, new.schema, _days(new))
    touched = there.join(new.select("source_id", "day").distinct(), ["source_id", "day"], "left_semi").select(*new.columns)
    _replace(touched.unionByName(new.join(touched.select(key), key, "left_anti")).dropDuplicates([key]), path)


def _around(batch: DataFrame, path: str, kind: str) -> DataFrame:
    """source_id, day, touched: days of the batch, and for each source the stored days next to them, before (touched is null) and behind (touched is false)."""
    pairs = batch.select("source_id", "day").where("day is not null and source_id is not null").distinct()
    sinks.append_new(pairs.withColumn("id", F.concat_ws("|", F.lit(kind), "source_id", F.col("day").cast("string"))).withColumn("kind", F.lit(kind)), f"{path}/days", "id")
    known = batch.sparkSession.read.parquet(f"{path}/days").where(F.col("kind") == kind).select("source_id", F.col("day").alias("other"))  # a row for each day and source
    near = pairs.join(known, "source_id").groupBy("source_id", "day").agg(F.max(F.when(F.col("other") < F.col("day"), F.col("other"))).alias("before"), F.min(F.when(F.col("other") > F.col("day"), F.col("other"))).alias("behind"))
    near = near.select("source_id", F.explode(F.array(F.struct(F.col("day"), F.lit(2).alias("is")), F.struct(F.col("behind").alias("day"), F.lit(1).alias("is")), F.struct(F.col("before").alias("day"), F.lit(0).alias("is")))).alias("x"))
    near = near.select("source_id", "x.day", "x.is").where("day is not null").groupBy("source_id", "day").agg(F.max("is").alias("is"))
    return shared.settle(near.select("source_id", "day", F.when(F.col("is") > 0, F.col("is") == 2).alias("touched")), "around")


def _derive(batch: DataFrame, path: str, kind: str, name: str, make) -> None:
    """Make the derived table `name` anew where the batch may have changed it: on its days, and for the first run behind each of them.

    `make` gets the stored rows of those days and of the day before each, so what it derives for them is as from the whole table. Its rows have source_id, observed_at and day."""
    spark = batch.sparkSession
    around = _around(batch, path, kind)
    days = _days(around)
    rows = stored(spark, f"{path}/{kind}", batch.schema, days).join(around, ["source_id", "day"])
    first = rows.where("not touched").groupBy("source_id", "day").agg(F.min("observed_at").alias("first"))
    mine = lambda d: d.join(around, ["source_id", "day"]).join(first, ["source_id", "day"], "left").where("touched or observed_at = first").drop("touched", "first")
    fresh = shared.settle(mine(_dated(make(rows.drop("touched")))), "fresh")
    target = around.where("touched is not null")
    there = stored(spark, f"{path}/{name}", fresh.schema, days).join(target.where("not touched"), ["source_id", "day"]).join(first, ["source_id", "day"], "left").where("observed_at > first or first is null")
    _replace(there.select(*fresh.columns).unionByName(fresh), f"{path}/{name}", target.select("source_id", "day"))


def take(seen: DataFrame, items: DataFrame, path: str) -> None:
    """Store attempts and ranked rows, both with their day, and what follows from them: see `run`."""
    slots = sinks.ranked_events(items).select("id", "source_id", "observed_at", "slot_key", "title", "url", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    merge(seen, f"{path}/attempts", "id")
    merge(_dated(seen.select(*slots.columns).unionByName(slots)), f"{path}/events", "id")
    merge(items, f"{path}/items", "id")
    _derive(seen, path, "attempts", "runs", lambda rows: history.changed_only(rows, ["title", "url", "ok", "error"]))
    _derive(items, path, "items", "changes", lambda rows: sinks.diff_events(diff.snapshot_diff(rows), diff.hero_swaps(rows.where("rank = 1"))))


def run(pages: DataFrame, path: str, now: str, ranked_sources: tuple[str, ...] | None = None) -> None:
    """Take pages in: attempts that changed go to path/runs, lead and ranked rows to path/events, changes between ranked lists and
    swaps of the lead to path/changes, and all documents are published anew under path/published.

    Tables lie by day and source. A run reads and writes the days of its pages, and beside them for each source the last stored day before, with which the first run is compared, and the next
    one behind, whose first run has a new predecessor if pages came late: so many small runs, in any order and repeated, store what one big run does. Pages without source or
    time are stored, but compared with nothing. Only publishing reads all days. ranked_sources are the sources whose pages hold a ranked list, all if None.
    """
    spark = pages.sparkSession
    seen = shared.settle(_dated(observations(pages)), "seen")
    lists = pages if ranked_sources is None else pages.where(F.col("source_id").isin(*ranked_sources))
    items = ranked(lists)
    items = shared.settle(_dated(items.withColumn("id", F.sha1(F.concat_ws("|", "run_id", F.col("rank").cast("string")).cast("binary")))), "ranked")
    take(seen, items, path)
    publish.publish_all(stored(spark, f"{path}/attempts", seen.schema), stored(spark, f"{path}/items", items.schema), now, f"{path}/published")
