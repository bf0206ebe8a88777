"""Published documents: the state of all sources, histories, timeline and ranked changes, as JSON rows under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import story, text
from ..operators import diff, history
from ..sources import registry, sinks

# Fixed values.
MOST_RUNS, MOST_EVENTS, EVENT_HOURS = 336, 3000, 24


def current(obs: DataFrame) -> DataFrame:
    """Each source's state: its last good item, whether the last attempt was ok, and since when the item has been there."""
    state = history.current_state(obs, ["url", "title", "error"])
    tail = history.current_since(obs.where("ok")).select("source_id", F.col("url").alias("_url"), "first_seen_at")
    out = registry.with_name(state.join(tail, "source_id", "left"))
    since = F.when(F.col("_url") == F.col("url"), F.col("first_seen_at")).alias("since")
    return out.select("source_id", "source_name", "ok", "stale", "updated_at", "title", "url", since, story.slot_key(F.col("source_id")).alias("slot_key"), text.content_type(F.col("url"), F.col("title")).alias("content_type"))


def unified(obs: DataFrame) -> DataFrame:
    """The feed: sources that have an item."""
    return current(obs).where("url is not null").select("source_id", "source_name", "updated_at", "since", "title", "url", "slot_key", "content_type")


def timeline(obs: DataFrame, now: str, hours: object = None, source_id: str | None = None) -> DataFrame:
    """Events of lead and ranked slots of the last hours (1 to 72, 12 by default), in order of time."""
    since = F.expr(f"cast('{now}' as timestamp_ntz) - interval {story.bounded('hours', hours)} hours")
    slot = (F.lower("slot_key") == "hero:1") | F.col("slot_key").rlike(story.SLOT_TOP)
    rows = obs.where((F.col("observed_at") >= since) & (F.col("observed_at") <= F.lit(now).cast("timestamp_ntz")) & slot)
    rows = rows.where(F.col("source_id") == source_id) if source_id else rows
    return registry.with_name(rows).withColumn("kind", F.lit("headline")).orderBy("observed_at", "id")


def documents(obs: DataFrame, items: DataFrame, now: str) -> dict[str, DataFrame]:
    """All published tables by name. Ranked runs are kept for the last 336, their events for the last 3000."""
    runs = items.select("source_id", "run_id", "observed_at").distinct()
    kept = diff.keep_last(runs, ["source_id"], [F.desc("observed_at"), "run_id"], MOST_RUNS)
    kept_items = items.join(kept.select("source_id", "run_id"), ["source_id", "run_id"])
    events = diff.snapshot_diff(kept_items)
    events = diff.keep_last(events, ["source_id"], [F.desc("observed_at"), "run_id", "key", "seq"], MOST_EVENTS)
    latest = diff.keep_last(runs, ["source_id"], [F.desc("observed_at"), "run_id"], 1).select("source_id", "run_id")
    return {
        "current": current(obs), "unified": unified(obs), "history": history.islands(obs.where("ok"), ["url", "title"]), "timeline": timeline(obs, now),
        "top10_history": kept_items, "top10_events": events, "top10_events_24h": events.where(F.col("observed_at") >= F.expr(f"cast('{now}' as timestamp_ntz) - interval {EVENT_HOURS} hours")),
        "top10_latest": items.join(latest, ["source_id", "run_id"]),
    }


def publish_all(obs: DataFrame, items: DataFrame, now: str, path: str) -> None:
    """Write all documents under path; if one can't be made, a `failure` document says why, and the error is raised."""
    try:
        for name, df in documents(obs, items, now).items():
            sinks.publish(df, f"{path}/{name}")
    except Exception as e:
        sinks.failure(obs.sparkSession, f"{path}/failure", e)
        raise
