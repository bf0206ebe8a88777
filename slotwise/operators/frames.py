"""Frames: observation rows of one run, or of one five-minute bucket where the run is not known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import story


def frame_rows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """events (id, source_id, observed_at, slot_key, run_id, title, url, fingerprint) with `frame`, its key within the source. Rows without a time are dropped."""
    bucket = story.bucket_start(F.col("observed_at"), minutes).cast("string")
    run = F.trim(F.coalesce("run_id", F.lit("")))
    return events.where("observed_at is not null").withColumn("frame", F.when(run != "", F.concat(F.lit("run:"), run)).otherwise(F.concat(F.lit("bucket:"), bucket)))


def frames(events: DataFrame, minutes: int = 5) -> DataFrame:
    """One row for each source and frame: ts, the last lead story, and the ranked stories as an array in order of rank.

    A frame's arrays hold the rows of one run of one source, a handful each.
    """
    rows = frame_rows(events, minutes).withColumn("rank", story.slot_rank(F.col("slot_key")))
    order = F.struct("observed_at", "id")
    is_hero, is_top = F.col("slot_key") == "hero:1", F.col("slot_key").rlike(story.SLOT_TOP)
    item = F.struct("rank", "observed_at", "id", "title", "url", "fingerprint")
    return rows.groupBy("source_id", "frame").agg(
        F.max("observed_at").alias("ts"), F.max_by(F.struct("title", "url", "fingerprint"), F.when(is_hero, order)).alias("hero"),
        F.array_sort(F.collect_list(F.when(is_top, item))).alias("top10"), F.count("*").alias("n_rows"),
    )
