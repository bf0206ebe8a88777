"""Scans: relations, cached state, observation views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import story

CACHE_SCHEMA = (
    "sources map<string, struct<id:string,name:string,home_url:string,kind:string,created_at:string,updated_at:string,ok:boolean,stale:boolean,"
    "item:struct<title:string,url:string,imgUrl:string,slotKey:string,contentType:string>,last:struct<runId:string,ok:boolean,error:string,fetchedAt:string>,"
    "history:array<string>,archive:array<struct<runId:string,html:string,json:string>>>>"
)


def relation(spark: SparkSession, path: str, order: list | None = None, limit: int | None = None) -> DataFrame:
    """A table with an optional order and limit; the limit is taken before any later filter."""
    df = spark.read.parquet(path)
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit is not None else df


def events_between(events: DataFrame, since=None, until=None, source_id: str | None = None, slot_key: str | None = None, columns: list[str] | None = None, row_cap: int | None = None) -> DataFrame:
    """A range scan on observed_at (since <=, < until) by source and slot. row_cap keeps the earliest rows, as a limit pushed below later filters would."""
    for value, test in ((since, lambda v: F.col("observed_at") >= F.lit(v)), (until, lambda v: F.col("observed_at") < F.lit(v)), (source_id, lambda v: F.col("source_id") == v), (slot_key, lambda v: F.col("slot_key") == v)):
        if value is not None:
            events = events.where(test(value))
    events = events.select(*columns) if columns else events
    return events.orderBy("observed_at", "id").limit(row_cap) if row_cap is not None else events


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def cache_state(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source of a cached state file; a missing or broken file has none."""
    try:
        df = spark.read.schema(CACHE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return df.select(F.explode("sources").alias("source_id", "state")).select("source_id", "state.*")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA).select(F.explode("sources").alias("source_id", "state")).select("source_id", "state.*")


def json_or(spark: SparkSession, path: str, schema: str, otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A JSON file, or a default where there is none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return otherwise() if otherwise else spark.createDataFrame([], schema)


def cached_results(cache: DataFrame, registry: DataFrame) -> DataFrame:
    """Cached states as scrape results; none at all unless every registered source has one."""
    joined = registry.select(F.col("id").alias("source_id")).join(cache, "source_id", "left")
    complete = joined.agg(F.bool_and(F.col("item").isNotNull()).alias("complete"))
    return joined.join(F.broadcast(complete), F.col("complete")).drop("complete")  # one row


def pick_columns(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by alias: each is the first filled one of those that exist."""
    out = []
    for name, options in names.items():
        there = [F.col(o).cast("string") for o in options if o in df.columns]
        out.append((story.first_filled(*there) if there else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def merged_snapshot(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current rows with their source's history rows as an array in order of first_seen_at."""
    entry = F.struct("first_seen_at", "url", "title", "last_seen_at", "seen_count")
    grouped = history.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return current.join(grouped, "source_id", "full_outer")
