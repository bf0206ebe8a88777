"""Changes between consecutive ranked snapshots.

A snapshot row has source_id, run_id, observed_at, rank, title, url and a key. A run's predecessor is the latest run of its
source that is strictly earlier, so runs of one instant have none of each other. Of rows that repeat a key in a run, the last
by rank is compared, but each of them is listed as entered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_runs(items: DataFrame) -> DataFrame:
    """source_id, run_id, observed_at, prev_run_id, prev_observed_at of every run; runs of one instant share the predecessor with the largest run_id."""
    runs = items.select("source_id", "run_id", "observed_at").distinct()
    times = runs.groupBy("source_id", "observed_at").agg(F.max("run_id").alias("last_run"))
    w = Window.partitionBy("source_id").orderBy("observed_at")
    times = times.withColumn("prev_run_id", F.lag("last_run").over(w)).withColumn("prev_observed_at", F.lag("observed_at").over(w)).drop("last_run")
    return runs.join(times, ["source_id", "observed_at"])


def _last_by_key(items: DataFrame, key: str) -> DataFrame:
    best = F.max_by(F.struct("rank", "title", "url"), F.struct("rank", "title", "url"))
    return items.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy("source_id", "run_id", F.col(key).alias("key")).agg(best.alias("it"))


def snapshot_diff(items: DataFrame, key: str = "fingerprint", skip_failed_runs: bool = False) -> DataFrame:
    """Change events: source_id, run_id, prev_run_id, observed_at, event_type, key, from_rank, to_rank, from_title, to_title, url, seq.

    event_type is ENTER, EXIT, MOVE or EDIT; one story may move and be edited at once (seq 1 and 2). The first run of a source
    lists all its stories as entered. Runs without items exist only if `items` has a row of null key for them; with
    skip_failed_runs those are left out, so their neighbours are compared.
    """
    if skip_failed_runs:
        items = items.where(F.col(key).isNotNull())
    runs = previous_runs(items)
    rows = _last_by_key(items, key)
    current = runs.join(rows, ["source_id", "run_id"]).select("source_id", "run_id", "key", F.col("it").alias("c"))
    before = runs.where("prev_run_id is not null").join(rows.withColumnRenamed("run_id", "prev_run_id"), ["source_id", "prev_run_id"]).select("source_id", "run_id", "key", F.col("it").alias("p"))
    both = current.join(before, ["source_id", "run_id", "key"], "full_outer").join(runs, ["source_id", "run_id"])
    entered, exited = F.col("p").isNull(), F.col("c").isNull()
    moved = ~entered & ~exited & (F.col("c.rank") != F.col("p.rank"))
    edited = ~entered & ~exited & (F.coalesce("p.title", F.lit("")) != "") & (F.coalesce("c.title", F.lit("")) != "") & (F.col("c.title") != F.col("p.title"))
    kinds = F.filter(F.array(F.when(entered, "ENTER"), F.when(exited, "EXIT"), F.when(moved, "MOVE"), F.when(edited, "EDIT")), lambda x: x.isNotNull())
    out = both.withColumn("event_type", F.explode(kinds))
    return out.select(
        "source_id", "run_id", "prev_run_id", "observed_at", "event_type", "key", F.col("p.rank").alias("from_rank"), F.col("c.rank").alias("to_rank"), F.col("p.title").alias("from_title"),
        F.col("c.title").alias("to_title"), F.coalesce("c.url", "p.url").alias("url"), F.when(F.col("event_type") == "EDIT", 2).otherwise(1).cast("long").alias("seq"),
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    """Events by run and code; codes that did not occur have no row."""
    return diff.groupBy("source_id", "run_id", "event_type").agg(F.count("*").alias("n"))


def hero_swaps(heroes: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Every run of a source with its lead's key, the one before and whether it changed; a blank key on either side is no change."""
    w = Window.partitionBy("source_id").orderBy("observed_at", "run_id")
    prev = F.coalesce(F.lag(key).over(w), F.lit(""))
    now = F.coalesce(key, F.lit(""))
    return heroes.select("source_id", "run_id", "observed_at", now.alias("hero_key"), prev.alias("prev_key"), ((now != "") & (prev != "") & (now != prev)).alias("hero_swap"))


def ranked(items: DataFrame, by: list, group: list[str], most: int = 10) -> DataFrame:
    """The first `most` rows of each group by a total order, with `rank` from 1."""
    w = Window.partitionBy(*group).orderBy(*by)
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def keep_last(runs: DataFrame, group: list[str], by: list, most: int) -> DataFrame:
    """Retention: the first `most` rows of each group in the given order."""
    return ranked(runs, by, group, most).drop("rank")
