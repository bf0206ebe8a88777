"""Writers. Keys are deterministic, so a write that is tried again can be told from a new one."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import story, text, urls
from ..operators import history


def run_key(source_id: Column, observed_at: Column) -> Column:
    return F.sha1(F.concat_ws("|", source_id, observed_at.cast("string")).cast("binary"))


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def _stored(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _at(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def drop_partition(spark, path: str, values: dict[str, object]) -> None:
    """Remove one partition's folder, if it is there."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    name = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else escape(str(v))
    at, fs = _at(spark, "/".join([path, *(f"{k}={name(v)}" for k, v in values.items())]))
    fs.delete(at, True)


def unseen(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    there = _stored(df.sparkSession, path)
    return df if there is None else df.join(there.select(key).distinct(), key, "left_anti")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key is not there yet; returns how many."""
    df = unseen(df, path, key).dropDuplicates([key])
    n = df.count()
    if n:
        append(df, path)
    return n


def append_changed(runs: DataFrame, path: str) -> None:
    """Attempt rows that differ in title, url, ok or error from the one before them, be it of the batch or stored already.

    For each source the batch's rows are compared with the stored rows from its earliest on and the last before that, so a late row finds its place between those stored. Rows that are stored stay.
    """
    there = _stored(runs.sparkSession, path)
    rows = runs.withColumn("_kept", F.lit(False))
    if there is not None:
        at = F.struct("observed_at", "id")
        since = runs.groupBy(F.col("source_id").alias("_s")).agg(F.min(at).alias("_since"))
        known = there.join(since, F.col("source_id").eqNullSafe(F.col("_s"))).withColumn("_before", at < F.col("_since"))
        own = [c for c in runs.columns if c in there.columns]
        last = known.where("_before").groupBy("_s").agg(F.max_by(F.struct(*own), at).alias("x")).select("x.*")
        near = known.where("not _before").select(*own).unionByName(last)
        rows = rows.unionByName(near.withColumn("_kept", F.lit(True)), allowMissingColumns=True)
    append(history.changed_only(rows, ["title", "url", "ok", "error"]).where("not _kept").drop("_kept"), path)


def diff_events(changes: DataFrame, swaps: DataFrame | None = None) -> DataFrame:
    """Change events as rows to store, each under a key made of its run, code and story, with the run it was compared with (from_run_id); swaps of the lead (`diff.hero_swaps`) are events of their own, HERO_SWAP."""
    rows = changes.select("source_id", "run_id", F.col("prev_run_id").alias("from_run_id"), "observed_at", "event_type", "key", "from_rank", "to_rank", "from_title", "to_title", "url", "seq")
    if swaps is not None:
        lead = swaps.where("hero_swap").select("source_id", "run_id", "observed_at", F.lit("HERO_SWAP").alias("event_type"), F.col("hero_key").alias("key"), F.lit(3).cast("long").alias("seq"))
        rows = rows.unionByName(lead, allowMissingColumns=True)
    return rows.withColumn("id", F.sha1(F.concat_ws("|", "source_id", "run_id", "event_type", "key").cast("binary")))


def ranked_events(items: DataFrame, batch: bool = False, most: int = 10) -> DataFrame:
    """Event rows of a ranked snapshot: finite ranks only, slot top10:rank. The batch job takes the first ten such rows, whatever their ranks, and its own canonical URL."""
    rows = items.withColumn("rank", F.col("rank").try_cast("int")).where("rank is not null")
    if batch:
        first = Window.partitionBy("source_id", "observed_at").orderBy("rank", "url", "title")
        rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
    url = urls.canonicalize_url(F.col("url")) if batch else urls.normalize_url(F.col("url"))
    title = text.normalize_title(F.col("title"))
    return rows.select(
        story.fingerprint(F.concat_ws("|", "source_id", F.col("observed_at").cast("string"), F.col("rank").cast("string")), F.lit("")).alias("id"), "source_id", "observed_at",
        F.concat(F.lit("top10:"), F.col("rank").cast("string")).alias("slot_key"), "title", "url", url.alias("canonical_url"), story.fingerprint(url, title).alias("fingerprint"),
    )


def run_and_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A run's row and its items' rows under one deterministic key."""
    keyed = items.withColumn("run_id", run_key(F.col("source_id"), F.col("observed_at")))
    runs = keyed.groupBy("run_id", "source_id", "observed_at").agg(F.count("*").alias("n_items"))
    return runs, keyed


def archive(pages: DataFrame, path: str) -> None:
    """Raw pages by source and day."""
    pages.withColumn("run_date", F.to_date("observed_at")).write.mode("append").partitionBy("source_id", "run_date").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    df.write.mode("overwrite").json(path)


def failure(spark, path: str, error: Exception) -> None:
    """What is published where a run failed as a whole."""
    publish(spark.createDataFrame([(False, str(error))], "ok boolean, error string"), path)


def with_retry(work: Callable[[], object], attempts: int = 4, base_ms: int = 700, transient: Callable[[Exception], bool] = lambda e: True) -> object:
    """Runs work again after transient errors, each time after twice the wait and up to a fifth of a second more, so that writers that failed together don't return together."""
    for n in range(1, attempts + 1):
        try:
            return work()
        except Exception as e:
            if n == attempts or not transient(e):
                raise
            time.sleep((base_ms * 2 ** (n - 1) + random.uniform(0, 200)) / 1000)
    return None
