"""Buckets, history and change events over streams of observation rows.

Event time is observed_at as TIMESTAMP (a watermark refuses TIMESTAMP_NTZ). Rows that a retry delivers twice are dropped within
the watermark by id. History is kept for each source by slices of an hour: a slice's rows wait in state until the watermark has
passed it, so that rows that come out of order still find their place, and its runs are made anew when rows come to it. What
passes from slice to slice is put together where the history is read, see `latest_history`. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WATERMARK = "1 day"


def read_events(spark: SparkSession, path: str, schema, per_trigger: int | None = None, only: str | None = None) -> DataFrame:
    """A stream over the files of a folder, those that match `only` if given."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", only) if only else reader
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def distinct_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["id"])


def buckets(events: DataFrame, minutes: int = 5, watermark: str | None = WATERMARK) -> DataFrame:
    """Rows by source and tumbling bucket. watermark is None where events have one already."""
    w = F.window("observed_at", f"{minutes} minutes")
    events = events.withWatermark("observed_at", watermark) if watermark else events
    return events.groupBy(w.alias("w"), "source_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok")).select(F.col("w.start").alias("bucket"), "source_id", "n", "n_ok")


SLICE = "hour"


def _before(rows: Column) -> Column:
    """For each element of an array, the one before it."""
    return F.concat(F.array(F.lit(None)), F.slice(rows, 1, F.size(rows) - 1))


def _once(rows: Column) -> Column:
    """Sorted rows (at, id, came, url, title) without those that came again: of equal time and id the one that came first stays. Rows without id are never told as such."""
    pairs = F.zip_with(rows, _before(rows), lambda now, last: F.struct(now.alias("row"), (now["at"].eqNullSafe(last["at"]) & F.coalesce(now["id"] == last["id"], F.lit(False))).alias("again")))
    return F.transform(F.filter(pairs, lambda x: ~x["again"]), lambda x: x["row"])


def _steps(rows: Column) -> Column:
    """Where runs of equal (url, title) begin: the place and row, and the time of the row before; and a last element that stands behind all rows."""
    same = lambda now, last: F.coalesce((now["url"] == last["url"]) & (now["title"] == last["title"]), F.lit(False))
    pairs = F.zip_with(rows, _before(rows), lambda now, last: F.struct(now["at"].alias("at"), now["url"].alias("url"), now["title"].alias("title"), last["at"].alias("ended"), same(now, last).alias("same")))
    placed = F.transform(pairs, lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), x["url"].alias("url"), x["title"].alias("title"), x["ended"].alias("ended"), x["same"].alias("same")))
    end = F.struct(F.size(rows).alias("i"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"), F.element_at(rows, -1)["at"].alias("ended"), F.lit(False).alias("same"))
    return F.concat(F.filter(placed, lambda x: ~x["same"]), F.array(end))


def _runs(steps: Column) -> Column:
    """Runs from each step to the next."""
    pairs = F.zip_with(steps, F.slice(steps, 2, F.size(steps)), lambda x, y: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["at"].alias("first_seen_at"), y["ended"].alias("last_seen_at"), (y["i"] - x["i"]).cast("long").alias("seen_count")))
    return F.slice(pairs, 1, F.size(steps) - 1)


def history(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Runs of equal (url, title) by source and slice of time, in update mode; `latest_history` makes the history of what was given out. Rows that come after the watermark has passed their slice are lost.

    A slice is given out as a whole when rows come to it: one row for each of its runs, with its place among them, their number, and n, how many rows the slice has had so far, which grows
    with each time. Its first run's row has `end`, what its last run is of. Rows without a time are a slice of their own.
    """
    row = F.struct(F.col("observed_at").cast("timestamp").alias("at"), "id", F.current_timestamp().alias("came"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("title").cast("string"), F.lit("")).alias("title"))
    rows = events.where("url is not null").select("source_id", F.date_trunc(SLICE, "observed_at").alias("slice"), row.alias("row"))
    # A slice's time is its beginning, so it waits for the watermark and its own length.
    slices = rows.withWatermark("slice", f"{watermark} 1 {SLICE}").groupBy("source_id", "slice").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    slices = slices.select("source_id", "slice", F.size("rows").cast("long").alias("n"), _once(F.col("rows")).alias("rows"))
    slices = slices.select("source_id", "slice", "n", _steps(F.col("rows")).alias("steps"))
    slices = slices.select("source_id", "slice", "n", _runs(F.col("steps")).alias("runs"))
    last = F.element_at("runs", -1)
    slices = slices.select("source_id", "slice", "n", F.size("runs").cast("long").alias("runs_of_slice"), F.struct(last["url"].alias("url"), last["title"].alias("title")).alias("end"), F.posexplode("runs").alias("place", "run"))
    return slices.select("source_id", "slice", "n", "runs_of_slice", F.col("place").cast("long").alias("place"), F.when(F.col("place") == 0, F.col("end")).alias("end"), "run.*")


def latest_history(rows: DataFrame) -> DataFrame:
    """What holds after all calls: the runs of each slice as they were last given out; one that goes on in the next slice is one island with its first run there."""
    every = rows.where("place = 0").select("source_id", "slice", "n", F.struct("n", F.col("runs_of_slice").alias("runs"), F.struct("url", "title").alias("start"), "end").alias("x"))
    last = every.groupBy("source_id", "slice").agg(F.max_by("x", "n").alias("x")).select("source_id", "slice", "x.*")
    in_order = Window.partitionBy("source_id").orderBy("slice")
    last = last.withColumn("new", F.col("runs") - F.coalesce(F.lag("end").over(in_order) == F.col("start"), F.lit(False)).cast("long"))
    base = F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs")
    last = last.select(F.col("source_id").alias("_source"), F.col("slice").alias("_slice"), F.col("n").alias("_n"), base.alias("_base"))
    held = rows.join(last, F.col("source_id").eqNullSafe(F.col("_source")) & F.col("slice").eqNullSafe(F.col("_slice")) & (F.col("n") == F.col("_n")))
    held = held.withColumn("island", F.col("_base") + F.col("place") + 1)
    return held.groupBy("source_id", "island", "url", "title").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("seen_count").alias("seen_count"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there, into a folder for each micro-batch (only the last one's in complete mode), and return a table over these.

    A micro-batch that is tried again overwrites its own folder.
    """
    at = f"{path.rstrip('/')}/batches"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/batch={number}" if mode != "complete" else f"{at}/batch=0")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/*")
