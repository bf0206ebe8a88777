"""Folders that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the most bits that `possible` broadcasts: 128 MB.
MOST_BITS = 30


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session without that setting, as in tests, takes its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix=f"slotwise-{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back, so that what uses it several times makes it once."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let the session send rows to Python in batches of at most so many rows and bytes; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key, str(most)))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def possible(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key (a long) may be in the one column of `keys`, told by a bit map of 16 bits a key, 128 MB at most; surely none that is. Some others stay too: one in 16, more beyond 2**26 keys. Spares a join what can't meet."""
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(keys.count() + 1)) + 4))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = place(F.col(keys.columns[0]))
    marks = keys.groupBy(F.bitmap_bucket_number(at).alias("_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    told = rows.withColumn("_chunk", F.bitmap_bucket_number(place(key))).withColumn("_at", F.bitmap_bit_position(place(key))).join(F.broadcast(marks), "_chunk")  # 2**(bits - 15) rows of 4 KB
    byte = F.ascii(F.decode(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    return told.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).drop("_chunk", "_at", "_bits")
