"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session without that setting, as in tests, gets a folder of its own: on a cluster, executors would each write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="slotwise-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/slotwise-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let the session send texts to Python in batches of at most so many rows and bytes; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key, str(most)))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def settle(df: DataFrame, path: str, **options) -> DataFrame:
    """Write df as a table at path and read it back: its lineage ends there, and a lost executor costs no rerun of what made it."""
    df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared folder, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every shared folder made by this driver. Results that still read them can't be used afterwards."""
    while _made:
        drop(spark, _made.pop())
