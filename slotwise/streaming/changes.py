"""Changes between consecutive ranked snapshots over a stream: the twin of `operators.diff.snapshot_diff`.

State by source: the items of the runs that the watermark hasn't passed, one entry for each run and story, and the stories of the last run
that it has. A timer at each run's time closes it when the watermark is past; runs close in order of their times, whatever order they came in. What a closed run held leaves the
state once its successor is closed, so the state is the open runs' rows and one run for each source. The state store must be RocksDB: see `use_rocksdb`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "source_id string, run_id string, prev_run_id string, at long, event_type string, key string, from_rank long, to_rank long, from_title string, to_title string, url string, seq long"
ITEM = "rank long, title string, url string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _order(item: tuple) -> tuple:
    """Nulls first, as Spark compares structs."""
    return tuple((x is not None, x if x is not None else 0) for x in item)


class SnapshotDiff(StatefulProcessor):
    """Rows (source_id, run_id, at: microseconds, key, rank, title, url) to change events. A row without key says only that its run took place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long, run_id string, key string", ITEM)
        self.last = handle.getMapState("last", "key string", ITEM)
        self.closed = handle.getValueState("closed", "at long, run_id string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        known: dict[tuple, tuple] = {}
        for r in rows:
            if r.at // 1000 + 1 <= mark:
                continue  # its run is closed
            at, item = (r.at, r.run_id or "", r.key or ""), (r.rank, r.title, r.url)
            if at not in known and self.open.containsKey(at):
                known[at] = tuple(self.open.getValue(at))
            if at not in known or _order(item) > _order(known[at]):
                known[at] = item
                self.open.updateValue(at, item)
            self.handle.registerTimer(r.at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        at, last_run, until = self.closed.get() if self.closed.exists() else (None, None, 0)
        if expiredTimerInfo.getExpiryTimeInMs() <= until:
            return  # an earlier timer of this batch has closed all that the watermark has passed
        runs: dict[int, dict[str, dict[str, tuple]]] = {}
        for k, v in self.open.iterator():
            if k[0] // 1000 + 1 <= mark:
                runs.setdefault(k[0], {}).setdefault(k[1], {})[k[2]] = tuple(v)
        before = {k[0]: tuple(v) for k, v in self.last.iterator()} if runs else {}
        for at in sorted(runs):
            for run in sorted(runs[at]):
                items = {k: v for k, v in runs[at][run].items() if k}
                yield from _events(key[0], run, last_run, at, before, items)
                for k in runs[at][run]:
                    self.open.removeKey((at, run, k))
            last_run = max(runs[at])  # runs of one instant share their predecessor
            before = {k: v for k, v in runs[at][last_run].items() if k}
        if runs:
            self.last.clear()
            for k, v in before.items():
                self.last.updateValue((k,), v)
        self.closed.update((at, last_run, mark))


def _events(source: str, run: str, last_run: str | None, at: int, before: dict[str, tuple], now: dict[str, tuple]) -> Iterator[Row]:
    for k in sorted({*before, *now}):
        p, c = before.get(k), now.get(k)
        kinds = []
        if p is None:
            kinds.append(("ENTER", 1))
        elif c is None:
            kinds.append(("EXIT", 1))
        else:
            if None not in (p[0], c[0]) and p[0] != c[0]:
                kinds.append(("MOVE", 1))
            if p[1] and c[1] and p[1] != c[1]:
                kinds.append(("EDIT", 2))
        for kind, seq in kinds:
            (p_rank, p_title, p_url), (c_rank, c_title, c_url) = p or (None,) * 3, c or (None,) * 3
            yield Row(source_id=source, run_id=run, prev_run_id=last_run, at=at, event_type=kind, key=k, from_rank=p_rank, to_rank=c_rank, from_title=p_title, to_title=c_title, url=c_url if c_url is not None else p_url, seq=seq)


def snapshot_diff(items: DataFrame, key: str = "fingerprint", watermark: str = "1 day") -> DataFrame:
    """Change events of a stream of ranked rows (source_id, run_id, observed_at, rank, title, url and the key), in append mode: those of `diff.snapshot_diff` for every run that the
    watermark has passed, each once. Rows that come after it has are lost. A run without rows takes a row of null key. The watermark is that of all sources: the newest
    runs stay open until later rows come from any of them. Rows without source or time are left out."""
    use_rocksdb(items.sparkSession)
    rows = items.withColumn("observed_at", F.col("observed_at").cast("timestamp")).where("source_id is not null and observed_at is not null").withWatermark("observed_at", watermark)
    rows = rows.select("source_id", "run_id", "observed_at", F.unix_micros("observed_at").alias("at"), F.col(key).alias("key"), F.col("rank").cast("long").alias("rank"), "title", "url")
    out = rows.groupBy("source_id").transformWithState(SnapshotDiff(), OUT, "Append", "EventTime")
    return out.select("source_id", "run_id", "prev_run_id", F.timestamp_micros("at").alias("observed_at"), "event_type", "key", "from_rank", "to_rank", "from_title", "to_title", "url", "seq")
