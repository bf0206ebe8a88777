"""Run-length history, "since", change capture and carried state, over observation rows ordered by (observed_at, id).

Rows without a source are a source of their own; rows without a time come before all others of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order() -> list[str]:
    return ["observed_at", "id"]


DAY = "_day"


def _by_day(rows: DataFrame, value: Column, group: str) -> tuple[DataFrame, DataFrame]:
    """rows with their day, `_now` (the value compared) and `_prev` (that of the row before in the day); and for each day `_edge`, the value of the row before it.

    Rows of a group are ordered within days only, so a group is as many tasks' work as it has days; what passes from one day to the
    next is a row for each.
    """
    rows = rows.withColumn(DAY, F.to_date("observed_at")).withColumn("_now", value)
    rows = rows.withColumn("_prev", F.lag("_now").over(Window.partitionBy(group, DAY).orderBy(*_order())))
    days = rows.groupBy(group, DAY).agg(F.max_by("_now", F.struct(*_order())).alias("_last"), F.min_by("_now", F.struct(*_order())).alias("_first"))
    days = days.withColumn("_edge", F.lag("_last").over(Window.partitionBy(group).orderBy(DAY)))
    return rows, days


def _with_days(rows: DataFrame, days: DataFrame, group: str) -> DataFrame:
    """rows with their day's columns; rows without group or time are of one group or day of their own."""
    own = days.withColumnsRenamed({group: "_g", DAY: "_d"})
    return rows.join(own, F.col(group).eqNullSafe(F.col("_g")) & F.col(DAY).eqNullSafe(F.col("_d"))).drop("_g", "_d")


def islands(obs: DataFrame, by: list[str], attributes: list[str] = (), group: str = "source_id") -> DataFrame:
    """One row for each run of equal `by` values: group, island, by, first_seen_at, last_seen_at, seen_count, attributes.

    Rows whose first `by` column is null are skipped and break nothing. An attribute is the last in the run that is not null.
    """
    rows, days = _by_day(obs.where(F.col(by[0]).isNotNull()), F.struct(*by), group)
    # Steps within the day; the day's first row is one if it differs from the row before the day.
    step = F.when(F.col("_prev").isNotNull() & ~F.col("_prev").eqNullSafe(F.col("_now")), 1).otherwise(0)
    rows = rows.withColumn("_step", F.sum(step).over(Window.partitionBy(group, DAY).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)))
    steps = rows.groupBy(group, DAY).agg(F.max("_step").alias("_steps"))
    days = _with_days(days, steps, group).withColumn("_new", F.when(F.col("_edge").eqNullSafe(F.col("_first")), 0).otherwise(1))
    upto = Window.partitionBy(group).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(group, DAY, (F.sum("_new").over(upto) + F.sum("_steps").over(upto) - F.col("_steps")).alias("_base"))
    rows = _with_days(rows, days, group).withColumn("island", (F.col("_base") + F.col("_step")).cast("long"))
    last = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.struct(*_order()))).alias(a) for a in attributes]
    return rows.groupBy(group, "island", *by).agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("seen_count"), *last)


def current_since(obs: DataFrame, key: str = "url", group: str = "source_id") -> DataFrame:
    """The last island of each group by one key: since when it has been there, and for how many seconds."""
    runs = islands(obs, [key], group=group)
    last = runs.groupBy(group).agg(F.max_by(F.struct(key, "first_seen_at", "last_seen_at", "seen_count"), "island").alias("x")).select(group, "x.*")
    seconds = F.unix_timestamp(F.col("last_seen_at").cast("timestamp")) - F.unix_timestamp(F.col("first_seen_at").cast("timestamp"))
    return last.withColumn("seconds_in_top", seconds)


def changed_only(obs: DataFrame, cols: list[str], group: str = "source_id") -> DataFrame:
    """Rows that differ from the one before them in any of cols; null and '' are the same."""
    plain = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    rows, days = _by_day(obs, plain, group)
    rows = _with_days(rows, days.select(group, DAY, "_edge"), group)
    before = F.coalesce("_prev", "_edge")
    return rows.where(before.isNull() | (before != F.col("_now"))).select(*obs.columns)


def current_state(obs: DataFrame, item: list[str], group: str = "source_id") -> DataFrame:
    """The last row of each group, with the items of its last row that was ok, and whether that is stale."""
    order = F.struct(*_order())
    good = F.when(F.col("ok"), order)
    return obs.groupBy(group).agg(
        F.max("observed_at").alias("updated_at"), F.max_by("ok", order).alias("ok"), *[F.max_by(F.col(c), good).alias(c) for c in item], F.max(F.when(F.col("ok"), F.col("observed_at"))).alias("good_at")
    ).withColumn("stale", ~F.col("ok") & F.col("good_at").isNotNull())


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest wins by version; a change beats a base row of the same version."""
    rows = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    cols = [c for c in base.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_side"), *[F.col(c) for c in cols])).alias("x"))
    return best.select(key, "x.*")
