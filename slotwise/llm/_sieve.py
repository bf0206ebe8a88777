"""A bit map of bounded size over a set of keys: rows surely outside the set are told apart without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the most bits that are broadcast: 128 MB.
MOST_BITS = 30


def flag(rows: DataFrame, key: Column, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """rows with a boolean: false where `key` (a long) is surely not in the one column of `keys`. About one row in 16 errs to true, more only beyond 2**26 keys. A null key is false."""
    n = keys.count()
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(n + 1)) + 4))
    k = keys.columns[0]
    at = F.pmod(F.xxhash64(F.col(k)), F.lit(1 << bits))
    marks = keys.where(F.col(k).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("_chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    own = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    out = rows.withColumn("_chunk", F.bitmap_bucket_number(own)).withColumn("_at", F.bitmap_bit_position(own)).join(F.broadcast(marks), "_chunk", "left")  # 2**(bits - 15) rows of 4 KB at most
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0, F.lit(False)) & key.isNotNull()
    return out.withColumn(name, hit).drop("_chunk", "_at", "_bits")


def without(rows: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """rows whose id_col is not in the one column of `gone`; only rows that may be are shuffled. Null ids stay."""
    columns = rows.columns
    plain = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    key = f"c{columns.index(id_col)}"
    flagged = flag(plain, F.col(key).cast("long"), gone, "_maybe")
    ids = gone.toDF("_gone").distinct()
    maybe = flagged.where("_maybe").join(ids, F.col(key).cast("long") == F.col("_gone"), "left_anti")
    return flagged.where(~F.col("_maybe")).unionByName(maybe).drop("_maybe").toDF(*columns)
