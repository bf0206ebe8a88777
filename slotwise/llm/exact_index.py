"""Exact deduplication through an extendible-hash index on shared files.

A key is the head of the SHA-256 of the normalised text (lower-case A-Z, nothing else). The directory maps key prefixes to
buckets: it starts as deep as the number of keys asks for, and while a bucket holds more keys than its capacity the
directory doubles and that bucket splits. A bucket that no prefix can split (one key) is left to chain. The index's pages, keys with
their counts by bucket, are files in the shared folder. Texts of keys that occur more than once are collapsed where they are
read, bytes by bytes, so that a text in a third of all rows leaves each task once or a few times; then owner tasks, each for a
range of buckets, take what is left in order of bucket and key and keep a chain of different texts for each key, comparing bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sieve, _work
from ._tokens import texts_of, tidy

#: Keys in a bucket before it splits.
CAPACITY = 50_000
#: Directory entries that may be broadcast (about 24 bytes each).
BROADCAST_ENTRIES = 250_000
#: Bytes of different texts that a task holds to collapse equal ones.
HELD_BYTES = 16 << 20


def _key_of(digest: bytes, hash_bits: int) -> int:
    return (int.from_bytes(digest[:8], "big") >> (64 - hash_bits) << (64 - hash_bits)) - (1 << 64 if digest[0] >> 7 else 0)


def _keyer(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(t.lower()).digest() for t in texts_of(batch.column(1))]  # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key_of(d, hash_bits) for d in digests], pa.int64()), pa.array(digests, pa.binary()), batch.column(2)], ["id", "h", "sha", "rough"])

    return run


def directory(entries: DataFrame, work: str, capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[int, DataFrame]:
    """The directory's depth and its buckets (prefix, depth: the local one), from rows whose `h` is a key; a key counts once.

    Levels are tables: nothing reaches the driver but the number of buckets that are still to be split.
    """
    spark = entries.sparkSession
    keys = entries.select("h").distinct()
    total = keys.count()
    depth = min(hash_bits, max(0, math.ceil(math.log2(max(1, total / capacity)))))
    wanted = spark.range(1 << depth).toDF("prefix")
    parts = []
    while True:
        at = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
        counts = keys.groupBy(at.alias("prefix")).agg(F.count("*").alias("n"))
        level = wanted.join(counts, "prefix", "left").select("prefix", F.lit(depth).alias("depth"), (F.coalesce("n", F.lit(0)) > (capacity if depth < hash_bits else 1 << 62)).alias("full"))
        level = _work.settle(level, f"{work}/level{depth}")
        parts.append(level.where("not full").select("prefix", "depth"))
        full = level.where("full").select("prefix")
        if full.isEmpty():
            break
        keys = keys.join(full, at == F.col("prefix"), "left_semi")
        wanted = full.select(F.explode(F.array(2 * F.col("prefix"), 2 * F.col("prefix") + 1)).alias("prefix"))
        depth += 1  # the directory doubles
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return depth, out


def _collapse(hash_bits: int):
    """Rows (id, body) of equal normalised bodies to one (h, body, keep, n): as far as a task holds them, a text leaves it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = [_key_of(hashlib.sha256(t).digest(), hash_bits) for t in held]
            cols = (keys, list(held), [x[0] for x in held.values()], [x[1] for x in held.values()])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["h", "body", "keep", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                text = text.lower()
                link = held.get(text)
                if link is None:
                    if held and size + len(text) > HELD_BYTES:
                        yield flush()
                        held, size = {}, 0
                    held[text] = [i, 1]
                    size += len(text)
                else:
                    link[0] = _larger(link[0], i)
                    link[1] += 1
        if held:
            yield flush()

    return run


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, body, keep, n) come by key. For each key a chain of [bytes, largest id, rows]; the chain's links leave when the key ends, larger texts later."""
    key, chain = None, []

    def links() -> list:
        chain.sort(key=lambda x: (len(x[0]), x[0]))
        out = [(key, place, hashlib.sha256(body).digest(), keep, n) for place, (body, keep, n) in enumerate(chain)]
        if len({x[2] for x in out}) < len(out):
            raise ValueError("two different texts have one SHA-256")
        chain.clear()
        return out

    for batch in batches:
        out = []
        for h, body, keep, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != key:
                out += links()
                key = h
            for link in chain:
                if link[0] == body:
                    link[1], link[2] = _larger(link[1], keep), link[2] + n
                    break
            else:
                chain.append([body, keep, n])
        yield _link_rows(out)
    yield _link_rows(links())


def _link_rows(rows: list) -> pa.RecordBatch:
    kinds = (("h", pa.int64()), ("place", pa.int32()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, chain_place.

    Texts are equal when their bytes are, after lower-casing A-Z. Null counts as the empty text, so all null and empty texts
    form one group. The largest id stays; null ids rank lowest, and a group of null ids only keeps them all (keep_id null).
    Rows that repeat both id and text are all marked kept, for no id tells them apart. An empty table gives an empty result.
    Other columns of docs are ignored whatever their names.
    """
    spark = docs.sparkSession
    work = _work.shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    # Texts that are equal after lower-casing A-Z are equal after lower-casing all: the rough hash is cheap, and never tells equal ones apart.
    rough = F.xxhash64(F.lower(F.coalesce("body", F.lit(""))))
    keys = _work.settle(rows.withColumn("rough", rough).mapInArrow(tidy(_keyer(hash_bits)), "id long, h long, sha binary, rough long"), f"{work}/keys")
    entries = _work.settle(keys.groupBy("h").agg(F.count("*").alias("n")), f"{work}/entries")
    depth, buckets = directory(entries, f"{work}/directory", capacity, hash_bits)
    spread = F.expr(f"shiftleft(1L, {depth} - depth)")
    slots = buckets.withColumn("first", F.col("prefix") * spread).withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + spread - 1))).select("slot", F.col("first").alias("bucket"))
    n_slots = 1 << depth
    table = F.broadcast(slots) if n_slots <= BROADCAST_ENTRIES else slots
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # An owner has a range of buckets, in order of their first slots.
    owner = F.floor(F.col("bucket") / n_slots * owners).cast("int")

    # The index's files: every owner writes the pages of its buckets, in order of bucket and key.
    index = entries.withColumn("slot", slot).join(table, "slot").drop("slot").repartitionById(owners, owner).sortWithinPartitions("bucket", "h")
    index = _work.settle(index.select("bucket", "h", "n"), f"{work}/index")

    # Keys of more than one row are to be compared. A bit map of bounded size spares most other texts the way to Python and
    # the shuffle, and the join behind it decides. Keys cut short, as in tests, meet without it.
    repeated = index.where("n > 1").select("h", "bucket")
    again = keys.groupBy("rough").agg(F.count("*").alias("m")).where("m > 1").select("rough")
    texts = _sieve.flag(rows, rough, again).where("maybe").drop("maybe") if hash_bits == 64 else rows
    compared = texts.mapInArrow(tidy(_collapse(hash_bits)), "h long, body binary, keep long, n long").join(repeated, "h")
    chained = compared.repartitionById(owners, owner).sortWithinPartitions("bucket", "h").select("h", "body", "keep", "n")
    links = _work.settle(chained.mapInArrow(tidy(_chains), "h long, place int, sha binary, keep_id long, n long"), f"{work}/links")

    out = keys.drop("rough").join(links, ["h", "sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.coalesce("place", F.lit(0)).alias("chain_place"),
    )
