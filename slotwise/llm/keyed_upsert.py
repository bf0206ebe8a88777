"""Copy-on-write upsert of a table of sorted files, cut by exact splitters that no global sort makes.

Histograms of key ranges, round after round, close in on every M-th order statistic: a round counts the keys in some thousand
ranges, and only the ranges that hold a wanted rank are cut again, until each holds one key. These splitters deal the rows to files
(partitioner) and say which file a changed key belongs to (home index). Rows and the changes to them are dealt by the same ranges, sorted
in their tasks and met by a merge join. Only files whose rows then differ are written anew; their cuts are order statistics again,
so no task holds more than a file's rows, however many changes one home takes.

The driver holds a number for each file and for each range of one round, never rows. The number of files is rows over M: let M grow
with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _work

#: Ranges that one round counts, in all; more only where more ranks than half of this are wanted.
RANGES = 8192
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Changes of one home, in files' rows, beyond which its keys are dealt to several tasks.
CROWDED = 4


def _counter(edges: np.ndarray, inside: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(edges), np.int64)
        least, most = np.full(len(edges), _MOST, np.int64), np.full(len(edges), _LEAST, np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, keys, "right") - 1
            ok = at >= 0
            ok[ok] = inside[at[ok]]
            at, keys = at[ok], keys[ok]
            n += np.bincount(at, minlength=len(edges))
            np.minimum.at(least, at, keys)
            np.maximum.at(most, at, keys)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full.astype(np.int64), n[full], least[full], most[full])], ["range", "n", "least", "most"])

    return run


def order_statistics(keys: DataFrame, ranks: list[int]) -> list[int]:
    """The keys (one column of longs, without nulls) at these ranks, counted from 0 in ascending order, without sorting the table. Ranks beyond the table give nothing; equal keys take as many ranks as they have rows."""
    found: dict[int, int] = {}
    # (least, most, keys below, wanted ranks): disjoint ranges in ascending order.
    open_ = [(_LEAST, _MOST, 0, sorted(set(ranks)))] if ranks else []
    while open_:
        edges: list[int] = []
        owner: list[int] = []
        for i, (least, most, _, _) in enumerate(open_):
            if edges and edges[-1] == least:  # the end of the range before
                edges.pop()
                owner.pop()
            width = most - least + 1
            cuts = min(max(2, RANGES // len(open_)), width)
            edges += [least + width * j // cuts for j in range(cuts)]
            owner += [i] * cuts
            if most < _MOST:
                edges.append(most + 1)
                owner.append(-1)
        counter = _counter(np.array(edges, np.int64), np.array(owner) >= 0)
        rows = keys.mapInArrow(counter, "range long, n long, least long, most long").groupBy("range").agg(F.sum("n"), F.min("least"), F.max("most")).collect()
        counted: dict[int, list] = {}
        for r in sorted(rows):
            counted.setdefault(owner[r[0]], []).append(r[1:])
        narrower = []
        for i, (_, _, below, wanted) in enumerate(open_):
            for n, least, most in counted.get(i, []):
                mine = [r for r in wanted if below <= r < below + n]
                if least == most:
                    found |= dict.fromkeys(mine, least)
                elif mine:
                    narrower.append((least, most, below, mine))
                below += n
        open_ = narrower
    return [found[r] for r in ranks if r in found]


def _lookup(splitters: list[int], values: np.ndarray, kind: str) -> Callable[[Column], Column]:
    cuts = np.array(splitters, np.int64)

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(values[np.maximum(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), "right") - 1, 0)])

    return F.arrow_udf(run, kind)


def place(key: Column, splitters: list[int]) -> Column:
    """The number of the range that holds a key (a long, not null): the last splitter at or below it, else the first."""
    return _lookup(splitters, np.arange(max(1, len(splitters)), dtype=np.int32), "int")(key) if splitters else F.lit(0)


def _first_of(key: Column, splitters: list[int]) -> Column:
    return _lookup(splitters, np.array(splitters, np.int64), "long")(key) if splitters else F.lit(None).cast("long")


def write_sorted(rows: DataFrame, key: str, size: int, folder: str) -> list[int]:
    """Append rows to the folder as files of `size` rows, sorted by key over all files; returns each file's first key. Rows of one key stay in one file, which may then hold more."""
    n = rows.count()
    return _write_cut(rows, key, order_statistics(rows.select(F.col(key).cast("long")), list(range(0, n, size))), folder)


def _write_cut(rows: DataFrame, key: str, splitters: list[int], folder: str) -> list[int]:
    splitters = sorted(set(splitters))
    if splitters:
        names = rows.columns
        plain = rows.toDF(*[f"c{i}" for i in range(len(names))])
        k = F.col(f"c{names.index(key)}")
        dealt = plain.withColumn("part", place(k.cast("long"), splitters)).repartitionById(len(splitters), "part").sortWithinPartitions("part", k)
        dealt.drop("part").toDF(*names).write.mode("append").parquet(folder)
    return splitters


def layout(files: list[tuple[int, bool]], size: int) -> list[int]:
    """Rows of each new file, in order, from the starting files' (rows now, rewritten): a rewritten file is cut into the fewest of at most `size` rows, as even as can be, larger first; then each joins its left neighbour if that is new too and both fit."""
    out: list[list] = []  # [rows, is new]
    for n, new in files:
        pieces = -(-n // size) if new else 1
        for i in range(pieces):
            rows = n // pieces + (i < n % pieces)
            if new and out and out[-1][1] and out[-1][0] + rows <= size:
                out[-1][0] += rows
            else:
                out.append([rows, new])
    return [n for n, new in out if new]


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[str], sets: list[str], folder: str, size: int, verdict: Callable[[Column], Column]) -> DataFrame:
    """Write base as files of `size` rows, apply changes, rewrite only the files that differ; a row for each file that is then in the folder: path, rewritten.

    Of the changes to one key the row with the largest `order` columns wins, ties by its other columns, so repeated rows count once. `verdict` takes the first key of the
    change's home file (null if there is none) and gives 'set', 'delete' or anything else, null too, to ignore the change; it may use columns of changes. 'set' copies the columns
    `sets`, nulls too, into every row of the key, or inserts a row whose other columns are null. The home is the last starting file that
    begins at or below the key, else the first. Rows of base or changes without key are left out: they have no place. Rows of base that share a key stay together. An empty base takes
    all inserts as rewritten files; without any row the result is empty and the folder holds no data file. Other columns of changes are ignored, and names of the two tables may clash.
    """
    spark = base.sparkSession
    work = _work.shared_dir(spark)
    names = base.columns
    plain = [f"c{i}" for i in range(len(names))]
    k = plain[names.index(key)]
    _make(spark, folder)
    first = write_sorted(base.where(F.col(key).isNotNull()), key, size, folder)
    kinds = [(f.name, f.dataType) for f in base.schema]
    read = lambda *paths: spark.read.schema(base.schema).parquet(*paths)

    ranked = changes.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.struct(*order, *[c for c in changes.columns if c not in order]).alias("_row"))
    best = ranked.groupBy("_key").agg(F.max("_row").alias("_row"))
    own = {n: n + "_" * max(map(len, changes.columns)) for n in ("key", "home", "first")}  # longer than any name of changes
    best = best.select("_row.*", F.col("_key").alias(own["key"]), place(F.col("_key"), first).alias(own["home"]), _first_of(F.col("_key"), first).alias(own["first"]))
    winners = best.select(F.col(own["key"]).alias("key"), F.col(own["home"]).alias("home"), verdict(F.col(own["first"])).alias("act"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(sets)]).where("act in ('set', 'delete')")
    winners = _work.settle(winners, f"{work}/winners")

    # Homes that take very many changes are cut further for the join.
    load = {r["home"]: r["count"] for r in winners.groupBy("home").count().collect()}
    crowded = [h for h, n in load.items() if n > CROWDED * size]
    extra = order_statistics(winners.where(F.col("home").isin(crowded)).select("key"), list(range(0, sum(load[h] for h in crowded), size))) if crowded else []
    cuts = sorted({*first, *extra})
    begins = read(folder).select(F.col(key).cast("long").alias("k"), F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.min("k").alias("k"))
    paths = {first.index(r["k"]): r["path"] for r in begins.collect()}
    touched = [p for h, p in paths.items() if h in load]

    deal = lambda df, c: df.withColumn("part", place(F.col(c), cuts)).repartitionById(max(1, len(cuts)), "part")
    rows = (read(*touched) if touched else spark.createDataFrame([], base.schema)).toDF(*plain).withColumn("here", F.lit(True)).withColumn("key", F.col(k).cast("long")).withColumn("old", place(F.col("key"), first))
    met = deal(rows, "key").join(deal(winners, "key"), ["part", "key"], "full_outer")
    here, gone, put = F.col("here").isNotNull(), F.coalesce(F.col("act") == "delete", F.lit(False)), F.coalesce(F.col("act") == "set", F.lit(False))
    new = {plain[names.index(c)]: F.col(f"s{i}").cast(dict(kinds)[c]) for i, c in enumerate(sets)}
    differs = F.lit(False)
    for c, value in new.items():
        differs = differs | ~F.col(c).eqNullSafe(value)
    merged = met.where(here | put).select(
        F.coalesce("old", "home").alias("home"), gone.alias("gone"), (gone | (put & (~here | differs))).alias("changed"),
        *[(F.coalesce(c, F.col("key").cast(dict(kinds)[key])) if c == k else F.when(put, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in plain],
    )
    merged = _work.settle(merged, f"{work}/merged")

    counts = {r["home"]: (r["n"], r["changed"]) for r in merged.groupBy("home").agg(F.count_if(~F.col("gone")).alias("n"), F.max("changed").alias("changed")).collect()}
    rewritten = sorted(h for h, (_, changed) in counts.items() if changed)
    sizes = layout([(counts[h][0], True) if h in rewritten else (1, False) for h in range(max(1, len(first)))], size)
    fresh = merged.where(F.col("home").isin(rewritten) & ~F.col("gone")).select(*plain)
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    _write_cut(fresh.toDF(*names), key, order_statistics(fresh.select(F.col(k).cast("long")), starts), folder)
    for h in rewritten:
        if h in paths:
            _work.drop(spark, paths[h])
    kept = [p for h, p in paths.items() if h not in rewritten]
    out = read(folder).select(F.col("_metadata.file_path").alias("path")).distinct()
    return out.withColumn("rewritten", ~F.col("path").isin(kept))


def _make(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, measures...) in order of path and place; a row (path, first, n, sums of the measures..., SHA-256 of the keys) for each path."""
    path, state, names = None, None, []

    def closed(done: list) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * (len(names) + 3)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int64()] * (len(names) - 2), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "first_id", "n_rows", *names[2:], "ids_sha256"])

    for batch in batches:
        names, done = batch.schema.names, []
        paths = batch.column(0).to_pylist()
        keys, measures = batch.column(1).to_pylist(), [batch.column(i).to_pylist() for i in range(2, len(names))]
        start = 0
        while start < len(paths):
            end = start
            while end < len(paths) and paths[end] == paths[start]:
                end += 1
            if paths[start] != path:
                if path is not None:
                    done.append((path, *state[:-1], state[-1].hexdigest()))
                path, state = paths[start], [keys[start], 0, *[0] * len(measures), hashlib.sha256()]
            text = ",".join(map(str, keys[start:end]))
            state[-1].update(("," + text if state[1] else text).encode())
            state[1] += end - start
            for i, m in enumerate(measures):
                state[2 + i] += sum(m[start:end])
            start = end
        if done:
            yield closed(done)
    if path is not None:
        yield closed([(path, *state[:-1], state[-1].hexdigest())])


def describe(files: DataFrame, schema, folder: str, key: str, measures: dict[str, Column]) -> DataFrame:
    """For each file of `files` (path, rewritten): first_id, n_rows, the sums of the measures (longs, not null), ids_sha256 of its keys and columns, both in the file's order, path, rewritten. A task streams through the files that it gets."""
    spark = files.sparkSession
    rows = spark.read.schema(schema).parquet(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), F.col(key).cast("long").alias("id"), *[m.cast("long").alias(n) for n, m in measures.items()])
    dealt = rows.repartition("path").sortWithinPartitions("path", "place").drop("place")
    sums = "".join(f", {n} long" for n in measures)
    out = dealt.mapInArrow(_digests, f"path string, first_id long, n_rows long{sums}, ids_sha256 string")
    return out.join(files, "path").withColumn("columns", F.lit(",".join(f.name for f in schema)))
