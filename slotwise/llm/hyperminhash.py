"""Near-duplicates by HyperMinHash.

A document is the set of 64-bit hashes of its distinct word shingles. Documents with equal sets make a class, and the class's
smallest id stands for it. A class's sketch has one register for each of 128 buckets of hash space: the number of leading zeros
of the bucket's smallest hash and the ten bits behind its first one (0: nothing fell there). Registers are cut into
bands, and classes that agree on a band are candidates.

At a similarity of t = 0.8, sets of up to n shingles differ in at most D = (1 - t) / t * n of them, and each of these spoils one
band. Small sets get about 1.25 * (D + 1) wide bands, by classes of size, so one filled band at least is left as it is and no pair
is lost (empty bands serve too where fewer than D + 1 are filled). Sets of more than about 100 shingles get 32 bands of four
registers, of which two at least must be filled; there a pair at the threshold shares none with a probability of about
(1 - 0.8 ** 4) ** 32, 5e-8, or less.

No pair ever becomes a row. Members of a band are compared in memory by their sketches: a pair's Jaccard similarity is estimated,
corrected for registers that agree by chance, and what may reach the threshold is joined; only a spanning forest of these joins
leaves the task, fewer rows than the band has members. Its components are clusters. Each class then takes its full set to its
cluster once, and there pairs that may be links are verified by counting common shingles, again joined as a forest. Groups
beyond a block's size are compared in rounds, and taken apart by the registers that their members share: see `_forest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _graph, _sieve, _work
from ._tokens import SPACED, Words, mix, slices, texts_of, tidy

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: Members of a band, and bytes of the sets of a cluster, that are compared in one block of memory.
BLOCK_MEMBERS, BLOCK_BYTES = 4096, 8 << 20
SHINGLE, THRESHOLD_PCT = 5, 80
#: Standard deviations below the threshold at which an estimate still goes to verification.
SLACK = 6.0

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_PLACE = mix(np.arange(BUCKETS, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text of fewer words, but not none, has one of them all."""
    h = words.hash
    n = len(h) - size + 1
    if n > 0:
        every = np.zeros(n, np.uint64)
        for j in range(size):
            every += mix(h[j : j + n] + np.uint64(j)) * _K[j % len(_K)]
        every = mix(every)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one * _K[0] + h[j])
            yield one
        else:
            yield h[:0]


def registers(u: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of hashes."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(u):
        bits = BUCKETS.bit_length() - 1
        bucket = (u >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest of each bucket
        v = u[first] << np.uint64(bits)
        zeros = 53 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1]
        zeros = np.where(v >> np.uint64(11) == 0, 53, zeros)
        mantissa = (v << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1) << MANTISSA).astype(np.uint64) + mantissa
    return out


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches (rows), and on how many buckets it rests. Registers of different minima agree with
    probability 0.6796 * ab / (a + b)**2 / 2**MANTISSA for bucket loads a and b; that share is taken out."""
    filled = ((x > 0) | (y > 0)).sum(1)
    same = ((x == y) & (x > 0)).sum(1)
    chance = 0.6796 * nx * ny / np.maximum(nx + ny, 1) ** 2 / 2**MANTISSA
    k = np.maximum(filled, 1)
    return (same / k - chance) / (1 - chance), k


def _sketcher(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(1))
        n, keys, sketches = [], [], []
        for a, b in slices([len(t) for t in texts]):
            for u in shingles(Words(texts[a:b], SPACED), size):
                n.append(len(u))
                keys.append(hashlib.sha256(u.tobytes()).digest()[:16] if len(u) else None)
                sketches.append(registers(u).tobytes() if len(u) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["id", "n", "key", "sketch"])


def plan_bands(n: int, threshold_pct: int = THRESHOLD_PCT) -> list[tuple[int, int, int]]:
    """(class, bands, most differences) of the bandings in which a set of n shingles takes part: its own class of size and the next, class -1 for all large ones."""
    ratio = 100 / threshold_pct
    own, out = 0, []
    while ratio ** (own + 1) <= n:
        own += 1
    for c in (own, own + 1):
        most = int((ratio - 1) * ratio ** (c + 1))
        bands = -(-5 * (most + 1) // 4)
        out.append((c, bands, most) if bands < BANDS else (-1, BANDS, 0))
    return sorted(set(out))


def band_keys(sketch: np.ndarray, n: int, threshold_pct: int = THRESHOLD_PCT) -> list[int]:
    out = []
    for c, bands, most in plan_bands(n, threshold_pct):
        edges = np.arange(bands) * BUCKETS // bands
        filled = np.add.reduceat((sketch > 0).astype(np.int64), edges)
        value = np.add.reduceat(mix(sketch.astype(np.uint64) + np.uint64(1)) * _PLACE, edges)
        key = mix(value + mix(np.arange(bands, dtype=np.uint64) + np.uint64((c + 2) * 1000)))
        use = filled >= 2 if c < 0 else filled > 0
        if c >= 0 and int(use.sum()) <= most:
            use[:] = True
        out += key[use].view(np.int64).tolist()
    return out


def _bander(threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, keys = [], []
            for rep, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = band_keys(np.frombuffer(sketch, np.uint16), n, threshold_pct)
                keys += own
                reps += [rep] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reps, pa.int64())], ["grp", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows come sorted by their first `keys` columns (longs); yields one table for each value of these, groups of one row left out."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == 0 and held and last != key[0].tolist():
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            if b < batch.num_rows:
                if held or b - a > 1:
                    yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held = []
            else:
                held.append(batch.slice(a, b - a))
        last = key[-1].tolist()
    if sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


class _Sketches:
    """Which of some members may be linked with one of them, by their sketches."""

    def __init__(self, table: pa.Table, threshold_pct: int):
        self.pct, self.t = threshold_pct, threshold_pct / 100
        self.n = table.column("n").to_numpy()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)

    def near(self, one: int, left: np.ndarray) -> np.ndarray:
        n = self.n[left]
        out = 100 * np.minimum(n, self.n[one]) >= self.pct * np.maximum(n, self.n[one])
        at = np.flatnonzero(out)
        if len(at):
            j, k = estimate(self.sketch[left[at]], self.sketch[one][None, :], n[at].astype(float), np.full(len(at), float(self.n[one])))
            out[at] = j >= self.t - SLACK * np.sqrt(self.t * (1 - self.t) / k)
        return out


class _Sets(_Sketches):
    """The same, verified on the full sets."""

    def __init__(self, table: pa.Table, threshold_pct: int):
        super().__init__(table, threshold_pct)
        every, code = np.unique(np.frombuffer(b"".join(table.column("set").to_pylist()), np.uint64), return_inverse=True)
        self.codes = np.split(code.astype(np.int32), np.cumsum(self.n)[:-1])
        self.marks = np.zeros(len(every), np.uint8)

    def near(self, one: int, left: np.ndarray) -> np.ndarray:
        out = super().near(one, left)
        at = np.flatnonzero(out)
        if len(at):
            self.marks[self.codes[one]] = 1
            own = left[at]
            edge = np.cumsum(self.n[own]) - self.n[own]
            common = np.add.reduceat(self.marks[np.concatenate([self.codes[i] for i in own.tolist()])].astype(np.int64), edge)
            self.marks[self.codes[one]] = 0
            out[at] = 100 * common >= self.pct * (self.n[own] + self.n[one] - common)
        return out


def _joins(node: np.ndarray, comp: np.ndarray, near) -> Iterator[tuple[int, int]]:
    """A spanning forest, as pairs of nodes, of what `near` joins; members of one comp count as joined already."""
    left = np.lexsort((node, comp))
    while len(left):
        queue = [int(left[0])]
        left = left[1:]
        while queue and len(left):
            one = queue.pop()
            known = comp[left] == comp[one]
            hit = np.zeros(len(left), bool)
            other = np.flatnonzero(~known)
            if len(other):
                hit[other] = near(one, left[other])
                for i in left[hit].tolist():
                    yield int(node[i]), int(node[one])
            new = known | hit
            queue += left[new].tolist()
            left = left[~new]


def _joiner(kind: type, threshold_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in _groups(batches, 3):
            node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
            if (node != node[0]).any() and (comp != comp[0]).any():
                found += _joins(node, comp, kind(table, threshold_pct).near)
            if len(found) >= 10_000:
                yield _pair_rows(found)
                found = []
        yield _pair_rows(found)

    return run


def _pair_rows(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def least_common(n: np.ndarray, filled: np.ndarray, threshold_pct: int) -> np.ndarray:
    """How many registers of a sketch, of `filled` filled ones and n shingles, must agree with those of any set that `near` may join with it and that is linked with it.

    Of the registers that either fills, `near` asks for a share of t - SLACK * sqrt(t * (1 - t) / k), which rises with k beyond
    9 * (1 - t) / t; and a linked set differs in (1 - t) / t * n shingles at most, each of which spoils one register.
    """
    t = threshold_pct / 100
    k = np.maximum(filled, SLACK**2 / 4 * (1 - t) / t)
    by_estimate = np.ceil(k * t - SLACK * np.sqrt(t * (1 - t) * k) - 1e-9)
    by_size = filled - (100 - threshold_pct) * n // threshold_pct
    return np.maximum(by_estimate, by_size).astype(np.int64)


def _elements(threshold_pct: int):
    """(grp, node, comp, main, who, n, sketch) to a row for each filled register; elem is its bucket and value, need how many of a member's rarest ones have one that agrees with any near set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                member, bucket = np.nonzero(sketch)
                filled = (sketch > 0).sum(1)
                common = least_common(batch.column("n").to_numpy(), filled, threshold_pct)
                need = np.where(common > 0, filled - common + 1, -1)  # -1: this member may be near without a common register
                elem = (bucket << 16) + sketch[member, bucket]
                rows = batch.select(["grp", "node", "comp", "main", "who"]).take(pa.array(member))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(elem, pa.int64()), pa.array(need[member], pa.int64())], [*rows.schema.names, "elem", "need"])

    return run


def _narrowed(wide: DataFrame, totals: DataFrame, work: str, threshold_pct: int) -> DataFrame:
    """Members of large groups by groups within these: (grp, elem, node, comp, who).

    A prefix filter on registers: two near members agree in `least_common` registers at least, so the rarest ones of an outsider, all
    but that many less one, hold one of these. Outsiders go to the groups of their rarest registers, the others to those that an outsider
    has. Groups of one comp have nothing left to join. A group stays as it was where that makes fewer rows, or where some member may be near with no register in common.
    """
    every = wide.withColumn("main", F.col("comp") == F.col("main")).select("grp", "node", "comp", "main", "who", "n", "sketch")
    every = every.mapInArrow(tidy(_elements(threshold_pct)), "grp long, node long, comp long, main boolean, who long, elem long, need long")
    every = _work.settle(every, f"{work}/elements")
    outside = every.where("not main")
    common = outside.groupBy("grp", "elem").agg(F.count("*").alias("often"))
    order = Window.partitionBy("grp", "node", "who").orderBy("often", "elem")
    rare = outside.join(common, ["grp", "elem"]).withColumn("at", F.dense_rank().over(order)).where("at <= need").drop("often", "at")
    rare = _work.settle(rare.select("grp", "elem", "node", "comp", "who").distinct(), f"{work}/rare")
    met = every.where("main").join(rare.select("grp", "elem").distinct(), ["grp", "elem"], "left_semi").select("grp", "elem", "node", "comp", "who").distinct()
    both = rare.unionByName(met)
    use = both.groupBy("grp", "elem").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp", "elem", "m")
    unsure = every.where("need < 0").select("grp").distinct()
    fewer = totals.join(use.groupBy("grp").agg(F.sum("m").alias("made")), "grp", "left").where("coalesce(made, 0) < direct").join(unsure, "grp", "left_anti").select("grp")
    fewer = _work.settle(fewer, f"{work}/fewer")
    return _work.settle(both.join(use.join(fewer, "grp", "left_semi"), ["grp", "elem"]).select("grp", "elem", "node", "comp", "who"), f"{work}/narrowed")


def _forest(rows: DataFrame, sizes: DataFrame, kind: type, payload: list[str], work: str, threshold_pct: int, again: int = 2) -> DataFrame:
    """Pairs (a, b) of nodes that join, within each group, the members that `kind` holds to be near.

    rows: grp, node, payload, and comp (what a node is joined with already) or none; sizes: grp, lead (the smallest node), chunks. A group of
    one chunk is compared whole. Members of a larger one are dealt to chunks; at first each chunk is compared by itself and with the group's
    smallest member. What is in the component of that one after this is done with each other. Members outside it, if they fit two
    chunks, meet all others, chunk by chunk: rows in proportion. If they are more, the group is taken apart by the registers that its members share
    (`_narrowed`), and the parts are groups like these, twice at most; a part that is too large even then meets chunk by chunk.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["grp", "i", "j", "node", "comp", *payload]

    def joined(blocks: DataFrame, name: str) -> DataFrame:
        dealt = blocks.select(*columns).repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        return _work.settle(dealt.mapInArrow(tidy(_joiner(kind, threshold_pct)), "a long, b long").distinct(), f"{work}/{name}")

    zero = F.lit(0).cast("long")
    if "comp" not in rows.columns:
        rows = rows.withColumn("comp", F.col("node"))
    placed = rows.join(sizes, "grp").withColumn("i", F.pmod(F.xxhash64("node"), F.col("chunks")))
    # A leader goes to the chunks that are not its own.
    to = F.when((F.col("node") == F.col("lead")) & (F.col("chunks") > 1), F.sequence(zero, F.col("chunks") - 1)).otherwise(F.array("i"))
    first = joined(placed.withColumn("i", F.explode(to)).withColumn("j", zero), "first")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return first
    placed = placed.where("chunks > 1")
    known = first.unionByName(placed.where("comp <> node").select(F.col("node").alias("a"), F.col("comp").alias("b")).distinct())
    comps = _graph.components(known, f"{work}/between").withColumnRenamed("node", "x").withColumnRenamed("comp", "y")
    named = placed.drop("comp").join(comps, F.col("node") == F.col("x"), "left").withColumn("comp", F.coalesce("y", "node")).drop("x", "y")
    mains = large.select("grp", "lead").join(comps, F.col("lead") == F.col("x"), "left").select("grp", F.coalesce("y", "lead").alias("main"))
    named = _work.settle(named.join(mains, "grp").withColumn("who", F.xxhash64("node", "sketch")), f"{work}/named")
    # As many chunks of outsiders as their share of the group's members asks for.
    share = named.groupBy("grp").agg(F.count("*").alias("m"), F.max("chunks").alias("chunks"), F.count_if(F.expr("comp <> main")).alias("outs")).where("outs > 0")
    share = _work.settle(share.withColumn("out", F.ceil(F.col("chunks") * F.col("outs") / F.col("m"))), f"{work}/share")
    found = first
    many = share.where("out > 2")
    if again and not many.isEmpty():
        totals = many.select("grp", (F.col("m") * F.col("out") + F.col("outs") * F.col("chunks")).alias("direct"))
        within = _narrowed(named.join(many.select("grp"), "grp", "left_semi"), totals, f"{work}/within", threshold_pct)
        part = F.xxhash64("grp", "elem")
        filling = share.select("grp", (F.col("m") / F.col("chunks")).alias("filling"))
        sub = within.join(filling, "grp").groupBy(part.alias("grp")).agg(F.min("node").alias("lead"), F.ceil(F.count("*") / F.min("filling")).alias("chunks"))
        sub = _work.settle(sub, f"{work}/sub")
        full = named.select("grp", "node", "who", *payload).distinct()
        inner = within.join(full, ["grp", "node", "who"]).select(part.alias("grp"), "node", "comp", *payload)
        found = found.unionByName(_forest(inner, sub, kind, payload, f"{work}/parts", threshold_pct, again - 1))
        share = share.join(spark.read.schema("grp long").parquet(f"{work}/within/fewer"), "grp", "left_anti")
    share = share.select("grp", "out")
    members = named.join(share, "grp").withColumn("j", F.explode(F.sequence(zero, F.col("out") - 1)))
    probes = named.where("comp <> main").join(share, "grp").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("out"))).withColumn("i", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    return found.unionByName(joined(members.select(*columns).unionByName(probes.select(*columns)), "second"))


def _setter(size: int):
    """(grp, node, text) to the text's set and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for a, b in slices([len(t) for t in texts]):
                sets = list(shingles(Words(texts[a:b], SPACED), size))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array([len(u) for u in sets], pa.int64()), pa.array([registers(u).tobytes() for u in sets], pa.binary()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    ["grp", "node", "n", "sketch", "set"],
                )

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT, block_members: int = BLOCK_MEMBERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id (the smallest id that links reach, itself included), kept.

    Null texts and texts without words have no shingles and no links. Null ids take no part in links: component_id is null and
    kept true. Rows that repeat an id count as one document, whatever their texts: they have one component, and the links of all their
    texts. Texts of any length are compared whole. Other columns of docs are ignored whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = _work.shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    sketched = _work.settle(rows.mapInArrow(tidy(lambda it: _sketcher(it, size)), "id long, n long, key binary, sketch binary"), f"{work}/sketched")
    # A class's node is its smallest id. Two classes of one id are one node, and each adds its own bands and sets to it.
    reps = sketched.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = _work.settle(reps, f"{work}/reps")
    bands = _work.settle(reps.select("rep", "n", "sketch").mapInArrow(tidy(_bander(threshold_pct)), "grp long, node long"), f"{work}/bands")

    sizes = bands.groupBy("grp").agg(F.min("node").alias("lead"), F.count("*").alias("m"), F.max("node").alias("last")).where("lead <> last")
    sizes = _work.settle(sizes.select("grp", "lead", F.ceil(F.col("m") / block_members).alias("chunks")), f"{work}/sizes")
    shared = bands.join(sizes.select("grp"), "grp", "left_semi").join(reps.select(F.col("rep").alias("node"), "n", "sketch"), "node")
    likely = _forest(shared.select("grp", "node", "n", "sketch"), sizes, _Sketches, ["n", "sketch"], f"{work}/likely", threshold_pct)
    _work.drop(spark, f"{work}/bands")
    clusters = _graph.components(likely, f"{work}/clusters")

    # Each member's set goes to its cluster once.
    own = _sieve.flag(rows, F.col("id"), clusters.select("node")).where("maybe").drop("maybe")
    own = own.join(clusters.select(F.col("node").alias("id"), F.col("comp").alias("grp")), "id")
    own = own.select("grp", F.col("id").alias("node"), "body").mapInArrow(tidy(_setter(size)), "grp long, node long, n long, sketch binary, set binary")
    own = _work.settle(own.where("n > 0"), f"{work}/sets")
    sizes = own.groupBy("grp").agg(F.min("node").alias("lead"), F.ceil(F.sum("n") * 8 / block_bytes).alias("chunks"))
    sizes = _work.settle(sizes, f"{work}/cluster_sizes")
    links = _forest(own, sizes, _Sets, ["n", "sketch", "set"], f"{work}/links", threshold_pct)

    # An id that stands in several classes links them.
    again = sketched.where("id is not null and n > 0").groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id")
    by_id = sketched.where("n > 0").join(again, "id").join(reps.select("key", "rep"), "key").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    held = by_id.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("a")
    same = reps.select(F.col("rep").alias("a")).distinct().join(by_id.distinct(), "a").unionByName(by_id.distinct().join(held, "a", "left_semi"))
    comps = _graph.components(links.unionByName(same), f"{work}/comps")
    _work.drop(spark, f"{work}/sets")

    classes = reps.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    out = sketched.select("id", "n", "key").join(classes, "key", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
