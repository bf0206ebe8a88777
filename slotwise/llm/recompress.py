"""Substring deduplication by recompression.

A document's words are names of level 0. Each round renames the sequence: a stretch a..a b..b of runs, where a falls on the left
side of a random split of all names and b on the right (or one run alone), becomes one name of the next level. Names are
hashes of what they stand for, so every task gives equal stretches equal names without asking the others. Whether two
neighbours are joined depends on these two alone; so inside equal substrings the same names arise, but for one name at each
end for each round. With every name goes the range of words that decided it.

A window is a run of WINDOW words. Of the names of the highest level that are decided by words inside it, the one with the
smallest hash is its anchor (a lower level serves where there is none; words themselves always do). Equal windows have equal
anchors at equal places, so windows are dealt out by anchor, and those that share its name and place in them are verified by a
64-bit hash of all their words. Two windows that differ are taken for equal only if that hash, the name of the anchor (64 bits, made in other ways)
and its place agree, which among a thousand million windows of one anchor has a probability of about 0.03. Windows that repeat within a task's flush are known to repeat at once, and one of them goes on for all: a passage in a third of
all documents costs each flush one record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sieve, _work
from ._tokens import SPACED, Words, mix, slices, texts_of, tidy

WINDOW, LEVELS = 35, 4
#: Bytes of text whose windows are compared before they are dealt out, and that make one bucket.
FLUSH_BYTES, BUCKET_BYTES = 3 << 20, 4 << 20

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(n, base, np.uint64)
        got[0] = 1
        got = _powers[int(base)] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


class Level:
    """Names, the first word of each, and the first and last word that decided it; `first` marks the first name of a document."""

    def __init__(self, name, start, low, high, first):
        self.name, self.start, self.low, self.high, self.first = name, start, low, high, first


def words_level(words: Words) -> Level:
    n = len(words)
    at = np.arange(n)
    first = np.zeros(n + 1, bool)
    first[words.first] = True
    return Level(words.hash, at, at, at, first[:n])


def next_level(x: Level, number: int, n_words: int) -> Level:
    """Joins runs and left-right pairs of the level below."""
    n = len(x.name)
    if not n:
        return x
    side = (mix(x.name + np.uint64(number) * _C) >> np.uint64(40)) & np.uint64(1)
    same = np.zeros(n, bool)
    same[1:] = (x.name[1:] == x.name[:-1]) & ~x.first[1:]
    pair = np.zeros(n, bool)
    pair[1:] = (side[:-1] == 0) & (side[1:] == 1) & ~x.first[1:]
    head = np.flatnonzero(~(same | pair))
    # Within a block the position counts, so that a..ab..b has a name of its own for any two run lengths.
    size = np.diff(np.append(head, n))
    place = np.arange(n) - np.repeat(head, size)
    terms = mix(x.name) * _power(_A, int(size.max()))[place]
    name = np.where(size == 1, x.name[head], mix(np.add.reduceat(terms, head) + size.astype(np.uint64) * _D + np.uint64(number)))
    first = x.first[head]
    low = np.where(first, x.start[head] - 1, x.low[np.maximum(head - 1, 0)])
    after = head + size
    ends = np.append(x.first, True)[after]  # a document ends before it
    past = np.append(x.start, n_words)[after]
    high = np.where(ends, past, np.append(x.high, n_words)[after])
    return Level(name, x.start[head], low, high, first)


def _least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the smallest key in each range lo..hi, the leftmost of equals."""
    out = np.empty(len(lo), np.int64)
    if not len(lo):
        return out
    size = hi - lo + 1
    depth = np.frexp(size.astype(np.float64))[1] - 1
    table = np.arange(len(key))
    for j in range(int(depth.max()) + 1):
        if j:
            left, right = table[: len(table) - (1 << (j - 1))], table[1 << (j - 1) :]
            table = np.where(key[left] <= key[right], left, right)
        own = np.flatnonzero(depth == j)
        if len(own):
            a, b = table[lo[own]], table[hi[own] - (1 << j) + 1]
            out[own] = np.where(key[a] < key[b], a, np.where(key[b] < key[a], b, np.minimum(a, b)))
    return out


def windows_of(words: Words, window: int) -> np.ndarray:
    """First words of all windows."""
    size = np.maximum(np.diff(words.first) - window + 1, 0)
    offset = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(words.first[:-1] - offset, size)


def anchors(words: Words, at: np.ndarray, window: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """For windows at the given first words: the name and the first word of each one's anchor."""
    n = len(words)
    stack = [words_level(words)]
    for i in range(1, levels + 1):
        stack.append(next_level(stack[-1], i, n))
    name, where = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    left = np.arange(len(at))
    for number in range(levels, -1, -1):
        x = stack[number]
        lo = np.cumsum(np.bincount(x.low + 1, minlength=n + 2))[at[left]]  # names decided by words from there on start here
        hi = np.cumsum(np.bincount(x.high, minlength=n + 2))[at[left] + window - 1] - 1
        ok = lo <= hi
        best = _least(mix(x.name ^ _D), lo[ok], hi[ok])
        name[left[ok]] = mix(x.name[best] + np.uint64(number))
        where[left[ok]] = x.start[best]
        left = left[~ok]
        if not len(left):
            break
    return name, where


def window_hashes(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    n = len(words)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * _power(_B, n), out=total[1:])
    return mix((total[at + window] - total[at]) * _power(_INVERSE, n)[at])


def _spans(key: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (text key, first word), in order, as spans of words: text key, first word, end."""
    if not len(at):
        return key[:0], at[:0], at[:0]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] > at[:-1] + window)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return key[head], at[head], at[tail] + window


def pack(keys: np.ndarray, words: Words, window: int, levels: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, record) of a flush, whose texts are told by rows of two longs: spans known to repeat (kind 0), and windows to be compared (kind 1)."""
    at = windows_of(words, window)
    if not len(at):
        return
    hashes = window_hashes(words, at, window)
    by = np.argsort(hashes, kind="stable")
    sorted_ = hashes[by]
    new = np.ones(len(by), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    again = ~new
    again[:-1] |= ~new[1:]
    known, sent = np.zeros(len(by), bool), np.zeros(len(by), bool)
    known[by] = again
    sent[by] = new
    text = np.searchsorted(words.first, at, "right") - 1
    if known.any():
        key, a, b = _spans(text[known], at[known], window)
        base = words.first[key]
        yield int(keys[key[0], 1]) % buckets, b"\0" + np.array([len(key)], "<i8").tobytes() + keys[key].tobytes() + (a - base).astype("<i4").tobytes() + (b - base).astype("<i4").tobytes()
    name, where = anchors(words, at, window, levels)
    # Neighbouring windows of one anchor make a record: one bit for each of its windows that is sent, and one for each that is known to repeat.
    head = np.ones(len(at), bool)
    head[1:] = (where[1:] != where[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(head)
    record = np.cumsum(head) - 1
    place = np.arange(len(at)) - heads[record]
    bit = np.uint64(1) << place.astype(np.uint64)
    mask = np.add.reduceat(np.where(sent, bit, np.uint64(0)), heads)
    flags = np.add.reduceat(np.where(sent & known, bit, np.uint64(0)), heads)
    bucket = (name[heads] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    order = order[mask[order] != 0]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    first_text = text[heads]
    sent_at = np.flatnonzero(sent)
    sent_record = record[sent_at]
    start = np.searchsorted(sent_record, np.arange(len(heads) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        own = order[edges[b] : edges[b + 1]]
        count = start[own + 1] - start[own]
        rows = sent_at[np.arange(int(count.sum())) + np.repeat(start[own] - (np.cumsum(count) - count), count)]
        h = heads[own]
        yield b, b"".join((
            b"\1", np.array([len(own)], "<i8").tobytes(), keys[first_text[own]].tobytes(), (at[h] - words.first[first_text[own]]).astype("<i4").tobytes(), name[h].astype("<u8").tobytes(),
            (where[h] - at[h]).astype(np.uint8).tobytes(), mask[own].tobytes(), flags[own].tobytes(), hashes[rows].astype("<u8").tobytes(),
        ))


def _unpack(blob: bytes) -> tuple:
    n = int(np.frombuffer(blob, "<i8", 1, 1)[0])
    at, out = 9, []
    for kind, each in (("<i8", 2), ("<i4", 1), ("<u8", 1), ("u1", 1), ("<u8", 1), ("<u8", 1)):
        out.append(np.frombuffer(blob, kind, n * each, at))
        at += n * each * np.dtype(kind).itemsize
    return (out[0].reshape(-1, 2), *out[1:], np.frombuffer(blob, "<u8", offset=at))


def repeated(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (text key, first word, end) of the windows of one bucket that repeat."""
    spans = []
    for x in (x for x in blobs if x[0] == 0):
        n = int(np.frombuffer(x, "<i8", 1, 1)[0])
        spans.append((np.frombuffer(x, "<i8", 2 * n, 9).reshape(-1, 2), *(np.frombuffer(x, "<i4", n, 9 + k * n).astype(np.int64) for k in (16, 20))))
    packed = [_unpack(x) for x in blobs if x[0] == 1]
    if packed:
        key, first, name, offset, mask, flags, raw = (np.concatenate(c) for c in zip(*packed, strict=True))
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        known = np.unpackbits(flags.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        record, place = np.nonzero(bits)
        offset, name = offset[record].astype(np.int64) - place, name[record]
        content = mix((raw + offset.astype(np.uint64)) ^ mix(name + _A))
        by = np.argsort(content)

        def alike() -> np.ndarray:
            return (raw[by][1:] == raw[by][:-1]) & (name[by][1:] == name[by][:-1]) & (offset[by][1:] == offset[by][:-1])

        equal = content[by][1:] == content[by][:-1]
        if (equal & ~alike()).any():  # different windows of one mixed key may stand between equal ones
            by = np.lexsort((offset, name, raw))
        equal = alike()
        again = known[record, place]
        again[by[1:][equal]] = True
        again[by[:-1][equal]] = True
        record, place = record[again], place[again]
        spans.append(_spans(record, first[record] + place, window))
        spans[-1] = (key[spans[-1][0]], *spans[-1][1:])
    if not spans:
        return np.zeros((0, 2), np.int64), *(np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*spans, strict=True))


def _packer(window: int, levels: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            got = list(pack(np.array(keys, np.int64).reshape(-1, 2), Words(texts, SPACED, False), window, levels, buckets))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "blob"])

        keys, texts, size = [], [], 0
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns[:2]), texts_of(batch.column(2)), strict=True):
                if texts and size + len(text) > FLUSH_BYTES:
                    yield flush()
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield flush()

    return run


def _finder(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            key, a, b = repeated(blobs, window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key[:, 0], key[:, 1], a, b)], ["own", "key", "a", "b"])

        bucket, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and blobs:
                    yield found()
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield found()

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, body, and own and key: the id and a hash of both, which tell rows apart also where ids repeat or are null. Rows equal in both share them, and what is removed."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.withColumn("own", F.coalesce("id", F.lit(-1).cast("long"))).withColumn("key", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("body", F.lit(""))))


def repeated_spans(rows: DataFrame, window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """rows: own, key, body. Returns (own, key, a, b): spans of words, which may overlap, that cover all windows that also start anywhere else.

    There are as many buckets as the texts' bytes ask for, and a task holds one at a time.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = min(1 << 30, max(4 * parts, -(-size // BUCKET_BYTES)))
    packed = rows.select("own", "key", "body").mapInArrow(tidy(_packer(window, levels, buckets)), "bucket int, blob binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_finder(window)), "own long, key long, a long, b long")


def _remover(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = texts_of(batch.column(1)), batch.column(2).to_pylist()
            n_words, removed, digests, kept = [], [], [], []
            for a, b in slices([len(t) for t in texts]):
                w = Words(texts[a:b], SPACED, False)
                for i in range(b - a):
                    x, y = int(w.first[i]), int(w.first[i + 1])
                    words = w.words(x, y)
                    cover = spans[a + i] or ()
                    if cover:
                        step = np.zeros(y - x + 1, np.int64)
                        np.add.at(step, [s["a"] for s in cover], 1)
                        np.add.at(step, [s["b"] for s in cover], -1)
                        keep = np.cumsum(step[:-1]) == 0
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    left = b" ".join(words)
                    n_words.append(y - x)
                    removed.append(y - x - len(words))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if with_text else None)
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_removed, kept_sha256 and, if asked, kept_text (kept words joined by one space).

    Words are separated by ASCII white space and compared as they are. Null and empty texts have no words. A repeated row repeats
    all its windows. Windows of up to 64 words are supported. Other columns of docs are ignored whatever their names.
    """
    if not 1 <= window <= 64:
        raise ValueError("window must be 1 to 64 words")
    work = _work.shared_dir(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    spans = _work.settle(repeated_spans(rows, window, levels), f"{work}/spans")
    covered = spans.groupBy("own", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # rows that share a key share their spans
    flagged = _sieve.flag(rows, F.col("key"), spans.select("key").distinct())
    cut = flagged.where("maybe").join(covered, ["own", "key"], "left").select("id", "body", "spans")
    whole = flagged.where("not maybe").select("id", "body", F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return whole.unionByName(cut).mapInArrow(tidy(_remover(with_text)), schema).withColumnRenamed("id", id_col)
