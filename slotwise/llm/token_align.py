"""Alignment of two tokenizers over the same bytes.

Each byte of a text gets a label: no token ends there, one of A does, one of B, or both. A regular expression scans the labels and
extracts the spans up to each `both`; the labels within a span say how many tokens of A and of B form the group. A text is taken
apart first at single spaces between other characters: no token of either tokenizer reaches over such a place, so the parts' groups
are the text's, and a part that has been seen before is not scanned again.

Every document's distinct pairs of linked ids go to a table, their numbers of documents are counted from it, and the counts come back in two ways:
those of the commonest pairs, at most MOST_COMMON, go to every task, so no pair that very many documents hold is shuffled;
those of all others meet the documents in a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _work
from ._tokens import tidy

#: Pairs whose counts go to every task: 13 bytes each, 14 MB at most.
MOST_COMMON = 1 << 20
#: Parts that a worker remembers, and the number of tokens from which it does not.
REMEMBERED, LONG_PART = 300_000, 64
#: Parts that are encoded at once, parts that are scanned at a time, and texts whose parts are looked up together.
CHUNK, SLICE_PARTS, TEXTS = 400, 20_000, 250
#: Links of one group beyond which they are counted by distinct ids.
LARGE_GROUP = 4096
POWERS = 10 ** np.arange(8)
#: Pairs that a task gathers before it counts them.
GATHERED = 1 << 20
#: A pair of ids in one number.
ID_BITS = 24

#: Labels of bytes: no token ends, one of A, one of B, both.
LABELS = np.frombuffer(b".ab|", np.uint8)
SPAN = re.compile(rb"[^|]*\|")
#: How a byte-level tokenizer takes texts apart (fixed value of the public vocabulary).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of classes that are the same in all versions of Unicode that the engines know.
QUICK = re.compile("[\0-\u024F]*")
#: Places where a text may be taken apart.
APART = re.compile(r"(?<=\S) (?=\S)")


def byte_level(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for U+0100 and up, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in set(own))}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


class _Tokenizers:
    """Both tokenizers and the tokens of the parts seen: a part's row, and for each row its stretches of A's and B's ids."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab(with_added_tokens=True)
        a_bytes = byte_level(vocab)
        self.quick = self._quick_encoder(json.loads(self.a.to_str()), vocab, a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = (a_bytes, b_bytes)
        self.len = tuple(np.array([len(x) for x in t], np.int64) for t in self.bytes)
        self.forget()

    def _quick_encoder(self, spec: dict, vocab: dict[str, int], a_bytes: list[bytes]) -> Callable[[str], list[int]] | None:
        """A quicker encoder of the same vocabulary; only where merges and ids stand in one order, and for QUICK characters, whose classes no engine has changed."""
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        first = len(vocab) - len(merges) - len(spec["added_tokens"])
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or [vocab.get(m) for m in merges] != list(range(first, first + len(merges))):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={a_bytes[i]: i for i in range(first + len(merges))}, special_tokens={}).encode_ordinary

    def forget(self) -> None:
        """Drop what the last texts did not use, or all if that is too little."""
        keep = np.zeros(0, np.int64)
        if getattr(self, "row_of", None):
            keep = np.flatnonzero(self.used & (self.n[0] + self.n[1] < LONG_PART))
            keep = keep if len(keep) < REMEMBERED // 2 else keep[:0]
        if len(keep):
            new = np.full(len(self.used), -1, np.int64)
            new[keep] = np.arange(len(keep))
            at = new.tolist()
            self.row_of = {p: at[r] for p, r in self.row_of.items() if at[r] >= 0}
            self.ids = [self._gather(i, keep) for i in (0, 1)]
            self.n, self.whole = [n[keep] for n in self.n], self.whole[keep]
        else:
            self.row_of: dict[str, int] = {}
            self.ids, self.n, self.whole = [np.zeros(0, np.int32)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros(0, bool)
        self.start = [np.cumsum(n) - n for n in self.n]
        self.used = np.zeros(len(self.whole), bool)

    def _gather(self, i: int, rows: np.ndarray) -> np.ndarray:
        n = self.n[i][rows]
        return self.ids[i][np.repeat(self.start[i][rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def learn(self, parts: list[str]) -> None:
        """Remember the tokens of parts; many are encoded at once, with a space between them, and told apart by their lengths in bytes."""
        parts.sort(key=lambda p: QUICK.fullmatch(p) is None)  # quick ones first
        n_quick = sum(QUICK.fullmatch(p) is not None for p in parts) if self.quick else 0
        chunks = [" ".join(parts[i:to]) for lo, hi in ((0, n_quick), (n_quick, len(parts))) for i in range(lo, hi, CHUNK) for to in (min(hi, i + CHUNK),)]
        n_chunks = -(-n_quick // CHUNK)
        a = [self.quick(" " + c) for c in chunks[:n_chunks]] + [x.ids for x in self.a.encode_batch_fast([" " + c for c in chunks[n_chunks:]], add_special_tokens=False)]
        text = "".join([" " + c for c in chunks]).encode()
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts)))
        flat = [np.fromiter(chain.from_iterable(x), np.int32) for x in (a, self.b.encode(chunks, num_threads=1))]
        cuts, plain = [], True
        for i in (0, 1):
            reach = np.cumsum(self.len[i][flat[i]])
            cut = np.searchsorted(reach, ends)
            plain = plain and len(reach) and cut[-1] < len(reach) and np.array_equal(reach[cut], ends) and b"".join([self.bytes[i][x] for x in flat[i].tolist()]) == text
            cuts.append(np.diff(cut + 1, prepend=0))
        whole = np.ones(len(parts), bool)
        if not plain:  # some part's tokens have other bytes: one by one
            ids = [[x.ids for x in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)], self.b.encode(parts, num_threads=1)]
            whole = np.array([all(b"".join([t[x] for x in y]) == (" " + p).encode() for t, y in zip(self.bytes, pair, strict=True)) for p, pair in zip(parts, zip(*ids, strict=True), strict=True)])
            flat, cuts = [np.fromiter(chain.from_iterable(x), np.int32) for x in ids], [np.fromiter(map(len, x), np.int64) for x in ids]
        self.row_of |= dict(zip(parts, range(len(self.whole), len(self.whole) + len(parts)), strict=True))
        self.ids, self.n = [np.concatenate(x) for x in zip(self.ids, flat, strict=True)], [np.concatenate(x) for x in zip(self.n, cuts, strict=True)]
        self.whole = np.concatenate([self.whole, whole])
        self.start = [np.cumsum(n) - n for n in self.n]
        self.used = np.concatenate([self.used, np.zeros(len(parts), bool)])

    def align(self, texts: list[str]) -> list[tuple]:
        """For each text (tokens of A, of B, groups, links, the groups' digest, distinct pairs, their numbers of links)."""
        apart = [APART.split(t) if t else [] for t in texts]
        if len(self.whole) > REMEMBERED or len(self.ids[0]) + len(self.ids[1]) > 16 * REMEMBERED:
            self.forget()
        if new := list(set(chain.from_iterable(apart)) - self.row_of.keys()):
            self.learn(new)
        results = [_Result() for _ in texts]
        held, size = [], 0
        for result, parts in zip(results, apart, strict=True):
            rows = np.fromiter(map(self.row_of.__getitem__, parts), np.int64, len(parts))
            self.used[rows] = True
            if not self.whole[rows].all():
                continue
            for start in range(0, len(parts), SLICE_PARTS):
                held.append((result, rows[start : start + SLICE_PARTS]))
                size += len(held[-1][1])
                if size >= SLICE_PARTS:
                    self.scan(held)
                    held, size = [], 0
        if held:
            self.scan(held)
        return [r.row() for r in results]

    def scan(self, held: list[tuple]) -> None:
        """Add stretches of texts, each (result, rows of its parts), to their results."""
        rows, first = np.concatenate([x[1] for x in held]), np.cumsum([0] + [len(x[1]) for x in held[:-1]])
        n_a, n_b = (np.add.reduceat(self.n[i][rows], first) for i in (0, 1))
        a, b = (self._gather(i, rows).astype(np.int64) for i in (0, 1))
        a_at, b_at = np.cumsum(self.len[0][a]) - 1, np.cumsum(self.len[1][b]) - 1
        ends = np.zeros(a_at[-1] + 1, np.uint8)
        ends[a_at] = 1
        ends[b_at] += 2
        labels = LABELS[ends].tobytes()
        at = np.cumsum(np.fromiter(map(len, SPAN.findall(labels)), np.int64)) - 1  # the last byte of each group
        a_to, b_to = np.cumsum(ends & 1, dtype=np.int64)[at], np.cumsum(ends >> 1, dtype=np.int64)[at]
        n, m = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        owner = np.searchsorted(np.cumsum(n_a), a_to)  # the stretch of each group
        groups, links = np.bincount(owner, minlength=len(held)), np.bincount(owner, n * m, len(held)).astype(np.int64)

        # The groups' text: A's ids, then B's, each with the sign that follows it.
        size, start = n + m, np.cumsum(n + m) - n - m
        ids = np.empty(len(a) + len(b), np.int64)
        ids[np.arange(len(a)) + np.repeat(start - a_to + n, n)] = a
        ids[np.arange(len(b)) + np.repeat(start + n - b_to + m, m)] = b
        signs = np.full(len(ids), ord(","), np.uint8)
        signs[start + n - 1], signs[start + size - 1] = ord("|"), ord(";")
        digits = np.searchsorted(POWERS, ids, "right")
        digits[digits == 0] = 1
        to = np.cumsum(digits + 1)
        text = np.empty(to[-1], np.uint8)
        text[to - 1] = signs
        for k in range(int(digits.max())):
            more = digits > k
            text[to[more] - 2 - k] = ids[more] // 10**k % 10 + 48
        text = text.tobytes()
        text_to = to[np.cumsum(n_a + n_b) - 1].tolist()

        large = n * m > LARGE_GROUP
        few = np.where(large, 0, n * m)
        g = np.repeat(np.arange(len(n)), few)
        within = np.arange(len(g)) - np.repeat(np.cumsum(few) - few, few)
        pairs = (owner[g] << 2 * ID_BITS) + (a[(a_to - n)[g] + within // m[g]] << ID_BITS) + b[(b_to - m)[g] + within % m[g]]
        pairs, times = np.unique(pairs, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(held) + 1) << 2 * ID_BITS).tolist()
        for i, (result, _) in enumerate(held):
            part = slice(cuts[i], cuts[i + 1])
            result.add(int(n_a[i]), int(n_b[i]), int(groups[i]), int(links[i]), text[text_to[i - 1] if i else 0 : text_to[i] - 1], pairs[part] & (1 << 2 * ID_BITS) - 1, times[part])
        for i in np.flatnonzero(large):  # distinct ids with distinct ids: no list of all links
            x, x_n = np.unique(a[a_to[i] - n[i] : a_to[i]], return_counts=True)
            y, y_n = np.unique(b[b_to[i] - m[i] : b_to[i]], return_counts=True)
            held[owner[i]][0].pairs.append((np.add.outer(x << ID_BITS, y).ravel(), np.multiply.outer(x_n, y_n).ravel()))


class _Result:
    def __init__(self) -> None:
        self.n_a = self.n_b = self.groups = self.links = 0
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, n_a: int, n_b: int, groups: int, links: int, text: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.digest.update(b";" + text if self.groups else text)
        self.n_a, self.n_b, self.groups, self.links = self.n_a + n_a, self.n_b + n_b, self.groups + groups, self.links + links
        self.pairs.append((pairs, times))

    def row(self) -> tuple:
        if not self.groups:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = self.pairs[0]
        if len(self.pairs) > 1:
            pairs, inverse = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, inverse, np.concatenate([t for _, t in self.pairs]))
        return self.n_a, self.n_b, self.groups, self.links, self.digest.hexdigest(), pairs, times


@lru_cache(1)
def _tokenizers(a_file: str, b_file: str) -> _Tokenizers:
    return _Tokenizers(a_file, b_file)


_DOC = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _aligner(a_file: str, b_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_file, b_file)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [x for i in range(0, len(texts), TEXTS) for x in both.align([t or "" for t in texts[i : i + TEXTS]])]
            cols = list(zip(*found, strict=True)) or [()] * 7
            rows = [range(row, row + len(ids)), ids, *cols[:5], [p.tobytes() for p in cols[5]], [t.tobytes() for t in cols[6]]]
            row += len(ids)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in _DOC.split(", ")])

    return run


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times")), strict=True):
        keys = np.frombuffer(pairs, np.int64)
        if len(keys):
            yield row, keys, np.frombuffer(times, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, n): in how many of the task's documents a pair is linked."""
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        for _, keys, _ in _pairs_of(batch):
            held.append(keys)
            size += len(keys)
            if size >= GATHERED:
                yield summed()
                size = 0
    if held:
        yield summed()


def _scorer(common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, n_best, count_sum) over the commonest pairs for each document, and rows (row, pair, times) of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = common.value
        for batch in batches:
            sums, rest = [], []
            for row, keys, times in _pairs_of(batch):
                at = np.searchsorted(known, keys)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == keys[hit]
                sums.append((row, int(times[hit][best[at[hit]]].sum()), int((times[hit] * n[at[hit]]).sum())))
                if not hit.all():
                    rest.append((np.full((~hit).sum(), row), keys[~hit], times[~hit]))
            row, n_best, count_sum = zip(*sums, strict=True) if sums else ((), (), ())
            more = [np.concatenate(c) for c in zip(*rest, strict=True)] if rest else [np.zeros(0, np.int64)] * 3
            none = pa.nulls(len(more[0]), pa.int64())
            cols = [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in ((row, pa.array(more[0])), (n_best, none), (count_sum, none), ([None] * len(row), pa.array(more[1])), ([None] * len(row), pa.array(more[2])))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "n_best", "count_sum", "pair", "times"])

    return run


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON) -> DataFrame:
    """One row for each row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A takes a space and the text, B the text, to which it adds the space; neither knows special tokens. Tokens of A (a byte-level BPE for `tokenizers`) and of B (a `sentencepiece` model with
    byte fallback) between two bytes at which both end form a group, and all pairs of a group's tokens are links. A pair of ids counts the rows that link it; n_best are the links whose
    pair has the highest count of its A id, count_sum the counts of all links. Texts that are null, empty, or not what the tokens' bytes give, have no tokens: zeros and ''. Rows that repeat an
    id stay apart and count each. Ids may be null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    work = _work.shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    found = _work.settle(rows.mapInArrow(tidy(_aligner(a_file, b_file)), _DOC), f"{work}/documents", compression="zstd")
    lists = found.select("row", "pairs", "times")
    counts = lists.mapInArrow(tidy(_count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS))
    counts = _work.settle(counts, f"{work}/counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    counts = _work.settle(counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), f"{work}/best")

    # The least power of two from which on no more than most_common pairs have so many documents.
    steps = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    least, held = max(steps, default=-1) + 1, 0
    while least > 0 and held + steps.get(least - 1, 0) <= most_common:
        least -= 1
        held += steps.get(least, 0)
    at_hand = F.col("n") >= (1 << least)
    table = counts.where(at_hand).orderBy("pair").toArrow()
    common = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    scored = lists.mapInArrow(tidy(_scorer(common)), "row long, n_best long, count_sum long, pair long, times long")
    scored = _work.settle(scored, f"{work}/scored", compression="zstd")
    met = scored.where("pair is not null").select("row", "pair", "times").join(counts.where(~at_hand), "pair")
    met = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = scored.where("pair is null").select("row", "n_best", "count_sum").unionByName(met).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = found.drop("pairs", "times").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
