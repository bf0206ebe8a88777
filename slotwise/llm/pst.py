"""Language-model scoring with probabilistic suffix trees.

Tokens are words and one end for each text. The tree over tokens sees each as one of SYMBOLS symbols: the end is one of its own,
words are told by their last two bytes. Its contexts are the symbols of up to ORDER tokens before, within the text. A second
tree spells words that training never showed by their bytes and a closing space, with contexts of up to DEPTH bytes. In both a
context is kept if, and only if, its count times the divergence of its next-symbol distribution from that of the next shorter one
reaches a threshold, or if a longer one that ends in it is kept; however rare it is and however many there are. For tokens,
each occurrence is left out of the distribution that it is tested by, or contexts would seem to diverge by chance alone. Distributions
are smoothed by those of the shorter context, and scoring follows the longest suffix that is a state. Together, with counts over all training words:

    P(word | before) = (1 - share) * P(symbol | before) * count(word) / count(symbol) + share * spelled(word)
    P(end | before) = (1 - share) * P(end's symbol | before)

share is that of the words that occur once in training. The second tree learns from distinct words, each counted once.

There are at most SYMBOLS ** ORDER longest contexts of tokens, so the first tree, which every task gets, has 67 MB at most. Its
counts are summed and tested by the tasks that own a context's last two symbols, and only kept states reach the driver.
Word counts are kept for the whole corpus and never gathered in one place. Texts are dealt to blocks; each block asks, for its
distinct words, the task that owns a word's hash, which sums the counts of all blocks and answers each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _work
from ._tokens import SPACED, Words, mix, slices, texts_of, tidy

DEPTH = 4
#: A context is kept if its count times its divergence from the shorter one (in nats) reaches this.
DIVERGENCE = 20.0
#: Weight of the shorter context's distribution, in counts.
SMOOTH = 4.0
#: Symbols of tokens, a power of two; and the longest context of them.
SYMBOLS, ORDER = 64, 3
TOKEN_SMOOTH = 20.0
TOKEN_DIVERGENCE = 0.5
BLOCK_BYTES = 8 << 20
FLUSH_BYTES = 4 << 20
LONG_WORD = 48
SPACE = 0x20


def spelled(words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words with a space before and behind, one after the other, and the offset of each."""
    size = (words.end - words.start)[rows] + 2
    offset = np.cumsum(size) - size
    out = np.full(int(size.sum()), SPACE, np.uint8)
    inner = size - 2
    place = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat(offset + 1, inner) + place] = np.frombuffer(words.data, np.uint8)[np.repeat(words.start[rows], inner) + place]
    return out, offset


def grams(raw: np.ndarray, offset: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all contexts of 0 to depth bytes with the next byte, within words. A code has the context's length in its top byte, then the context and the next byte."""
    begin = np.zeros(len(raw), bool)
    begin[offset] = True
    since = np.arange(len(raw)) - np.maximum.accumulate(np.where(begin, np.arange(len(raw)), 0))  # bytes before it in its word
    codes, counts = [], []
    wide = raw.astype(np.uint64)
    value = wide.copy()
    for n in range(depth + 1):
        if n:
            value[n:] |= wide[:-n] << np.uint64(8 * n)
        own = np.flatnonzero(since >= max(n, 1))
        if not len(own):
            break
        u, c = np.unique(value[own], return_counts=True)
        codes.append(u | np.uint64(n) << np.uint64(56))
        counts.append(c)
    return (np.concatenate(codes), np.concatenate(counts)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Tree:
    """States with their next states and log10 probabilities by symbol. Symbol 0 stands for bytes that training never showed."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, divergence: float = DIVERGENCE):
        order = np.argsort(codes.astype(np.uint64))
        codes, counts = codes.astype(np.uint64)[order], np.asarray(counts, float)[order]
        length, context, byte = (codes >> np.uint64(56)).astype(int), (codes & np.uint64(0xFFFFFFFFFFFFFF)) >> np.uint64(8), (codes & np.uint64(255)).astype(int)
        used = np.unique(byte[length == 0])
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        other = max(1, 256 - len(used))
        heads = np.flatnonzero(np.diff(codes >> np.uint64(8), prepend=np.uint64(1 << 56))) if len(codes) else np.zeros(0, int)
        ends = np.append(heads, len(codes))[1:]
        gain = self._gains(codes, counts, length, heads, ends)
        # A state's prefixes and suffixes are states too: each is reached from its prefix, and falls back to its suffix.
        states = {(0, 0), (1, SPACE)}
        for i in heads[gain >= divergence].tolist():
            n = int(length[i])
            whole = int(context[i]).to_bytes(n, "big")
            states.update((j - i, int.from_bytes(whole[i:j], "big")) for i in range(n) for j in range(i + 1, n + 1))
        listed = sorted(states)
        found: dict[tuple[int, int], np.ndarray] = {}
        for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
            key = int(length[a]), int(context[a])
            if key in states:
                own = np.zeros(width)
                own[self.symbol[byte[a:b]]] = counts[a:b]
                found[key] = own
        uniform = np.full(width, 1 / 256)
        uniform[0] = other / 256
        smooth: dict[tuple[int, int], np.ndarray] = {}

        def distribution(key: tuple[int, int]) -> np.ndarray:
            got = smooth.get(key)
            if got is None:
                n, c = key
                below = uniform if n == 0 else distribution((n - 1, c & ((1 << 8 * (n - 1)) - 1)))
                own = found.get(key)
                got = smooth[key] = below if own is None else (own + SMOOTH * below) / (own.sum() + SMOOTH)
            return got

        number = {k: i for i, k in enumerate(listed)}
        self.next = np.zeros((len(listed), width), np.int32)
        self.log = np.empty((len(listed), width))
        back = [0] * width
        for b, s in enumerate(self.symbol):
            if s:
                back[s] = b
        for i, (n, c) in enumerate(listed):
            p = distribution((n, c)).copy()
            p[0] /= other
            self.log[i] = np.log10(p)
            if n:
                self.next[i] = self.next[number[n - 1, c & ((1 << 8 * (n - 1)) - 1)]]
            if n < depth:
                for s in range(1, width):
                    to = number.get((n + 1, c << 8 | back[s]))
                    if to is not None:
                        self.next[i, s] = to
        self.start = number[1, SPACE]

    @staticmethod
    def _gains(codes: np.ndarray, counts: np.ndarray, length: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each context's count times its divergence from the next shorter one; 0 for the empty one. From sorted codes, without a table of contexts by bytes."""
        each = np.repeat(np.arange(len(heads)), ends - heads)
        total = np.bincount(each, counts, len(heads))[each]
        below, p = np.full(len(codes), 1 / 256), np.zeros(len(codes))
        for n in range(int(length.max()) + 1 if len(codes) else 0):
            own = np.flatnonzero(length == n)
            if n:
                shorter = codes[own] & np.uint64((1 << 8 * n) - 1) | np.uint64(n - 1) << np.uint64(56)
                below[own] = p[np.searchsorted(codes, shorter)]  # what follows a context follows its suffix
            p[own] = (counts[own] + SMOOTH * below[own]) / (total[own] + SMOOTH)
        return np.where(length[heads] > 0, np.bincount(each, counts * np.log(counts / total / below), len(heads)), 0.0)

    def log10(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """log10 probability of the spelling of the given words."""
        raw = np.frombuffer(words.data, np.uint8)
        size = (words.end - words.start)[rows]
        out = np.zeros(len(rows))
        by = np.argsort(-size, kind="stable")
        begin, left = words.start[rows][by], size[by]
        state, total = np.full(len(rows), self.start), np.zeros(len(rows))
        long = int(np.searchsorted(-left, -LONG_WORD))  # the first words are the longest
        for i in range(long):
            s, t = self.start, 0.0
            for x in self.symbol[raw[begin[i] : begin[i] + left[i]]].tolist():
                t += self.log[s, x]
                s = self.next[s, x]
            total[i], state[i] = t, s
        for j in range(int(left[long]) if long < len(rows) else 0):
            n = int(np.searchsorted(-left, -j))  # words of more than j bytes
            s = self.symbol[raw[begin[long:n] + j]]
            total[long:n] += self.log[state[long:n], s]
            state[long:n] = self.next[state[long:n], s]
        total += self.log[state, self.symbol[SPACE]]
        out[by] = total
        return out


END = SYMBOLS - 1


def symbols_of(words: Words) -> np.ndarray:
    """A word's symbol: a hash of its last two bytes."""
    raw = np.frombuffer(words.data, np.uint8)
    more = words.end - words.start > 1
    last = raw[words.end - 1].astype(np.uint64) | np.where(more, raw[np.maximum(words.end - 2, 0)], 0).astype(np.uint64) << np.uint64(8)
    return (mix(last + np.uint64(1 << 40)) % np.uint64(END)).astype(np.int64)


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all tokens, ends too; the context before each, nearest symbol first (ends stand before a text); and each word's place among the tokens."""
    texts = len(words.first) - 1
    place = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(words.first))
    out = np.full(len(words) + texts, END)
    out[place] = symbols_of(words)
    within = np.arange(len(out)) - np.repeat(words.first[:-1] + np.arange(texts), np.diff(words.first) + 1)
    context = np.zeros(len(out), np.int64)
    for j in range(1, ORDER + 1):
        before = np.concatenate((np.full(j, END), out[:-j]))[: len(out)]
        context = context * SYMBOLS + np.where(within < j, END, before)
    return out, context, place


def _kept(own: np.ndarray, below: np.ndarray, divergence: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed distributions of contexts (rows of counts) over those of the shorter contexts, and which diverge from them."""
    n = own.sum(-1, keepdims=True)
    others = (np.maximum(own - 1, 0) + smooth * below) / (np.maximum(n - 1, 0) + smooth)
    return (own + smooth * below) / (n + smooth), (own * np.log(others / below)).sum(-1) >= np.where(n[..., 0] > 0, divergence, np.inf)


class Tokens:
    """The tree over tokens: log10 distributions of its states, and for each longest context the state it falls to.

    first: counts of (symbol before, symbol). states: kept longer contexts as (length, code, log10 distribution)."""

    def __init__(self, first: np.ndarray, states: list[tuple[int, int, np.ndarray]], divergence: float = TOKEN_DIVERGENCE, smooth: float = TOKEN_SMOOTH):
        self.count = first.sum(0).astype(float)
        self.root, self.one, keep = self.below(first, divergence, smooth)
        keep[[c >> (n - 1) * self.bits for n, c, _ in states]] = True
        self.log = np.log10(np.concatenate([self.root[None], self.one])).astype(np.float32)
        if states:
            self.log = np.concatenate([self.log, np.stack([x for *_, x in states])])
        self.kept = int(keep.sum()) + len(states)
        at = np.where(keep, np.arange(1, SYMBOLS + 1), 0).astype(np.int32)
        for n in range(2, ORDER + 1):
            at = np.repeat(at, SYMBOLS)
            for i, (m, c, _) in enumerate(states):
                if m == n:
                    at[c] = SYMBOLS + 1 + i
        self.at = at

    bits = SYMBOLS.bit_length() - 1

    @staticmethod
    def below(first: np.ndarray, divergence: float, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        root = (first.sum(0) + 0.5) / (first.sum() + 0.5 * SYMBOLS)
        return root, *_kept(first.astype(float), root, divergence, smooth)

    def log10(self, context: np.ndarray, to: np.ndarray) -> np.ndarray:
        return self.log[self.at[context], to]


def _states(one: np.ndarray, divergence: float, smooth: float):
    """From the counts of all contexts whose last two symbols are grp: those that are kept, of two and of three symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, code, logs = [], [], []
            for grp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = _entry(blob, ("<u2", "<i8"))
                three = np.zeros((SYMBOLS, SYMBOLS))
                three.ravel()[at] = n
                two, keep2 = _kept(three.sum(0), one[grp // SYMBOLS], divergence, smooth)
                full, keep3 = _kept(three, two, divergence, smooth)
                if keep2 or keep3.any():
                    length.append(2)
                    code.append(grp)
                    logs.append(np.log10(two).astype("<f4").tobytes())
                for i in np.flatnonzero(keep3).tolist():
                    length.append(3)
                    code.append(grp * SYMBOLS + i)
                    logs.append(np.log10(full[i]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(code, pa.int64()), pa.array(logs, pa.binary())], ["length", "code", "logs"])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the contexts of one symbol, as far as they are in a context group."""
    total = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for batch in batches:
        for grp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, n = _entry(blob, ("<u2", "<i8"))
            total[grp // SYMBOLS] += np.bincount(at % SYMBOLS, n, SYMBOLS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["cell", "n"])


TEXTS, TOKENS, WORD = -1, -2, -3


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of training texts, rows (code, n, blob): by code the number of texts, that of tokens, and words (blob) with their counts in a
    flush; at the end of a task, for each two symbols, all contexts that end in them with their counts (blob)."""
    cells = np.zeros(SYMBOLS ** (ORDER + 1), np.uint32)

    def rows(code, n, blob) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["code", "n", "blob"])

    def flush() -> pa.RecordBatch:
        w = Words(texts, SPACED)
        to, context, _ = sequence(w)
        code, n = np.unique(context * SYMBOLS + to, return_counts=True)
        cells[code] += n.astype(np.uint32)
        u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
        data = w.data
        found = [data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
        return rows([TEXTS, TOKENS] + [WORD] * len(u), [len(texts), len(w) + len(texts), *n.tolist()], [None, None, *found])

    texts, size = [], 0
    for batch in batches:
        for t in texts_of(batch.column(0)):
            if texts and size + len(t) > FLUSH_BYTES:
                yield flush()
                texts, size = [], 0
            texts.append(t)
            size += len(t)
    if texts:
        yield flush()
    wide = SYMBOLS * SYMBOLS
    at = np.flatnonzero(cells)
    groups, begin = np.unique(at // wide, return_index=True)
    stop = np.append(begin, len(at))[1:]
    for some in np.array_split(np.arange(len(groups)), max(1, len(groups) // 256)):
        blobs = [_pack((at[a:b] % wide).astype("<u2"), cells[at[a:b]].astype("<i8")) for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True)]
        yield rows(groups[some], [0] * len(some), blobs)


def _spell(depth: int):
    """Distinct words to spelling counts (code, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(0).to_pylist(), SPACED)
            if len(w):
                code, n = grams(*spelled(w, np.arange(len(w))), depth)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])

    return run


def _sum_cells(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            i, n = _entry(blob, ("<u2", "<i8"))
            total[i] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([_pack(at.astype("<u2"), total[at])], pa.binary())], ["grp", "blob"])


def fit(rows: DataFrame, work: str, depth: int = DEPTH, divergence: float = DIVERGENCE, token_divergence: float = TOKEN_DIVERGENCE) -> tuple[Tree, Tokens, int, int, float]:
    """From training texts (one column): the tree that spells, the one over tokens, N, the number of texts, and the share of spelled words."""
    tallied = _work.settle(rows.mapInArrow(tidy(_tally), "code long, n long, blob binary"), f"{work}/tally")
    words = _work.settle(tallied.where(F.col("code") == WORD).groupBy("blob").agg(F.sum("n").alias("n")), f"{work}/words")
    extra = dict(map(tuple, tallied.where(F.col("code").isin(TEXTS, TOKENS)).groupBy("code").agg(F.sum("n")).collect()))
    tokens, ends = int(extra.get(TOKENS, 0)), int(extra.get(TEXTS, 0))
    once = words.where("n = 1").count()
    own = words.select("blob").mapInArrow(tidy(_spell(depth)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # a row for each context of up to `depth` bytes within words and the byte behind it
    tree = Tree(own["code"].to_numpy().view(np.uint64), own["n"].to_numpy(), depth, divergence)
    cells = tallied.where("code >= 0").select(F.col("code").alias("grp"), "blob").groupBy("grp").applyInArrow(_sum_cells, "grp long, blob binary")
    cells = _work.settle(cells, f"{work}/cells")
    first = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in cells.mapInArrow(_firsts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # SYMBOLS ** 2 rows at most
        first[r.cell] = r.n
    first = first.reshape(SYMBOLS, SYMBOLS)
    one = Tokens.below(first, token_divergence, TOKEN_SMOOTH)[1]
    got = cells.mapInArrow(_states(one, token_divergence, TOKEN_SMOOTH), "length int, code long, logs binary").toArrow()  # SYMBOLS ** ORDER states of 268 bytes at most, and a few shorter
    order = np.lexsort((got["code"].to_numpy(), got["length"].to_numpy()))
    states = [(got["length"][i].as_py(), got["code"][i].as_py(), np.frombuffer(got["logs"][i].as_py(), "<f4")) for i in order.tolist()]
    share = min(0.5, max(1e-3, once / max(1, tokens)))
    for name in ("tally", "words", "cells"):
        _work.drop(rows.sparkSession, f"{work}/{name}")
    return tree, Tokens(first, states, token_divergence), tokens, ends, share


def _entry(blob: bytes, kinds: tuple) -> tuple:
    n, at, own = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
    for k in kinds:
        own.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return tuple(own)


def _entries(table: pa.Table, column: str, kinds: tuple) -> list[tuple]:
    return [_entry(blob, kinds) for blob in table.column(column).to_pylist()]


def _pack(*columns: np.ndarray) -> bytes:
    return np.array([len(columns[0])], "<i8").tobytes() + b"".join(c.tobytes() for c in columns)


def _asker(buckets: int):
    """A block's distinct words, by the bucket of their hash: hash and count in the block's training texts."""

    def run(table: pa.Table) -> pa.Table:
        texts, train = texts_of(table.column("body")), np.array(table.column("train").to_pylist(), bool)
        block = table.column("block")[0].as_py()
        hashes, counts = [], []
        for a, b in slices([len(t) for t in texts], 2 << 20):
            w = Words(texts[a:b], SPACED)
            u, inverse = np.unique(w.hash, return_inverse=True)
            hashes.append(u)
            counts.append(np.bincount(inverse, np.repeat(train[a:b], np.diff(w.first)), len(u)))
        u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(u)).astype("<u4")
        own = (u % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(edges)).tolist()
        blobs = [_pack(u[order[edges[i] : edges[i + 1]]], c[order[edges[i] : edges[i + 1]]]) for i in there]
        return pa.table({"bucket": pa.array(there, pa.int32()), "block": pa.array([block] * len(there), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _answerer(blocks: int):
    """For each block its words' counts in all training texts; and, as a block of its own, how many words were ever counted."""

    def run(table: pa.Table) -> pa.Table:
        asked = _entries(table, "blob", ("<u8", "<u4"))
        u, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(u)).astype("<i8")
        at, blobs = 0, []
        for h, _ in asked:
            blobs.append(_pack(h, total[inverse[at : at + len(h)]]))
            at += len(h)
        blobs.append(_pack(np.array([np.count_nonzero(total)], "<u8"), np.array([total.sum()], "<i8")))
        to = [*table.column("block").to_pylist(), blocks + table.column("bucket")[0].as_py()]
        return pa.table({"block": pa.array(to, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


OUT = "id long, train boolean, n_tokens long, n_known long, base double, score double, types long, tokens long"


def _scorer(shipped):
    def run(texts_table: pa.Table, answers: pa.Table) -> pa.Table:
        tree, before, tokens, ends, share = shipped.value
        got = _entries(answers, "blob", ("<u8", "<i8"))
        if not texts_table.num_rows:  # what a bucket counted
            return _result([None], [None], *([[None]] * 4), [int(sum(g[0].sum() for g in got))], [int(sum(g[1].sum() for g in got))])
        known_hash = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
        known = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        by = np.argsort(known_hash)
        known_hash, known = known_hash[by], known[by]
        texts = texts_of(texts_table.column("body"))
        out: list[list] = [[], [], [], []]
        for a, b in slices([len(t) for t in texts], 2 << 20):
            w = Words(texts[a:b], SPACED)
            u, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            c = known[np.searchsorted(known_hash, u)] if len(u) else np.zeros(0, np.int64)
            log = tree.log10(w, first) if len(u) else np.zeros(0)
            to, context, place = sequence(w)
            p = (1 - share) * 10.0 ** before.log10(context, to).astype(float) if tokens else np.full(len(to), 0.5)
            own = to[place]
            spell = share * 10.0 ** np.maximum(log, -300)
            rate = (c[inverse] / np.maximum(before.count[own], 1.0)) if tokens else np.zeros(len(own))
            with np.errstate(divide="ignore"):
                token = np.log10(p)
                seen = np.log10(p[place] * rate + spell[inverse])
            token[place] = np.where(c[inverse] > 0, seen, np.log10(share if tokens else 0.5) + log[inverse])
            edge = w.first + np.arange(len(w.first))  # first tokens of texts
            total = np.concatenate(([0.0], np.cumsum(token)))
            sums = [np.concatenate(([0.0], np.cumsum(x[inverse]))) for x in (np.log10(c + 0.1), (c > 0).astype(float))]
            base, n_known = (s[w.first[1:]] - s[w.first[:-1]] for s in sums)
            out[0] += (np.diff(w.first) + 1).tolist()
            out[1] += (n_known.astype(int) + (ends > 0)).tolist()
            out[2] += (base + np.log10(ends + 0.1)).tolist()
            out[3] += (total[edge[1:]] - total[edge[:-1]]).tolist()
        return _result(texts_table.column("id"), texts_table.column("train"), *out, [None] * len(texts), [None] * len(texts))

    return run


def _result(*columns) -> pa.Table:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.table([c.cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def score(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """One row for each row of docs: id_col, train, n_tokens, n_known, train_tokens, base_score, score.

    usable: a Column over id_col; rows where it holds are training texts (a null id is judged by it as well). base_score is the
    smoothed unigram sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))); score is the model's log10 probability. Null texts
    count as empty, one end token. Repeated rows each count. Without training texts, words are spelled with uniform bytes.
    Other columns of docs are ignored whatever their names.
    """
    spark = docs.sparkSession
    work = _work.shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body")).withColumn("train", F.coalesce(usable, F.lit(False)))
    rows = rows.select(F.col(id_col).alias("id"), "body", "train")
    tree, before, tokens, ends, share = fit(rows.where("train").select("body"), work, **options)
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks, buckets = max(parts, -(-size // block_bytes)), 2 * parts
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "body"), F.lit(blocks)).cast("long")).repartition(int(min(blocks, 1 << 20)), "block")
    asked = dealt.groupBy("block").applyInArrow(_asker(buckets), "bucket int, block long, blob binary")
    answers = asked.groupBy("bucket").applyInArrow(_answerer(blocks), "block long, blob binary")
    shipped = spark.sparkContext.broadcast((tree, before, tokens, ends, share))
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(shipped), OUT)
    scored = _work.settle(scored, f"{work}/scored")
    counted = scored.where("types is not null").agg(F.sum("types"), F.sum("tokens")).first()
    if int(counted[1] or 0) + ends != tokens:
        raise RuntimeError("the training texts changed between two reads")
    types = int(counted[0] or 0) + (ends > 0)
    whole = float(np.log10(tokens + 0.1 * (types + 1)))
    return scored.where("types is null").select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score"
    )
