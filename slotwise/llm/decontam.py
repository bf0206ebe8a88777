"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z. The automaton takes the words of
a document one by one and knows at each the longest suffix that occurs in some item. Items come in groups of at most
`max_item_words` words, each with an automaton of its own, so that what is broadcast has a fixed bound. Groups follow each other:
what one has marked is written to the shared folder before the next is read, so neither the driver nor a task ever holds two automata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _work
from ._tokens import ALNUM, Words, slices, texts_of, tidy

WINDOW = 13
#: Words of items in one automaton: about 300 bytes each in a worker.
MAX_ITEM_WORDS = 1_000_000


class Automaton:
    """A suffix automaton over the word sequences of items, with the items that hold each state's shortest window.

    `run(words)` yields for each position the state and the longest matching length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.items = sorted({i for i, words in items if words})
        number = {x: k for k, x in enumerate(self.items)}
        whole: dict[tuple[bytes, ...], list[int]] = {}
        for item, words in items:
            if words:
                whole.setdefault(tuple(words), []).append(number[item])
        for words in whole:
            self._add(words)
        holders: list[set[int]] = [set() for _ in self.next]
        ends: dict[int, list[tuple[int, list[int]]]] = {}
        for words, ids in whole.items():
            state = 0
            for w in words:
                state = self.next[state][w]
                for i in ids:
                    up = state
                    while up > 0 and i not in holders[up]:
                        holders[up].add(i)
                        up = self.link[up]
            if len(words) < window:
                ends.setdefault(state, []).append((len(words), ids))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        #: For each state, the items that a match of at least a window shows, and the short items that it may end.
        self.at_window: list[tuple[int, ...]] = [()] * len(order)
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(order)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = self.at_window[up] if self.length[up] >= window else tuple(sorted(holders[s]))
            self.short[s] = self.short[up] + tuple((n, tuple(ids)) for n, ids in ends.get(s, ()))
        self.least = min([window, *(len(w) for w in whole)])
        vocabulary = sorted({w for words in whole for w in words})
        self.code = {w: i for i, w in enumerate(vocabulary)}
        hashes = Words(vocabulary, ALNUM).hash if vocabulary else np.zeros(0, np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.codes = hashes[by], by
        pairs = {self.code[a] * len(vocabulary) + self.code[b] for words in whole for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _add(self, words: tuple[bytes, ...]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: bytes) -> int:
        to = self.next[last].get(w)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, w, to)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            to = self.next[p][w]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._split(p, w, to)
        return new

    def _split(self, p: int, w: bytes, to: int) -> int:
        copy = self._state(dict(self.next[to]), self.length[p] + 1, self.link[to])
        self.link[to] = copy
        while p >= 0 and self.next[p].get(w) == to:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, edges: dict, length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def run(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(w)
            state, length = (0, 0) if to is None else (to, length + 1)
            yield state, length

    def find(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Hit marks by word, and the items found by text number."""
        n = len(words)
        step, found = np.zeros(n + 1, np.int32), {}
        if not n or not len(self.hashes):
            return step[:n] > 0, found
        # Only stretches whose words, and adjacent pairs, all occur in items can hold a window: the automaton takes those.
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == words.hash, self.codes[at], -1)
        inner = np.zeros(n, bool)
        inner[words.first[:-1][words.first[:-1] < n]] = True  # first words of texts
        joined = np.zeros(n, bool)
        if n > 1 and len(self.pairs):
            pair = code[:-1] * len(self.code) + code[1:]
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[k] == pair) & (code[:-1] >= 0) & (code[1:] >= 0) & ~inner[1:]
        begin = np.flatnonzero((code >= 0) & ~joined)
        follow = np.append(joined, False)
        stop = np.flatnonzero((code >= 0) & ~follow[1:]) + 1
        long = stop - begin >= self.least
        for a, b in zip(begin[long].tolist(), stop[long].tolist(), strict=True):
            text = int(np.searchsorted(words.first, a, "right")) - 1
            for i, (state, length) in enumerate(self.run(words.words(a, b)), a):
                if length >= self.window:
                    step[i - length + 1] += 1
                    step[i + 1] -= 1
                    found.setdefault(text, set()).update(self.at_window[state])
                for size, ids in self.short[state]:
                    if size <= length:
                        step[i - size + 1] += 1
                        step[i + 1] -= 1
                        found.setdefault(text, set()).update(ids)
        return np.cumsum(step[:n]) > 0, found


def item_groups(items: DataFrame, id_col: str, text_col: str, max_item_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with their words, in groups of at most max_item_words words or of one item."""
    group, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        w = Words([(row[1] or "").encode()], ALNUM)
        if group and size + len(w) > max_item_words:
            yield group
            group, size = [], 0
        group.append((row[0] if row[0] is not None else "", w.words(0, len(w))))
        size += len(w)
    if group:
        yield group


def _marker(automaton, first: bool):
    """Adds to each row's marks (a bit for each word) and items what one automaton finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value
        for batch in batches:
            column = batch.column(batch.num_columns - (1 if first else 4))
            texts = texts_of(column)
            marks, names, counts = [], [], []
            for a, b in slices([len(t) for t in texts]):
                w = Words(texts[a:b], ALNUM)
                hit, found = auto.find(w)
                for i in range(b - a):
                    own = hit[w.first[i] : w.first[i + 1]]
                    counts.append(len(own))
                    marks.append(np.packbits(own).tobytes() if i in found else b"")
                    names.append([auto.items[k] for k in found.get(i, ())])
            if not first:
                old, named = batch.column("marks").to_pylist(), batch.column("items").to_pylist()
                marks = [x if not y else y if not x else (np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(marks, old, strict=True)]
                names = [sorted({*x, *y}) for x, y in zip(names, named, strict=True)]
            keep = batch.columns if first else batch.columns[:-3]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string()))],
                [*(batch.schema.names if first else batch.schema.names[:-3]), "n_words", "marks", "items"],
            )

    return run


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS, carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` and the text, with n_words, marks (a bit for each word, empty if none is hit) and items (those with occurring windows).

    Map-only: documents never move. Null text has no words; items without words match nothing; an empty table of items marks
    nothing. Columns of docs named n_words, marks or items must not be carried.
    """
    spark = docs.sparkSession
    carry = [c for c in (carry or []) if c != text_col]
    out = docs.select(*carry, F.col(text_col))
    schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in out.columns) + ", n_words long, marks binary, items array<string>"
    first, held, work = True, None, ""
    for number, group in enumerate(item_groups(items, item_id, item_text, max_item_words)):
        if held is not None:
            work = work or _work.shared_dir(spark)
            out = _work.settle(out, f"{work}/{number}")
            held.unpersist()
        held = spark.sparkContext.broadcast(Automaton(group, window))
        out = out.mapInArrow(tidy(_marker(held, first)), schema)
        first = False
    return out if not first else out.mapInArrow(_marker(spark.sparkContext.broadcast(Automaton([], window)), True), schema)


def _verdicts(min_percent: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, marks, items = (batch.column(c).to_pylist() for c in ("n_words", "marks", "items"))
            hits = [int(np.unpackbits(np.frombuffer(m, np.uint8)).sum()) if m else 0 for m in marks]
            named = [sorted(set(i)) for i in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in named], pa.int64()),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in named]), pa.array([h > 0 and 100 * h >= min_percent * n for h, n in zip(hits, n_words, strict=True)])],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", window: int = WINDOW, min_percent: int = 5, **options) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated (hits reach min_percent of the words).

    Rows are judged one by one, so repeated ids and rows each get their answer. Null texts have no words. Other columns of docs are ignored whatever their names.
    """
    marked = mark(docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string")), items, window=window, carry=["id"], **options)
    out = marked.select("id", "n_words", "marks", "items").mapInArrow(_verdicts(min_percent, pa.int64()), "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("id", id_col)


def _cutter(at: int, max_span: int, max_percent: int):
    """Drops documents over the coverage limit and cuts spans over the length limit out of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-3]
            texts, n_words, marks = batch.column(at), batch.column("n_words").to_pylist(), batch.column("marks").to_pylist()
            keep, new = [], {}
            for i, (n, m) in enumerate(zip(n_words, marks, strict=True)):
                if not m:
                    keep.append(i)
                    continue
                hit = np.unpackbits(np.frombuffer(m, np.uint8))[:n]
                if 100 * int(hit.sum()) >= max_percent * n:
                    continue
                keep.append(i)
                step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                spans = [(a, b) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True) if b - a > max_span]
                if spans:
                    raw = texts[i].as_py().encode()
                    w = Words([raw], ALNUM)
                    parts, at_byte = [], 0
                    for a, b in spans:
                        parts.append(raw[at_byte : w.start[a]])
                        at_byte = int(w.end[b - 1])
                    new[i] = b"".join([*parts, raw[at_byte:]]).decode()
            cols = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-3]]
            if new:
                cols[at] = pa.array([new.get(i, texts[i].as_py()) for i in keep], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_span: int | None = None, max_percent: int = 5, **options) -> DataFrame:
    """docs without contamination, in their own columns: a row whose hits reach max_percent of its words goes; from the others
    spans of more than max_span hit words are cut (None: they stay whole). Rows are judged one by one, so repeated ids, nulls
    and ties need no rule. The columns n_words, marks and items may exist in docs.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text_col)
    order = [i for i in range(len(names)) if i != at] + [at]
    plain = docs.toDF(*inner)
    marked = mark(plain, items, inner[at], window=window, carry=[c for c in inner if c != inner[at]], **options)
    schema = ", ".join(f"`{inner[i]}` {plain.schema[inner[i]].dataType.simpleString()}" for i in order)
    out = marked.mapInArrow(tidy(_cutter(len(names) - 1, max_span if max_span is not None else 1 << 62, max_percent)), schema)
    return out.select(*[F.col(inner[i]).alias(names[i]) for i in range(len(names))])
