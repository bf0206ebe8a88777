"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a parameter), lower-cased, letters only. Each language has a probability for
each piece. A word's probability in a language is the sum over all its segmentations into pieces, found by the forward
algorithm; a text's is the product over its words. Piece probabilities are learned by expectation maximisation over the same
forward-backward sums on words of a bounded sample of labelled texts (`sample_rows` for each language, whole texts).
Words are scored once for each partition and remembered, all languages at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tokens import tidy

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Letters of a word that one forward pass takes; a longer run of letters is taken in pieces of this length.
LONGEST_WORD = 32
SAMPLE_ROWS = 600
CACHE_WORDS = 300_000


def vocabulary(path: str) -> list[str]:
    """All pieces of a sentencepiece model that are a start mark and letters, lower-cased and sorted."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p and all(ch.isalpha() or (ch == START and i == 0) for i, ch in enumerate(p)) and p != START)


class Trie:
    """Pieces as a table of (node, letter) to node. Letter 0 is any that no piece has; every single known letter is a piece."""

    def __init__(self, pieces: list[str]):
        letters = sorted({ch for p in pieces for ch in p} | {START})
        pieces = sorted({*pieces, *letters})
        self.longest = max(map(len, pieces))
        self.pieces, letter = pieces, {ch: i + 1 for i, ch in enumerate(letters)}
        edges: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for k, p in enumerate(pieces):
            node = 0
            for ch in p:
                key = (node, letter[ch])
                node = edges.setdefault(key, len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = k
        self.piece_of = np.array(piece_of)
        width = len(letters) + 1
        self.of_point = np.zeros(max(map(ord, letters)) + 2, np.int64)
        self.of_point[[ord(ch) for ch in letters]] = np.arange(1, width)
        root = np.full(width, -1, np.int32)
        for (n, c), t in edges.items():
            if n == 0:
                root[c] = t
        self.root = root
        # Letters that never follow another in a piece need no column; most of a many-script vocabulary are such.
        inner = sorted({c for n, c in edges if n})
        self.column = np.zeros(width, np.int32)
        self.column[inner] = np.arange(1, len(inner) + 1)
        self.columns = len(inner) + 1
        self.edges = np.array([(n, self.column[c], t) for (n, c), t in edges.items() if n], np.int32).reshape(-1, 3)
        self.table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.full((len(self.piece_of), self.columns), -1, np.int32)
            self.table[self.edges[:, 0], self.edges[:, 1]] = self.edges[:, 2]
        return self.table[node, self.column[letter]]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the words, by row, with the start mark; and their lengths."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = np.frombuffer((START + START.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros((len(words), int(size.max())), np.int64)
        out[np.arange(out.shape[1]) < size[:, None]] = self.of_point[np.minimum(points, len(self.of_point) - 1)]
        return out, size

    def spans(self, letters: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in the words, by start and then end."""
        for s in range(letters.shape[1]):
            rows = np.flatnonzero(size > s)
            node = self.root[letters[rows, s]]
            for e in range(s + 1, min(letters.shape[1], s + self.longest) + 1):
                if e > s + 1:
                    rows, node = rows[live], node[live]
                    live = size[rows] >= e
                    rows, node = rows[live], node[live]
                    if not len(rows):
                        break
                    node = self.step(node, letters[rows, e - 1])
                live = node >= 0
                piece = np.where(live, self.piece_of[node], -1)
                hit = (piece >= 0) if e > s + 1 else (piece >= 0) | ~live  # an unknown letter is a piece of its own
                if hit.any():
                    yield s, e, rows[hit], piece[hit]


class Model:
    """Probabilities of pieces by language; the last row is an unknown letter."""

    def __init__(self, trie: Trie, langs: list[str], prob: np.ndarray):
        self.trie, self.langs, self.prob = trie, langs, prob

    def forward(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        letters, size = self.trie.encode(words)
        alpha = np.zeros((letters.shape[1] + 1, len(words), len(self.langs)))
        alpha[0] = 1
        spans = []
        for s, e, rows, piece in self.trie.spans(letters, size):
            alpha[e, rows] += alpha[s, rows] * self.prob[piece]
            spans.append((s, e, rows, piece))
        return alpha, (size, spans)

    def log10(self, words: list[str]) -> np.ndarray:
        """log10 probability of each word in each language, summed over all segmentations."""
        alpha, (size, _) = self.forward(words)
        return np.log10(np.maximum(alpha[size, np.arange(len(words))], 1e-300))


def learn(trie: Trie, counts: dict[str, Counter], rounds: int = 2, smooth: float = 0.2) -> Model:
    """Expectation maximisation. Languages share one model; each language's expected counts come from its own words."""
    langs = sorted(counts)
    n = len(trie.pieces) + 1
    prior = np.full(n, smooth)
    start = np.array([10.0 ** -len(p) for p in trie.pieces] + [1e-3])
    model = Model(trie, langs, np.repeat((start / start.sum())[:, None], len(langs), 1))
    for _ in range(rounds):
        expected = np.zeros((n, len(langs)))
        for k, lang in enumerate(langs):
            own = Model(trie, [lang], model.prob[:, k : k + 1])
            items = sorted(counts[lang].items())
            for a in range(0, len(items), 20_000):
                words, c = zip(*items[a : a + 20_000], strict=True)
                alpha, (size, spans) = own.forward(list(words))
                alpha = alpha[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[size, np.arange(len(words))] = 1
                c = np.array(c, float)
                total = np.maximum(alpha[size, np.arange(len(words))], 1e-300)
                for s, e, rows, piece in reversed(spans):
                    beta[s, rows] += beta[e, rows] * own.prob[piece, 0]
                for s, e, rows, piece in spans:
                    np.add.at(expected[:, k], piece, c[rows] * alpha[s, rows] * own.prob[piece, 0] * beta[e, rows] / total[rows])
        expected += prior[:, None]
        model = Model(trie, langs, expected / expected.sum(0))
    return model


def words_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    if not any(map(str.isalpha, words)) and not any(ch.isalpha() for w in words for ch in w):
        return []  # digits of other kinds only
    if len(max(words, key=len, default="")) <= LONGEST_WORD:
        return words
    return [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]


def sample(rows: DataFrame, keys: list[str], label: str, sample_rows: int, by: list[str] | None = None) -> DataFrame:
    """At most sample_rows distinct rows (keys, label) of each label: those with the smallest hashes of `by` (the keys if not given).

    The labels' sizes say how small a hash has to be, so that about twice as many rows as are wanted come together for each label, however many
    it has.
    """
    by = by or keys
    own = rows.select(*keys, label, F.xxhash64(*by).alias("at"))
    sizes = own.groupBy(label).agg(F.approx_count_distinct("at").alias("size_"))
    few = own.join(sizes, label).where((F.col("at") / 2.0**64 + 0.5) * F.col("size_") < 2 * sample_rows + 100).drop("size_").distinct()
    drawn = few.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy("at", *keys)))
    return drawn.where(F.col("place") <= sample_rows).drop("at")


def fit(docs: DataFrame, usable: Column, vocab: str, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn every language there is, each from at most sample_rows texts among rows where `usable` (a Column over id_col) holds and id, language and text are known."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(lang_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("body")).where(usable & F.col("y").isNotNull() & F.col("body").isNotNull())
    rows = rows.select(F.col(id_col).alias("i"), "y", F.xxhash64("body").alias("h"), "body").where("i is not null")
    drawn = rows.join(F.broadcast(sample(rows, ["i", "h"], "y", sample_rows).drop("place")), ["i", "h", "y"])  # sample_rows ids a language
    drawn = drawn.groupBy("i", "h", "y").agg(F.first("body").alias("body"))  # rows that repeat one count once
    counts: dict[str, Counter] = {}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(y, Counter()).update(words_of(t))
        flat = [(y, w, n) for y, c in found.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["y", "word", "n"])

    for y, w, n in drawn.select("y", "body").mapInArrow(tally, "y string, word string, n long").groupBy("y", "word").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(y, Counter())[w] = n
    return learn(Trie(vocabulary(vocab)), counts)


class Scorer:
    """Scores texts; remembers up to CACHE_WORDS words."""

    def __init__(self, model: Model):
        self.model, self.row, self.table, self.used = model, {}, np.zeros((1024, max(1, len(model.langs)))), 0

    def learn_words(self, words: set[str]) -> None:
        if self.used + len(words) > CACHE_WORDS:
            self.row, self.used = {}, 0
        new = sorted(words, key=len)
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            logs = self.model.log10(part)
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(part)] = logs
            self.row.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        found = [words_of(t) if t else [] for t in texts]
        every = set().union(*found)
        if missing := every - self.row.keys():
            self.learn_words(missing if self.used + len(missing) <= CACHE_WORDS else every)
        get, table = self.row.__getitem__, self.table
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            total = table[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            odds = 10.0 ** np.maximum(total - total.max(), -300)
            best = int(odds.argmax())
            out.append((self.model.langs[best], float(odds[best] / odds.sum())))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4 << 20) -> DataFrame:
    """id_col, lang_pred, score (the language's share of the probability of the text). Null texts and texts without letters are 'und' with score 0; ties go to the first language by name.

    Each row is judged by itself, so repeated ids and rows each get their answer. Other columns of docs are ignored whatever their names.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(b.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > batch_chars:
                    got += scorer.score(part)
                    part, size = [], 0
            got += scorer.score(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(tidy(run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
