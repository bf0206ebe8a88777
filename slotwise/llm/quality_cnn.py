"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Filters over WIDTH bytes slide through each chunk
by STRIDE bytes and are max-pooled within it; the document's features are the mean, maximum and minimum of the pooled filters
over its chunks, and a logistic unit makes one probability of them. Filters and unit are learned by gradient descent on a
bounded sample of labelled texts (`sample_rows` for each label, whole texts); the score uses nothing but the text.

For speed a filter is held as tables over byte pairs, so a position costs WIDTH / 2 look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tokens import slices, texts_of, tidy
from .lang_id import sample

WIDTH, STRIDE, CHUNK, STEP, FILTERS = 8, 2, 128, 96, 16
#: Labelled rows of each label that training takes, at most.
SAMPLE_ROWS = 900
#: Bytes of text that training takes, at most.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
#: Bytes whose positions are held at a time.
BLOCK_BYTES = 1 << 18


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    unit: np.ndarray  # 3 * FILTERS
    offset: float
    center: np.ndarray
    scale: np.ndarray

    def tables(self) -> np.ndarray:
        """Filters by byte pair; the pair's first byte is the low one."""
        f = self.filters.astype(np.float32)
        return np.stack([(f[j + 1][:, None, :] + f[j][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])


def _padded(text: bytes) -> bytes:
    """Text with at least one whole filter, and an even number of bytes."""
    n = max(len(text), WIDTH)
    return text.ljust(n + n % 2, b"\0")


def chunk_starts(n: int) -> np.ndarray:
    """First byte of each chunk of a text of n bytes. The last chunk ends with the text."""
    last = max(0, n - CHUNK)
    last += last % 2
    starts = np.arange(0, last + 1, STEP)
    return starts if starts[-1] == last else np.append(starts, last)


def pooled(texts: list[bytes], tables: np.ndarray, where: bool = False):
    """Max-pooled filters of all chunks (chunks x FILTERS), the number of chunks of each text and, if asked, the byte positions of the maxima in the joined texts."""
    pads = [_padded(t) for t in texts]
    pairs = np.frombuffer(b"".join(pads), "<u2")
    sizes = np.array([len(p) for p in pads])
    base = np.cumsum(sizes) - sizes
    starts = [chunk_starts(n) for n in sizes]
    count = np.array([len(s) for s in starts])
    begin = np.concatenate(starts) + np.repeat(base, count)
    end = np.minimum(begin + CHUNK, np.repeat(base + sizes, count)) - WIDTH + STRIDE  # after the last position
    n = len(pairs) - WIDTH // 2 + 1
    conv = np.take(tables[0], pairs[:n], axis=0)
    for j in range(1, WIDTH // 2):
        conv += np.take(tables[j], pairs[j : j + n], axis=0)
    a, b = begin // 2, np.maximum(end // 2, begin // 2 + 1)
    # Chunks overlap, so even and odd ones are reduced apart.
    out = np.empty((len(a), conv.shape[1]), np.float32)
    cuts = np.minimum(np.stack([a, b], 1), n)
    for part in (slice(0, None, 3), slice(1, None, 3), slice(2, None, 3)):
        edges = cuts[part].ravel()
        if not len(edges):
            continue
        if edges[-1] >= n:
            reduced = np.maximum.reduceat(conv, edges[:-1], axis=0)[::2]
        else:
            reduced = np.maximum.reduceat(conv, edges, axis=0)[::2]
        out[part] = reduced
    if not where:
        return out, count, None
    at = np.empty(out.shape, np.int64)
    for i, (x, y) in enumerate(cuts.tolist()):
        at[i] = x + conv[x : max(y, x + 1)].argmax(0)
    return out, count, (pairs, at)


def features(z: np.ndarray, count: np.ndarray) -> np.ndarray:
    edge = np.cumsum(count) - count
    return np.concatenate([np.add.reduceat(z, edge, axis=0) / count[:, None], np.maximum.reduceat(z, edge, axis=0), np.minimum.reduceat(z, edge, axis=0)], 1)


def shortness(texts: list[bytes]) -> np.ndarray:
    """How much of one chunk a text leaves empty: a maximum over few positions is low for that reason alone."""
    return np.array([[max(0.0, 1 - len(t) / CHUNK)] for t in texts])


def score(texts: list[bytes], net: Net, tables: np.ndarray | None = None) -> np.ndarray:
    tables = net.tables() if tables is None else tables
    out = []
    for a, b in slices([len(t) for t in texts], BLOCK_BYTES):
        z, count, _ = pooled(texts[a:b], tables)
        f = (np.concatenate([features(np.tanh(z + net.bias), count), shortness(texts[a:b])], 1) - net.center) / net.scale
        out.append(1 / (1 + np.exp(-np.clip(f @ net.unit + net.offset, -50, 50))))
    return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5, epochs: int = 5, rate: float = 0.02, batch: int = 64) -> Net:
    """Adam on the log loss, both labels weighted alike; the unit is then fitted anew on all features. No labels, or one only, give a constant score."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, float)
    F_ = FILTERS
    net = Net(rng.normal(0, 0.15, (WIDTH, 256, F_)).astype(np.float32), np.zeros(F_, np.float32), np.zeros(3 * F_ + 1), 0.0, np.zeros(3 * F_ + 1), np.ones(3 * F_ + 1))
    if len(set(labels.tolist())) < 2:
        net.offset = 20.0 if not len(labels) or labels[0] > 0 else -20.0
        return net
    net.unit = rng.normal(0, 0.1, 3 * F_)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = {"filters": net.filters, "bias": net.bias, "unit": net.unit, "offset": np.zeros(1)}
    m, v = ({k: np.zeros(p.shape) for k, p in params.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for ids in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            own = [texts[i] for i in ids]
            raw, count, (pairs, at) = pooled(own, net.tables(), True)
            z = np.tanh(raw + net.bias)
            edge = np.cumsum(count) - count
            f = features(z, count)
            p = 1 / (1 + np.exp(-np.clip(f @ net.unit + params["offset"][0], -50, 50)))
            d = (p - labels[ids]) * weight[ids] / len(ids)
            df = d[:, None] * net.unit
            doc = np.repeat(np.arange(len(ids)), count)
            dz = df[doc, :F_] / count[doc][:, None]
            for part, extreme in ((1, np.maximum), (2, np.minimum)):
                is_it = z == extreme.reduceat(z, edge, axis=0)[doc]
                dz += is_it * df[doc, part * F_ : (part + 1) * F_] / np.maximum(1, np.add.reduceat(is_it.astype(float), edge, axis=0))[doc]
            dz *= 1 - z * z
            grad = {"unit": f.T @ d + 1e-4 * net.unit, "offset": np.array([d.sum()]), "bias": dz.sum(0)}
            g = np.zeros((WIDTH, 256, F_))
            col = np.broadcast_to(np.arange(F_), at.shape)
            for j in range(0, WIDTH, 2):
                pair = pairs[at + j // 2]
                np.add.at(g[j], (pair & 255, col), dz)
                np.add.at(g[j + 1], (pair >> 8, col), dz)
            grad["filters"] = g
            step += 1
            for k, q in params.items():
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                q -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(q.dtype)
    tables = net.tables()
    rows = []
    for a, b in slices([len(t) for t in texts], BLOCK_BYTES):
        z, count, _ = pooled(texts[a:b], tables)
        rows.append(np.concatenate([features(np.tanh(z + net.bias), count), shortness(texts[a:b])], 1))
    f = np.concatenate(rows)
    net.center, net.scale = f.mean(0), f.std(0) + 1e-3
    f = (f - net.center) / net.scale
    x = np.concatenate([f, np.ones((len(f), 1))], 1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):  # Newton steps of logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * p * (1 - p) + 1e-6
        w -= np.linalg.solve((x * s[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - labels)) + ridge * w)
    net.unit, net.offset = w[:-1], float(w[-1])
    return net


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Train on at most sample_rows texts of each label, and sample_bytes in all, among those where `usable` (a Column over id_col) holds.

    The sample goes by a hash of the id, so it is the same at every run. Rows equal in id, text and label count once; texts of one id
    that differ count each. Null ids, null texts and labels other than 0 and 1 are not learned from.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).withColumnRenamed("id", id_col).where(usable)
    known = known.withColumnRenamed(id_col, "i").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("body")).where("body is not null")
    there = rows.select("i", F.xxhash64("body").alias("h"), F.octet_length("body").alias("size")).join(known, "i")
    drawn = sample(there, ["i", "h", "size"], "y", sample_rows, ["i"])
    # The sample is bounded by now; of it, texts are taken in turn until their bytes are used up.
    drawn = drawn.withColumn("upto", F.sum("size").over(Window.orderBy("place", "y"))).where(F.col("upto") <= sample_bytes).select("i", "h", "y")
    picked = rows.withColumn("h", F.xxhash64("body")).join(F.broadcast(drawn), ["i", "h"]).groupBy("i", "h", "y").agg(F.first("body").alias("body"))
    found = sorted(picked.collect(), key=lambda r: (r.i, r.y, r.body))
    return train([r.body.encode() for r in found], np.array([r.y for r in found]))


def _scorer(net, at: int, mode: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        tables = model.tables()
        for batch in batches:
            s = score(texts_of(batch.column(at)), model, tables)
            if mode == "keep":
                yield batch.filter(pa.array(s >= threshold, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return run


def predict(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row. Null counts as the empty text, which the network scores as a few zero bytes. Each row is judged by itself, so repeated ids and rows need no rule. Other columns of docs are ignored whatever their names."""
    b = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(tidy(_scorer(b, 1, "score", 0.0)), "id long, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, as they are, with all their columns whatever their names. Each row is judged by itself; null counts as the empty text."""
    b = docs.sparkSession.sparkContext.broadcast(net)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(_scorer(b, docs.columns.index(text_col), "keep", threshold)), plain.schema).toDF(*docs.columns)
