"""Operators for training text against brute force, SQL and held-out labels."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from slotwise.llm import decontam, exact_index, html_extract, hyperminhash, lang_id, mixing, pst, quality_cnn, queries, recompress, token_rollup
from slotwise.llm._tokens import ALNUM, SPACED, Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
CASES = [
    (1, "Alpha beta gamma delta epsilon", "en", "src0", 30),
    (2, "ALPHA beta gamma delta epsilon", "en", "src0", 30),
    (2, "ALPHA beta gamma delta epsilon", "en", "src0", 30),
    (3, None, None, None, None),
    (4, "", "de", "src1", 0),
    (5, " \t\n ", "de", "src1", 4),
    (6, "to to to to to", "en", None, 14),
    (7, LONG, "en", "src11", len(LONG)),
    (8, LONG + " tail", "en", "src17", len(LONG)),
    (None, "no id at all here", "fr", "src2", 17),
    (9, f"before one {PASSAGE} after one", "en", "src3", 1),
    (10, f"before two x y z {PASSAGE}", "en", "src3", 1),
    (11, "ÀÉÎ αβγ 漢字 ½ — … «»", "el", "src4", 20),
    (12, "no no no " * 50, "es", "src5", 1),
    (13, "12345 --- !!!", "es", "src5", 1),
]


def table(spark, rows=CASES):
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "body", "key", "h", "n", "maybe", "train", "marks", "items", "n_words", "kept", "bucket", "score", "domain", "epoch"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql(text, data=MEDIUM):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    res = con.execute(text)
    names = [d[0] for d in res.description]
    return names, res.fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    names, want = sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, MEDIUM)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*names)) == sorted(map(tuple, want), key=repr)


def words_of(text):
    return (text or "").encode().split()


# ---- exact dedup


def brute_exact(data):
    groups = {}
    for d, t, *_ in data:
        groups.setdefault((t or "").encode().lower(), []).append(d)
    out = []
    for d, t, *_ in data:
        body = (t or "").encode().lower()
        keep = max((x for x in groups[body] if x is not None), default=None)
        out.append((d, keep, len(groups[body]), d == keep, hashlib.sha256(body).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("capacity", "bits"), [(50_000, 64), (3, 64), (2, 3), (1, 0)])
def test_exact_dedup(spark, capacity, bits):
    got = exact_index.exact_dedup(table(spark), capacity=capacity, hash_bits=bits) if bits else exact_index.exact_dedup(table(spark), capacity=capacity, hash_bits=1)
    assert rows(got.drop("chain_place")) == brute_exact(CASES)


def test_exact_dedup_empty(spark):
    assert exact_index.exact_dedup(table(spark, [])).collect() == []


def test_directory_doubles(spark, tmp_path):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    depth, buckets = exact_index.directory(keys, f"file://{tmp_path}", capacity=40)
    assert depth >= 5
    assert sum(2.0**-d for _, d in buckets.collect()) == 1.0  # the buckets cover all prefixes once


def test_chains_compare_bytes():
    """Rows of one key from several tasks, equal and different."""
    import pyarrow as pa

    names = ["h", "body", "keep", "n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in x], names) for x in (([1, 1, 2], [b"a", b"bb", b"a"], [5, 3, 9], [1, 2, 1]), ([2, 2, 3], [b"c", b"a", b"d"], [7, 11, None], [4, 2, 3]))]
    got = [tuple(r.values()) for b in exact_index._chains(iter(batches)) for r in b.to_pylist()]
    digest = lambda t: hashlib.sha256(t).digest()
    assert got == [(1, 0, digest(b"a"), 5, 1), (1, 1, digest(b"bb"), 3, 2), (2, 0, digest(b"a"), 11, 3), (2, 1, digest(b"c"), 7, 4), (3, 0, digest(b"d"), None, 3)]


# ---- near dedup


def brute_shingles(text, size=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_near(data, size=4):
    sets = [(d, brute_shingles(t, size)) for d, t, *_ in data]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 0.8 <= len(x) / len(y) <= 1.25 and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets), key=repr)


def test_near_dedup_cases(spark):
    assert rows(hyperminhash.near_dedup(table(spark), size=4)) == brute_near(CASES)
    assert hyperminhash.near_dedup(table(spark, [])).collect() == []


def test_near_dedup_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    assert rows(queries.op8_near_dedup(spark, MEDIUM)) == brute_near(data)


def test_near_dedup_chain(spark):
    """Texts that change little by little: the ends are far apart, and every link counts."""
    base = [f"a{i}" for i in range(200)]
    data = [(i, " ".join(f"b{k}" if k < 4 * i else w for k, w in enumerate(base)), "en", "s", 1) for i in range(25)]
    assert rows(hyperminhash.near_dedup(table(spark, data), size=4)) == brute_near(data)


def test_near_dedup_many_near_copies(spark):
    """One large group whose members differ from each other about as much as the threshold allows, beside texts that share a passage only."""
    rng = np.random.default_rng(5)
    base = [f"a{i}" for i in range(150)]
    data = []
    for i in range(150):
        own = list(base)
        for k in rng.choice(150, 4, False):
            own[k] = f"z{i}x{k}"
        data.append((i, " ".join(own), "en", "s", 1))
    line = " ".join(f"l{i}" for i in range(12))
    for i in range(150, 300):
        data.append((i, line + " " + " ".join(f"o{i}x{k}" for k in range(int(rng.integers(3, 60)))), "en", "s", 1))
    assert rows(hyperminhash.near_dedup(table(spark, data), size=4)) == brute_near(data)


@pytest.mark.parametrize("options", [{}, {"block_members": 7, "block_bytes": 20_000}])
def test_near_dedup_large_groups(spark, options):
    """Clusters beyond a block, of members that hold together only by others, and of such that are no links at all."""
    rng = np.random.default_rng(8)
    data = []
    for g, (n, cut) in enumerate([(60, 8), (40, 3), (40, 5)]):
        base = [f"g{g}x{i}" for i in range(120)]
        for _ in range(n):
            own = list(base)
            for k in rng.choice(120, cut, False):
                own[k] = f"z{len(data)}x{k}"
            data.append((len(data), " ".join(own), "en", "s", 1))
    data += [(200 + i, " ".join(f"b{k}" if k < 3 * i else f"a{k}" for k in range(150)), "en", "s", 1) for i in range(40)]
    want = brute_near(data)
    assert 20 < len({c for *_, c, _ in want}) < 180
    assert rows(hyperminhash.near_dedup(table(spark, data), size=4, **options)) == want


def pages_of_templates(n, families, rng):
    """n texts of `families` templates: half of the words are the template's, each at its place, the others the text's own."""
    out = []
    for i in range(n):
        f = i % families
        out.append((i, " ".join([f"t{f}x{k}" for k in range(70)] + [f"o{i}x{k}" for k in range(int(rng.integers(65, 75)))]), "en", "s", 1))
    return out


def test_near_dedup_templates_grow_in_proportion(spark):
    """Members of a band that share half of their words and are not near: rows with sketches that all rounds deal, for twice as many texts."""
    from pyspark.sql.classic.dataframe import DataFrame

    dealt = {}
    sort = DataFrame.sortWithinPartitions
    for n in (400, 800):

        def counted(self, *columns, n=n):
            dealt[n] = dealt.get(n, 0) + self.count()
            return sort(self, *columns)

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(DataFrame, "sortWithinPartitions", counted)
            got = hyperminhash.near_dedup(table(spark, pages_of_templates(n, 1, np.random.default_rng(3))), size=4, block_members=50).collect()
        assert all(r.kept for r in got)
    assert 0 < dealt[800] < 2.4 * dealt[400] and dealt[800] < 10 * 800


def test_near_dedup_families_in_one_band(spark):
    """A band of several families that don't meet, among them near copies: taken apart by registers, no link is lost."""
    rng = np.random.default_rng(4)
    data = pages_of_templates(120, 3, rng)
    for i, (_, text, *_) in list(enumerate(data))[:60]:
        words = text.split()
        words[int(rng.integers(len(words)))] = "changed"
        data.append((500 + i, " ".join(words), "en", "s", 1))
    for i in range(200):  # short texts of few shingles
        data.append((1000 + i, f"a b c d e f g{i % 90} h{i % 70}", "en", "s", 1))
    want = brute_near(data)
    assert len({c for *_, c, _ in want}) < len(want)
    assert rows(hyperminhash.near_dedup(table(spark, data), size=4, block_members=5, block_bytes=4000)) == want


def test_least_common_holds_for_linked_sets():
    """No linked pair that the estimate lets through agrees in fewer registers than the prefix filter counts on."""
    rng = np.random.default_rng(6)
    for n in [*range(1, 30), 60, 100, 300, 2000]:
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            y = np.union1d(x[int(rng.integers(0, n // 9 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            a, b = hyperminhash.registers(x), hyperminhash.registers(y)
            same = int(((a == b) & (a > 0)).sum())
            for u, r in ((x, a), (y, b)):
                j, k = hyperminhash.estimate(a[None], b[None], np.array([float(len(x))]), np.array([float(len(y))]))
                if j[0] >= 0.8 - hyperminhash.SLACK * math.sqrt(0.16 / k[0]):
                    assert same >= hyperminhash.least_common(np.array([len(u)]), np.array([int((r > 0).sum())]), 80)[0]


def test_near_dedup_repeated_ids(spark):
    """Rows of one id are one document, with the links of all its texts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    texts = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, b + " y"), (5, c), (5, a + " x"), (6, c + " x"), (7, c), (8, "p q r s"), (9, "p q r s"), (9, "u v w x y"), (10, "u v w x y"), (10, "u v w x y"), (None, a)]
    data = [(i, t, "en", "s", 1) for i, t in texts]
    for options in ({}, {"block_members": 2, "block_bytes": 100}):
        assert rows(hyperminhash.near_dedup(table(spark, data), size=4, **options)) == brute_near(data)


def test_no_pair_of_small_sets_is_lost():
    """Pigeonhole: whatever differs, sets at the threshold share a band."""
    rng = np.random.default_rng(9)
    for n in [*range(4, 40), 50, 64, 80, 90, 97]:
        for _ in range(60):
            most = int(n * 0.25)
            cut = int(rng.integers(0, most + 1))
            add = 0
            while 100 * (n - cut) >= 80 * (n + add + 1):
                add += 1
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            y = np.unique(np.concatenate([x[cut:] if rng.random() < 0.5 else rng.permutation(x)[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, add + 1))).astype(np.uint64) * np.uint64(2)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert set(hyperminhash.band_keys(hyperminhash.registers(x), len(x))) & set(hyperminhash.band_keys(hyperminhash.registers(y), len(y)))


def test_estimate_is_corrected():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)) for _ in range(300)]
    x = np.stack([hyperminhash.registers(s) for s in sets])
    n = np.full(299, 5000.0)
    assert abs(hyperminhash.estimate(x[1:], x[:-1], n, n)[0].mean()) < 1e-3
    other = np.stack([hyperminhash.registers(np.unique(np.concatenate([s[:: 2], s[1::4]]))) for s in sets])
    j = hyperminhash.estimate(x, other, np.full(300, 5000.0), np.full(300, 3750.0))[0].mean()
    assert abs(j - 0.75) < 0.02


# ---- substring dedup


def brute_substring(data, window=35):
    docs = [words_of(t) for _, t, *_ in data]
    count = Counter(tuple(w[p : p + window]) for w in docs for p in range(len(w) - window + 1))
    out = []
    for (d, *_), w in zip(data, docs, strict=True):
        keep = np.ones(len(w), bool)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                keep[p : p + window] = False
        left = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((d, len(w), int(len(w) - keep.sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 4, 35, 64])
def test_substring_dedup(spark, window):
    small = [r for r in CASES if r[1] is None or len(r[1]) < 5000]
    periodic = [(100 + i, " ".join(["x", "y", "z"][: i + 1] * 60), "en", "s", 1) for i in range(3)]
    data = small + periodic
    assert rows(recompress.substring_dedup(table(spark, data), window=window)) == brute_substring(data, window)


def test_substring_dedup_long_and_empty(spark):
    assert rows(recompress.substring_dedup(table(spark))) == brute_substring(CASES)
    assert recompress.substring_dedup(table(spark, [])).collect() == []
    text = {r.doc_id: r.kept_text for r in recompress.substring_dedup(table(spark), with_text=True).collect()}
    assert text[9] == "before one after one"


def test_equal_substrings_get_equal_names():
    rng = np.random.default_rng(7)
    shared = [f"s{x}" for x in rng.integers(0, 50, 300)]
    texts = [" ".join([f"l{x}" for x in rng.integers(0, 50, 40)] + shared + [f"r{x}" for x in rng.integers(0, 50, 40)]).encode() for _ in range(2)]
    w = Words(texts, SPACED, False)
    name, where = recompress.anchors(w, np.array([45, 45 + 380]), 35)
    assert name[0] == name[1] and where[0] + 380 == where[1]


# ---- language model


def brute_base(data):
    train = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, *_ in data]
    texts = [[*((t or "").encode().lower().split()), None] for _, t, *_ in data]
    c = Counter(w for k, t in zip(train, texts, strict=True) if k for w in t)
    n, v = sum(c.values()), len(c)
    return {(d, len(t), sum(c[w] > 0 for w in t), n): sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for (d, *_), t in zip(data, texts, strict=True)}


def test_lm_score(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    got = queries.op5_lm_score(spark, MEDIUM).collect()
    want = brute_base(data)
    assert len(got) == len(data)
    for r in got:
        assert math.isclose(r.base_score, want[r.doc_id, r.n_tokens, r.n_known, r.train_tokens], rel_tol=1e-9)
        assert r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # though the base counts no word that it never saw


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_lm_cases(spark, block):
    got = pst.score(table(spark), queries.fold("doc_id", 10) != 0, block_bytes=block).collect()
    want = brute_base(CASES)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got if r.doc_id) == sorted(k for d in CASES for k in want if k[0] == d[0] and d[0])
    for r in got:
        assert math.isclose(r.base_score, want[r.doc_id, r.n_tokens, r.n_known, r.train_tokens], rel_tol=1e-9, abs_tol=1e-9)
    assert pst.score(table(spark, []), queries.fold("doc_id", 10) != 0).collect() == []
    none = pst.score(table(spark), F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) and r.n_known == 0 for r in none)


def test_lm_blocks_of_many_slices(spark):
    """A block of texts beyond 6 MB, which a task takes in several slices."""
    long = " ".join(f"v{i % 30_000}x{i % 7}" for i in range(150_000))
    data = [(i, f"{long} u{i}", "en", "s", 1) for i in range(1, 6)] + [(i, f"short text {i}", "en", "s", 1) for i in range(6, 40)]
    got = pst.score(table(spark, data), queries.fold("doc_id", 10) != 0, block_bytes=1 << 30).collect()
    want = brute_base(data)
    assert len(got) == len(data)
    for r in got:
        assert math.isfinite(r.score) and r.score <= 0 and (not r.train or r.n_known == r.n_tokens)
        assert math.isclose(r.base_score, want[r.doc_id, r.n_tokens, r.n_known, r.train_tokens], rel_tol=1e-9)


def test_contexts_stay_within_texts():
    w = Words([b"aa bb cc aa", b"", b"x"], SPACED)
    to, context, place = pst.sequence(w)
    a, b, c, x = (int(pst.symbols_of(Words([t], SPACED))[0]) for t in (b"aa", b"bb", b"cc", b"x"))
    e, code = pst.END, lambda *s: s[0] * 4096 + s[1] * 64 + s[2]
    assert to.tolist() == [a, b, c, a, e, e, x, e] and place.tolist() == [0, 1, 2, 3, 6]
    assert context.tolist() == [code(e, e, e), code(a, e, e), code(b, a, e), code(c, b, a), code(a, c, b), code(e, e, e), code(e, e, e), code(x, e, e)]
    assert int(pst.symbols_of(Words([b"q\tx"], SPACED))[1]) == x  # what stands before a short word doesn't matter


def test_token_tree(spark, tmp_path):
    """Against a tree that is made by hand from all contexts: the same states, chosen by divergence, and proper distributions."""
    rng = np.random.default_rng(4)
    vocabulary = [f"{x}{y}" for x in "abcdefgh" for y in "xyzuvw"]
    texts = []
    for _ in range(300):  # the word two before decides
        t = [str(rng.choice(vocabulary)), str(rng.choice(vocabulary))]
        for _ in range(60):
            t.append(str(rng.choice(vocabulary)) if rng.random() < 0.3 else vocabulary[(vocabulary.index(t[-2]) * 7 + 3) % len(vocabulary)])
        texts.append(" ".join(t))
    rows_ = spark.createDataFrame([(t,) for t in texts], "body string").repartition(3)
    _, tokens, n, ends, _ = pst.fit(rows_, f"file://{tmp_path}")
    assert (n, ends) == (300 * 63, 300) and np.allclose((10.0 ** tokens.log.astype(float)).sum(1), 1, atol=1e-4)
    counts: dict[tuple, Counter] = {}
    seen = []
    for t in texts:
        s = [pst.END] * 3 + pst.symbols_of(Words([t.encode()], SPACED)).tolist() + [pst.END]
        for i in range(3, len(s)):
            seen.append((tuple(s[i - 3 : i]), s[i]))
            for k in range(4):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    smoothed = {(): {x: (counts[()][x] + 0.5) / (n + 32) for x in range(64)}}
    keep = {()}
    for c in sorted(counts, key=len)[1:]:
        total, below = sum(counts[c].values()), smoothed[c[1:]]
        smoothed[c] = {x: (counts[c][x] + 20 * below[x]) / (total + 20) for x in range(64)}
        if sum(m * math.log((m - 1 + 20 * below[x]) / (total - 1 + 20) / below[x]) for x, m in counts[c].items()) >= pst.TOKEN_DIVERGENCE:
            keep |= {c[i:] for i in range(len(c) + 1)}
    assert tokens.kept == len(keep) - 1 and {2} <= set(map(len, keep))
    for c, x in seen[::50]:
        state = next(c[i:] for i in range(4) if c[i:] in keep)
        code = c[2] * 4096 + c[1] * 64 + c[0]
        assert math.isclose(tokens.log10(np.array([code]), np.array([x]))[0], math.log10(smoothed[state][x]), abs_tol=1e-5)


def test_score_does_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in pst.score(d, queries.fold("doc_id", 10) != 0).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_tree_distributions_sum_to_one():
    w = Words([b"the then there this that other " * 50], SPACED)
    u, first = np.unique(w.hash, return_index=True)
    tree = pst.Tree(*pst.grams(*pst.spelled(w, first)), divergence=0.1)
    others = 256 - len(set(b"thenrisao "))
    p = 10.0**tree.log
    assert np.allclose(p[:, 1:].sum(1) + p[:, 0] * others, 1)
    assert len(tree.log) > 10


def test_tree_keeps_all_divergent_contexts():
    """More than 20,000 of them, each with ten occurrences."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123", np.uint8)
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(30)] * 3, indexing="ij"))
    words = letters[np.stack([a, b, c, (7 * a + 11 * b + 13 * c + a * b * c) % 30], 1)]
    w = Words([b" ".join(x.tobytes() for x in words)], SPACED)
    tree = pst.Tree(*pst.grams(*pst.spelled(w, np.repeat(np.arange(len(w)), 10))))
    assert len(tree.log) > 27_000
    step = tree.start
    for x in b"abc":
        step = tree.next[step, tree.symbol[x]]
    assert 10 ** tree.log[step, tree.symbol[letters[(11 + 26 + 0) % 30]]] > 0.3


def test_rare_contexts_are_kept(spark, tmp_path):
    """A context of 7 occurrences, less than 2e-5 of all symbols, that says what comes next."""
    rows = spark.createDataFrame([(LONG + " " + " ".join(f"qj{i}" for i in range(7)),)], "body string")
    tree = pst.fit(rows, f"file://{tmp_path}")[0]
    assert 10 ** tree.log[tree.next[tree.start, tree.symbol[ord("q")]], tree.symbol[ord("j")]] > 0.5


# ---- decontamination


def test_decontamination_cases(spark):
    items = spark.createDataFrame([(1, "One two, THREE four"), (2, " ".join(f"t{i}" for i in range(20))), (3, None), (4, "one"), (5, "!!"), (10, "one two three four")], "item_id long, text string")
    data = [(1, "zero ONE-two three: four five", "", "", 0), (2, " ".join(f"t{i}" for i in range(3, 18)), "", "", 0), (3, " ".join(f"t{i}" for i in range(12)), "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0)]
    for group in (1_000_000, 5):
        got = {r.doc_id: r for r in decontam.report(table(spark, data), items, max_item_words=group).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (6, 4, 3)
        assert got[1].items_sha256 == hashlib.sha256(b"1,10,4").hexdigest()
        assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (15, 1, True)
        assert (got[3].n_hit, got[3].contaminated) == (0, False)
        assert (got[4].n_words, got[5].n_words) == (0, 0)
    assert decontam.report(table(spark, []), items).collect() == []
    assert {r.n_hit for r in decontam.report(table(spark, data), items.limit(0)).collect()} == {0}


def test_decontaminate_cuts_or_drops(spark):
    items = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(14)))], "item_id long, text string")
    passage, clean = " ".join(f"t{i}" for i in range(14)), " ".join(f"c{i}" for i in range(600))
    data = [(1, passage, "", "", 0), (2, f"{clean} {passage} end", "", "", 0), (3, clean, "", "", 0), (4, None, "", "", 0)]
    df = table(spark, data)
    got = {r.doc_id: r for r in decontam.decontaminate(df, items).collect()}
    assert sorted(got) == [2, 3, 4] and got[2].text == data[1][1] and got[3].n_words == "clash"
    cut = {r.doc_id: r.text for r in decontam.decontaminate(df, items, max_span=10).collect()}
    assert cut[2] == f"{clean}  end"


def test_automaton_longest_matches():
    rng = np.random.default_rng(11)
    items = [(str(i), [bytes([97 + x]) for x in rng.integers(0, 3, 30)]) for i in range(6)]
    auto = decontam.Automaton(items, 5)
    text = [bytes([97 + x]) for x in rng.integers(0, 3, 300)]
    every = {tuple(w[i:j]) for _, w in items for i in range(30) for j in range(i + 1, 31)}
    for i, (_, n) in enumerate(auto.run(text)):
        assert n == max([k for k in range(1, min(i + 1, 30) + 1) if tuple(text[i - k + 1 : i + 1]) in every], default=0)
    assert len(Words([b"a-b C9"], ALNUM)) == 3


# ---- mixing


def test_mixing_cases(spark):
    got = mixing.mix(table(spark).drop("domain"), F.lit("all"), {}, fraction_pct=100, max_epochs=2).collect()
    assert sum(r.n_tokens for r in got) >= sum(len(words_of(t)) for _, t, *_ in CASES)
    assert max(Counter((r.doc_id, r.epoch) for r in got if r.doc_id != 2).values()) == 1
    assert mixing.mix(table(spark, []), F.lit("all"), {}).collect() == []


def test_shares_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10, 1), ("a", "en", "s2", 1000, 1), ("a", "de", "s3", 1000, 1), ("b", "en", "s4", 2000, 1)], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.share for r in mixing.leaf_budgets(leaves, {}, fraction_pct=20, max_epochs=1).collect()}
    assert got == {"s1": 10, "s2": 191, "s3": 200, "s4": 401}  # 802 in all
    shut = {r.source: r.share for r in mixing.leaf_budgets(leaves, {"a/en": 0}, fraction_pct=100, max_epochs=1).collect()}
    assert shut == {"s3": 1000, "s4": 2000}


# ---- classifiers


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    model = lang_id.fit(table(spark), F.lit(True), queries.PIECES)
    got = {r.doc_id: r for r in lang_id.predict(table(spark), model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 13)] == ["und"] * 4
    assert got[11].lang_pred == "el" and got[12].lang_pred == "es"
    assert lang_id.predict(table(spark, []), model).collect() == []
    empty = lang_id.fit(table(spark, []), F.lit(True), queries.PIECES)
    assert {r.lang_pred for r in lang_id.predict(table(spark), empty).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    trie = lang_id.Trie(["a", "b", "ab", "ba", "aba", lang_id.START + "a"])
    rng = np.random.default_rng(2)
    prob = rng.random((len(trie.pieces) + 1, 2))
    model = lang_id.Model(trie, ["x", "y"], prob)
    index = {p: i for i, p in enumerate(trie.pieces)}

    def total(s, k):
        return 1.0 if not s else sum(prob[index[s[:n]], k] * total(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in index)

    for word in ("a", "abab", "babaab"):
        assert np.allclose(10 ** model.log10([word])[0], [total(lang_id.START + word, k) for k in (0, 1)])


def test_quality_held_out(spark):
    got = queries.op3_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.98
    assert np.mean(s[y == 1] >= 0.3) > 0.97


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (12, 0), (9, 1), (99, 1), (None, 0)], "doc_id long, quality int")
    net = quality_cnn.fit(table(spark), labels, F.lit(True))
    got = quality_cnn.predict(table(spark), net).collect()
    assert len(got) == len(CASES) and all(0 <= r.score <= 1 for r in got)
    assert quality_cnn.predict(table(spark, []), net).collect() == []
    assert quality_cnn.keep_good(table(spark), net, threshold=0.0).count() == len(CASES)
    blank = quality_cnn.fit(table(spark), labels.limit(0), F.lit(True))
    assert all(r.score > 0.99 for r in quality_cnn.predict(table(spark), blank).collect())


def test_chunks_cover_every_byte():
    for n in (8, 9, 127, 128, 129, 130, 1000, 4097):
        size = max(n, 8) + n % 2
        starts = quality_cnn.chunk_starts(size)
        covered = np.zeros(size, bool)
        for s in starts:
            covered[s : s + quality_cnn.CHUNK] = True
        assert covered.all() and (starts % 2 == 0).all()


def test_pooled_is_the_convolution():
    rng = np.random.default_rng(1)
    net = quality_cnn.Net(rng.normal(size=(8, 256, 16)).astype(np.float32), np.zeros(16), np.zeros(48), 0.0, np.zeros(48), np.ones(48))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 3, 128, 333, 777)]
    z, count, _ = quality_cnn.pooled(texts, net.tables())
    at = 0
    for t, n in zip(texts, count, strict=True):
        p = quality_cnn._padded(t)
        for s in quality_cnn.chunk_starts(len(p)):
            want = np.max([sum(net.filters[j, p[x + j]] for j in range(8)) for x in range(s, min(s + 128, len(p)) - 7, 2)], axis=0)
            assert np.allclose(z[at], want, atol=1e-4)
            at += 1
    assert at == len(z)


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>Site &amp; title</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a> The daily page</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better for you and all of us, please accept them now.</p></div>
<article><h1>A&nbsp;fine   title</h1><p>First <b>bold</b> and <i>it</i>alic &lt;text&gt; with an <a href="x">own link</a><br>and more.</p><p>Hm.</p><aside><p>Read also this other very good story that we have.</p></aside>
<div class="ad">Buy this thing now, it is cheap and it is good for you and all.</div><p>Last words &#233;&#x41; &amp</p><section id="comments"><p>I think that this is a very good article and I like it a lot.</p></section></article>
<form>Your name <input name="q"> <button>Send</button></form><footer>&copy; 2024 the page</footer></body></html>"""


def test_page():
    assert html_extract.extract(PAGE) == "A fine title\nFirst bold and italic <text> with an own link and more.\nHm.\nLast words éA &"


def test_page_without_article():
    text = " ".join(["word"] * 40)
    page = f"<div class=menu><a href=a>Home</a> <a href=b>News</a></div><div id='wrap'><h2>The title of it</h2><p>{text}</p><p>Short one here.</p><p>{text}</p></div><div id=footer>Copyright us</div>"
    assert html_extract.extract(page) == f"The title of it\n{text}\nShort one here.\n{text}"


@pytest.mark.parametrize("markup", [
    '<p class="advert">{}</p>', '<p class="comment">{}</p>', '<ul><li class="related">{}</li></ul>', '<p>kept words <span class="advertisement">{}</span></p>', '<table><tr><td class="sidebar">{}</td></tr></table>', "<p hidden>{}</p>",
    '<div style="display:none">{}</div>', '<p style="color:red; display : none">{}</p>', '<div aria-hidden="true"><p>{}</p></div>', '<section class="comments-area"><p>{}</p></section>', '<div id="leftSidebar"><p>{}</p></div>', '<div class="cookie-notice">{}</div>',
    '<p class="ad">{}<p>kept paragraph of words</p>', '<ul><li class="share">{}<li>a kept item of the list</ul>',
])
def test_what_elements_say_of_themselves(markup):
    text = "These many words are no part of the article and must not be kept in it."
    page = f"<article><h1>The title of it</h1><p>{'word ' * 30}</p>{markup.format(text)}<p>{'more ' * 30}</p></article>"
    got = html_extract.extract(page)
    assert "must not" not in got and got.count("word") >= 30 and got.count("more") == 30 and "\nmore" in got
    assert got.count("kept") == page.count("kept") - text.count("kept")


@pytest.mark.parametrize("markup", ['<div class="social-text"><p>{}</p></div>', '<section class="legal-analysis"><p>{}</p></section>', '<p class="comment-on-law">{}</p>', '<p><b class="lead">{}</b></p>', '<div hidden="until-found"><p>{}</p></div>', "<p>{}", '<ul><li class="point">{}</ul>'])
def test_names_that_only_sound_like_boilerplate(markup):
    text = "These many words are part of the article and are kept in it as they are."
    page = f"<article><h1>The title of it</h1><p>{'word ' * 30}</p>{markup.format(text)}<p>{'more ' * 30}</p></article>"
    assert text in html_extract.extract(page)


@pytest.mark.parametrize("name", "notice warning banner message teaser meta tags site-notice notice-box article-notice post-meta outbrain partner-offer".split())
def test_notices_inside_an_article_go(name):
    text = "word " * 30
    for markup in (f"<div class='{name}'><p>These words must not be kept.</p></div>", f"<p class='{name}'>These words must not be kept.</p>"):
        page = f"<article><h1>The title of it</h1><p>{text}</p>{markup}<p>{text}</p></article>"
        assert html_extract.extract(page).split("\n") == ["The title of it", text.strip(), text.strip()]


def test_links_around_blocks_count_as_links():
    """A link goes on over the blocks in it and ends with the block that it stands in, closed or not."""
    linked = lambda page: [(b[1], b[2]) for b in html_extract.blocks(page)]
    assert linked("<div><a href='/s'><h3>Another story here</h3><p>and more</p></a><p>not of it</p></div>") == [(3, 3), (2, 2), (3, 0)]
    assert linked("<p><a href='/s'>never closed</p><p>not of it</p>") == [(2, 2), (3, 0)]
    assert linked("<a name='x'>an anchor<p>not of it</p>") == [(2, 2), (3, 0)]
    assert linked("<a href='/s'><div><img src='x'><hr>all of it</div></a> not of it") == [(3, 3), (3, 0)]
    text = "word " * 40
    cards = "".join(f"<a href='/s{i}'><h3>Another long story of many words, number {i} of the site</h3></a>" for i in range(3))
    assert html_extract.extract(f"<div><h1>The title of it</h1><p>{text}</p><p>{text}</p></div><div>{cards}</div>").count("Another") == 0


def test_blocks_of_many_pages():
    """Precision and recall by block on 60 made pages of six layouts, whose blocks are labelled."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    some = lambda a, b: " ".join(rng.choice(words, int(rng.integers(a, b))))
    right = kept = wanted = 0
    for k in range(60):
        good, bad, number = [], [], [0]

        def block(label, text, good=good, bad=bad, number=number):
            number[0] += 1
            text = f"k{number[0]}x {text}"
            (good if label else bad).append(text)
            return text

        nav = "".join(f"<li><a href='/{i}'>{block(0, some(1, 3))}</a></li>" for i in range(int(rng.integers(3, 9))))
        body = "".join(f"<h2>{block(1, some(2, 7))}</h2><p>{block(1, some(20, 90))}</p>" if rng.random() < 0.4 else f"<p>{block(1, some(8, 120))}</p>" for _ in range(int(rng.integers(3, 9))))
        aside, foot, note = block(0, some(8, 30)), block(0, some(4, 15)), block(0, some(6, 20))
        if k % 6 == 0:
            page = f"<nav><ul>{nav}</ul></nav><article>{body}</article><aside><p>{aside}</p></aside><footer>{foot}</footer><div class='cookie-banner'>{note}</div>"
        elif k % 6 == 1:
            page = f"<div id='menu'><ul>{nav}</ul></div><div class='post-content'>{body}<p class='advert'>{aside}</p></div><div id='footer'>{foot}</div><form>{note}</form>"
        elif k % 6 == 2:
            page = f"<header><ul>{nav}</ul></header><main>{body}<section class='comments'><p>{aside}</p></section></main><div class='site-footer'><p>{foot}</p></div><div hidden>{note}</div>"
        elif k % 6 == 3:
            page = f"<ul>{nav}</ul><div>{body}</div><div class='sidebar'><p>{aside}</p></div><footer><p>{foot}</p></footer><div class='newsletter-box'>{note}</div>"
        elif k % 6 == 4:
            page = f"<table><tr><td class='nav'>{nav}<td>{body}<td class='sidebar'>{aside}</table><p class='copyright'>{foot}</p><div style='display:none'>{note}</div>"
        else:
            page = f"<nav>{nav}</nav><article><header><h1>{block(1, some(3, 9))}</h1></header>{body}<aside>{aside}</aside><p>{block(1, some(5, 40))}<span class='ad'>{note}</span></p></article><footer>{foot}</footer>"
        got = html_extract.extract(f"<html><body>{page}</body></html>")
        kept += len(got.split("\n")) if got else 0
        right += sum(x in got for x in good)
        wanted += len(good)
        assert sum(x in got for x in bad) <= 2
    assert right / wanted > 0.97 and right / kept > 0.95


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<article><p>" + "word " * 50 + "</p></article>" + "</div>" * 3000
    assert html_extract.extract(deep).split() == ["word"] * 50
    long = "<article>" + "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5000)) + "</article>"
    assert len(html_extract.extract(long).split("\n")) == 5000


def test_broken_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed <b"), (4, "u", '<article><p title="a > b">x y</p><p>z</article'), (None, "u", "<article><!-- never closed")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert [got[i].text for i in (1, 2, 4, None)] == ["", "", "x y\nz", ""]
    assert got[4].n_chars == 5 and html_extract.extract_pages(pages.limit(0)).collect() == []


def test_pages_keep_the_whole_article(spark):
    got = html_extract.extract_pages(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) > 0 for r in got)


# ---- token counts


def test_rollup_is_idempotent(spark, tmp_path):
    roll = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    make = lambda *r: spark.createDataFrame(list(r), token_rollup.SCHEMA)
    old, new = make(("s", "en", "v1", 1, 10, 50), ("s", None, "v1", 1, 7, 20)), make(("s", "en", "v1", 1, 12, 50))
    assert roll.commit("a", token_rollup.inserts(old)) and not roll.commit("a", token_rollup.inserts(old))
    assert roll.commit("b/..", token_rollup.revisions(old.where("lang = 'en'"), new))
    assert rows(roll.totals()) == [("s", "en", "v1", 1, 12, 50), ("s", None, "v1", 1, 7, 20)]
    assert roll.commit("c", token_rollup.deletes(old.where("lang is null")))
    assert rows(roll.totals()) == [("s", "en", "v1", 1, 12, 50)]
    assert roll.compact("fold") and not roll.commit("a", token_rollup.inserts(old))
    assert roll.commit("d", token_rollup.inserts(new)) and rows(roll.totals()) == [("s", "en", "v1", 2, 24, 100)]
    assert token_rollup.Rollup(spark, str(tmp_path / "none")).totals().collect() == []


def test_compaction_beside_a_commit(spark, tmp_path, monkeypatch):
    """A batch that is committed while totals are being folded counts once; of two compactions at a time one is refused."""
    make = lambda *r: spark.createDataFrame(list(r), token_rollup.SCHEMA)
    roll = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.commit("a", token_rollup.inserts(make(("s", "en", "v1", 1, 10, 50))))
    other, create = token_rollup.Rollup(spark, str(tmp_path / "roll")), roll._create

    def late(batch, entry):
        assert other.commit("late", token_rollup.inserts(make(("s", "en", "v1", 1, 5, 20)))) and other.compact("other")
        return create(batch, entry)

    monkeypatch.setattr(roll, "_create", late)
    assert not roll.compact("fold")
    monkeypatch.setattr(roll, "_create", create)
    assert rows(roll.totals()) == [("s", "en", "v1", 2, 15, 70)]
    assert roll.compact("fold") and not roll.compact("fold") and rows(roll.totals()) == [("s", "en", "v1", 2, 15, 70)]
    assert not roll._create("late", {"at": "nowhere"})


def test_compaction_folds_what_it_read(spark, tmp_path, monkeypatch):
    make = lambda *r: spark.createDataFrame(list(r), token_rollup.SCHEMA)
    roll = token_rollup.Rollup(spark, str(tmp_path / "roll"))
    roll.commit("a", token_rollup.inserts(make(("s", "en", "v1", 1, 10, 50))))
    read = roll.committed

    def slow():
        monkeypatch.setattr(roll, "committed", read)
        entries = read()
        roll.commit("late", token_rollup.inserts(make(("s", "en", "v1", 1, 5, 20))))
        return entries

    monkeypatch.setattr(roll, "committed", slow)
    assert roll.compact("fold") and rows(roll.totals()) == [("s", "en", "v1", 2, 15, 70)]


def test_token_counts_cases(spark):
    got = {tuple(r) for r in token_rollup.token_counts(table(spark), queries.BYTE_BPE, "t3", ["doc_id", "n_tokens", "text", "body"]).select("doc_id", "n_tokens", "n_bytes").collect()}
    assert {(3, 0, 0), (4, 0, 0)} <= got and {r for r in got if r[0] == 7 and r[2] == len(LONG)}
    assert token_rollup.token_counts(table(spark, []), queries.BYTE_BPE, "t3", ["doc_id"]).collect() == []


def test_all_languages_are_learned(spark):
    """300 languages of one text each: all can be predicted."""
    data = [(i, " ".join(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}" for _ in range(9)), f"l{i:03}", "s", 1) for i in range(300)]
    model = lang_id.fit(table(spark, data), F.lit(True), queries.PIECES, sample_rows=5)
    assert len(model.langs) == 300


def test_samples_are_bounded(spark):
    """Rows that repeat an id or each other don't enlarge the samples."""
    data = [(1, f"text number {i % 7}", "en", "s", 1) for i in range(60)]
    rows_ = table(spark, data).select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.col("lang").alias("y"))
    assert lang_id.sample(rows_, ["i", "h"], "y", 5).count() == 5 and lang_id.sample(rows_, ["i", "h"], "y", 50).count() == 7
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_cnn, "train", lambda texts, y: seen.append(len(texts)))
        quality_cnn.fit(table(spark, data), labels, F.lit(True), sample_rows=4)
        quality_cnn.fit(table(spark, data), labels, F.lit(True), sample_bytes=30)
        quality_cnn.fit(table(spark, data), labels, F.lit(True))
    assert seen == [4, 2, 7]


def test_token_counts_whole_table(spark):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_rollup.load_ranks(queries.BYTE_BPE), special_tokens={})
    want: Counter = Counter()
    for _, text, lang, source, _ in map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").collect()):
        n = len(enc.encode_ordinary(text or ""))
        if n:
            for k, v in (("n_docs", 1), ("n_tokens", n), ("n_bytes", len((text or "").encode()))):
                want[source, lang, k] += v
    got = {(r.source, r.lang, k): r[k] for r in queries.op7_token_counts(spark, SMALL).collect() for k in token_rollup.SUMS}
    assert got == dict(want)
    counted = token_rollup.token_counts(table(spark), queries.BYTE_BPE, "t2", ["doc_id", "n_words"])
    assert {r.doc_id: r.n_tokens for r in counted.collect()}[3] == 0
