"""The corpus pipeline against the same stages in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import corpus_pipeline as p
import numpy as np
from conftest import MEDIUM
from test_llm import CASES, brute_near, table

from slotwise.llm import quality_cnn, queries


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    # quality: the same network, learned and applied by itself
    net = quality_cnn.fit(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"), queries.fold("doc_id", 5) != 0)
    score = quality_cnn.score([(r[1] or "").encode() for r in rows], net)
    want = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    good = [r for r in rows if labels.get(r[0]) == 1 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([r in want for r in good]) > 0.95
    df = step(spark, p.quality, docs, tmp_path / "0")
    assert ids(df) == sorted(r[0] for r in want) and df.columns == docs.columns

    keep = {}
    for r in want:
        body = (r[1] or "").encode().lower()
        keep[body] = max(keep.get(body, r[0]), r[0])
    want = [r for r in want if keep[(r[1] or "").encode().lower()] == r[0]]
    df = step(spark, p.exact, df, tmp_path / "1")
    assert ids(df) == sorted(r[0] for r in want) and df.columns == docs.columns

    kept = {d for d, _, _, k in brute_near(want, 5) if k}
    want = [r for r in want if r[0] in kept]
    df = step(spark, p.near, df, tmp_path / "2")
    assert ids(df) == sorted(kept) and df.columns == docs.columns

    grams = set()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect():
        w = word.findall(r.text.translate(lower))
        n = min(13, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    sizes = {len(g) for g in grams}

    def clean(text):
        w = word.findall((text or "").translate(lower))
        hit = np.zeros(len(w), bool)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit[i : i + n] = True
        return not (hit.any() and 20 * hit.sum() >= len(w))

    want = [r for r in want if clean(r[1])]
    df = step(spark, p.benchmark, df, tmp_path / "3")
    assert sorted((r.doc_id, hashlib.sha1((r.text or "").encode()).hexdigest()) for r in df.collect()) == sorted((r[0], hashlib.sha1((r[1] or "").encode()).hexdigest()) for r in want)

    df = step(spark, p.mixture, df, tmp_path / "4")
    assert set(ids(df)) <= {r[0] for r in want} and df.count() > 0


def step(spark, stage, docs, path):
    stage(spark, docs, MEDIUM).write.parquet(str(path))
    return spark.read.parquet(str(path))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_odd_rows(spark):
    df = table(spark)
    for stage in (p.exact, p.near, p.benchmark):
        out = stage(spark, df, MEDIUM)
        assert out.columns == df.columns
    got = [r.doc_id for r in p.exact(spark, df, MEDIUM).collect()]
    assert sorted(got, key=str) == sorted([2, 4, 5, 6, 7, 8, None, 9, 10, 11, 12, 13], key=str)
    near = [r.doc_id for r in p.near(spark, df, MEDIUM).collect()]
    assert sorted(near, key=str) == sorted((d for d, _, _, k in brute_near(CASES, 5) if k), key=str)
    assert p.mixture(spark, df.drop("domain", "epoch"), MEDIUM).count() > 0
    assert p.exact(spark, table(spark, []), MEDIUM).collect() == []
    assert p.near(spark, df.limit(0), MEDIUM).collect() == []


def test_exact_stage_tells_rows_by_id_and_text(spark):
    """Null ids that copy a row with one, ids with two texts, and null ids only."""
    data = [(None, "One text"), (5, "one TEXT"), (7, "only here"), (7, "Shared"), (9, "shared"), (9, "last"), (9, "last"), (None, "shared"), (None, "nulls"), (None, "nulls")]
    got = [(r.doc_id, r.text) for r in p.exact(spark, table(spark, [(i, t, "en", "src0", 1) for i, t in data]), MEDIUM).collect()]
    assert sorted(got, key=str) == sorted([(5, "one TEXT"), (7, "only here"), (9, "shared"), (9, "last"), (None, "nulls"), (None, "nulls")], key=str)


def test_stages_take_any_column_name(spark):
    """Columns named as the stages name theirs within."""
    from pyspark.sql import functions as F

    names = ("_at", "_chunk", "_bits", "__many", "_maybe", "v_sha", "v_maybe", "v_n", "v_one", "c0", "c1", "order", "range")
    df = spark.createDataFrame([r for r in CASES if r[0] not in (7, 8)], "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        df = df.withColumn(n, F.lit(f"own {n}"))
    for stage in (p.quality, p.exact, p.near, p.benchmark):
        out = stage(spark, df, MEDIUM)
        assert out.columns == df.columns and {tuple(r)[5:] for r in out.collect()} <= {tuple(f"own {n}" for n in names)}
    assert p.mixture(spark, df, MEDIUM).count() > 0


def test_stages_are_registered():
    assert [n for n, _ in p.STAGES] == ["quality", "exact", "near", "benchmark", "mixture"]
