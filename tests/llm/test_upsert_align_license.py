"""Operators 11 to 13 against brute force, and their odd inputs."""

from __future__ import annotations

import bisect
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slotwise.llm import _work, keyed_upsert, license_rules, license_scan, queries, token_align

SMALL = "/root/testdata/sf0.001"
crc = lambda x: zlib.crc32(str(x).encode())


# ---- keyed upsert


def _by_hand(clients: list[dict], changes: list[dict]) -> list[tuple]:
    size = 1 + len(clients) // 1500
    base = sorted((r for r in clients if crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [base[i : i + size] for i in range(0, len(base), size)]
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    for r in changes:
        w = best.get(r["client_id"])
        if w is None or (r["seq"], r["change_id"]) > (w["seq"], w["change_id"]):
            best[r["client_id"]] = r
    new = [{r["client_id"]: dict(r) for r in f} for f in files]
    for i, r in best.items():
        home = max(0, bisect.bisect_right(firsts, i) - 1)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        if r["op"] == "D" or crc(r["change_id"]) % 8 < h:
            new[home].pop(i, None)
        else:
            row = new[home].setdefault(i, dict.fromkeys(clients[0]) | {"client_id": i})
            row.update({c: r[c] for c in ("source", "segment", "city", "balance")})
    out: list[tuple] = []
    for before, after in zip(files, new, strict=True):
        after = [after[i] for i in sorted(after)]
        if after == before:
            out.append((before, False))
            continue
        pieces, start = -(-len(after) // size), 0
        for j in range(pieces):
            n = len(after) // pieces + (j < len(after) % pieces)
            piece, start = after[start : start + n], start + n
            if out and out[-1][1] and len(out[-1][0]) + n <= size:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    row = lambda f: (
        f[0]["client_id"], len(f), sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in f), sum(zlib.crc32("|".join(r[c] or "" for c in ("source", "segment", "city")).encode()) for r in f),
        hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), ",".join(clients[0]),
    )
    return sorted((*row(f), new) for f, new in out)


def test_upsert_of_the_whole_table_by_hand(spark):
    got = queries.op11_keyed_upsert(spark, SMALL).collect()
    want = _by_hand(pq.read_table(f"{SMALL}/clients.parquet").to_pylist(), pq.read_table(f"{SMALL}/client_changes.parquet").to_pylist())
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got) == want
    folder = os.path.dirname(got[0].path.removeprefix("file:"))
    assert {f"file:{os.path.join(folder, f)}" for f in os.listdir(folder) if f.endswith(".parquet")} == {re.sub("^file:/+", "file:/", r.path) for r in got}
    for r in got:
        ids = pq.read_table(r.path.removeprefix("file:"))["client_id"].to_pylist()
        assert ids == sorted(ids)


@pytest.mark.parametrize("ranges", [2, 8192])
def test_order_statistics(spark, monkeypatch, ranges):
    monkeypatch.setattr(keyed_upsert, "RANGES", ranges)
    rng = random.Random(ranges)
    keys = [rng.choice([-(1 << 63), (1 << 63) - 1, 0, 7, rng.randrange(-(1 << 62), 1 << 62), rng.randrange(50)]) for _ in range(500)]
    ranks = [0, 1, 17, 250, 251, 499, 500]
    assert keyed_upsert.order_statistics(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), ranks) == [sorted(keys)[r] for r in ranks[:-1]]
    assert keyed_upsert.order_statistics(spark.createDataFrame([], "k long"), [0, 5]) == []


def test_layout():
    assert keyed_upsert.layout([(10, False), (0, True), (25, True), (3, True), (1, True), (10, False), (4, True)], 10) == [9, 8, 8, 4, 4]
    assert keyed_upsert.layout([(4, True), (0, True), (6, True), (1, True)], 10) == [10, 1]
    assert keyed_upsert.layout([(0, True)], 10) == []


KINDS = "id long, home string, act string, _row double"


def _run(spark, base, changes, size=3):
    folder = _work.shared_dir(spark)
    frame = spark.createDataFrame(base, KINDS)
    files = keyed_upsert.upsert(frame, spark.createDataFrame(changes, "id long, seq long, op string, home string, _key string"), "id", ["seq"], ["home"], folder, size, lambda first: F.when(F.col("op") == "D", "delete").when(F.col("op") == "S", "set"))
    out = keyed_upsert.describe(files, frame.schema, folder, "id", {}).collect()
    rows = spark.read.schema(frame.schema).parquet(folder).collect()
    return sorted((r.first_id, r.n_rows, r.rewritten) for r in out), sorted((r.id, r.home, r.act, r._row) for r in rows)


def test_upsert_of_odd_rows(spark):
    base = [(5, "a", "x", 1.0), (None, "lost", None, None), (5, "b", "y", 2.0), (-3, None, None, None), (9, "c", "z", 3.0), (12, "d", None, None)]
    changes = [(5, 2, "S", None, "k"), (5, 2, "S", None, "k"), (5, 1, "D", "no", "k"), (None, 9, "D", None, None), (9, None, "S", "c", None), (12, 1, None, "ignored", None), (40, 1, "S", "new", None), (41, 3, "D", None, None)]
    files, rows = _run(spark, base, changes)
    assert rows == [(-3, None, None, None), (5, None, "x", 1.0), (5, None, "y", 2.0), (9, "c", "z", 3.0), (12, "d", None, None), (40, "new", None, None)]
    assert files == [(-3, 3, True), (9, 3, True)]


def test_upsert_of_empty_tables(spark):
    assert _run(spark, [], []) == ([], [])
    assert _run(spark, [], [(i, 1, "S", "n", None) for i in range(7)])[0] == [(0, 3, True), (3, 2, True), (5, 2, True)]
    assert _run(spark, [(1, "a", None, None)], [(1, 1, "D", None, None)]) == ([], [])
    assert _run(spark, [(1, "a", None, None)], []) == ([(1, 1, False)], [(1, "a", None, None)])


def test_many_changes_of_one_home_are_dealt_to_several_tasks(spark):
    base, changes = [(i, "a", None, None) for i in range(6)], [(i, 1, "S", "n", None) for i in range(4, 300)]
    files, rows = _run(spark, base, changes)
    assert [r[0] for r in rows] == list(range(300)) and sum(n for _, n, _ in files) == 300 and max(n for _, n, _ in files) == 3 and files[0] == (0, 3, False)


# ---- token alignment


def _alone(both, text: str | None) -> tuple:
    text = text or ""
    a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
    b = both.b.encode(text) if text else []
    parts = [[both.bytes[i][x] for x in ids] for i, ids in ((0, a), (1, b))]
    if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
        return 0, 0, 0, 0, "", Counter()
    ends = []
    for p in parts:
        at, sums = 0, []
        for t in p:
            at += len(t)
            sums.append(at)
        ends.append(sums)
    groups, links, i, j = [], Counter(), 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = bisect.bisect_right(ends[0], e), bisect.bisect_right(ends[1], e)
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        links.update((x, y) for x in a[i:i2] for y in b[j:j2])
        i, j = i2, j2
    return len(a), len(b), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


ODD = [
    None, "", " ", "\n", "a  b   c\n\n d", "  lead", "trail  ", "<|endoftext|> <s></s> <unk>", "日本語のテキスト です 漢字", "é ﬁ ▁x", "▁", "a b \x85 c \x1c d", "don't 's 'll x's", "12 345 6,7 8.9", "😀 👩‍👩‍👧 x‍ y", "x" * 3000 + " " + "ab" * 2000,
    "a\x00b", "İ ı ẞ ﻿q", "word " * 2000, "same same", "same same",
]


@pytest.mark.parametrize("most_common", [1 << 20, 5, 0])
def test_alignment_by_hand(spark, monkeypatch, most_common):
    monkeypatch.setattr(token_align, "LARGE_GROUP", 6)
    both = token_align._Tokenizers(queries.BYTE_BPE_JSON, queries.PIECES)
    texts = ODD + [r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs int").repartition(3)
    alone = [_alone(both, t) for t in texts]
    counts = Counter(k for x in alone for k in x[5])
    most: dict = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = [(None if i == 4 else i // 2, *x[:4], sum(n for k, n in x[5].items() if counts[k] == most[k[0]]), sum(n * counts[k] for k, n in x[5].items()), x[4]) for i, x in enumerate(alone)]
    got = token_align.align(docs, queries.BYTE_BPE_JSON, queries.PIECES, most_common=most_common).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_alignment_of_an_empty_table(spark):
    assert token_align.align(spark.createDataFrame([], "doc_id long, text string"), queries.BYTE_BPE_JSON, queries.PIECES).collect() == []


def test_parts_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 20)
    both = token_align._Tokenizers(queries.BYTE_BPE_JSON, queries.PIECES)
    rng = random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(9)) for _ in range(3)]
        assert [x[:5] for x in both.align(texts)] == [_alone(both, t)[:5] for t in texts]


# ---- licenses


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _licenses(text: str | None, rules: list) -> tuple:
    w = WORDS.findall(lower(text or ""))
    norm = " " + " ".join(w) + " "
    base = [(i, name) for p, name in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for r in rules:
        for m in re.finditer(f" (?:{r.pattern})(?= )", norm):
            first = norm[: m.start()].count(" ")
            found.append((first, first + m.group().count(" "), r.no, r.label, r.priority, r.confidence))
    before = lambda e, d: (e[0], -e[1], -e[4], e[2]) < (d[0], -d[1], -d[4], d[2])
    stay = [d for d in found if not any(e[4] >= d[4] and e[0] <= d[0] and e[1] >= d[1] and before(e, d) for e in found)]
    names = sorted({n for _, n in base})
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(names), ",".join(sorted({*names, *(d[3] for d in stay)})), max([0.5] * bool(base) + [d[5] for d in stay] + [0.0]), sorted(stay)


def _text_of(pattern: str, rng: random.Random) -> str:
    """A text that the pattern matches."""
    for a, b in ((r"\(\[\^ \]\+ \)\{\d+,\d+\}", "foo bar "), (r"\( \[\^ \]\+\)\{\d+,\d+\}", " foo"), (r"\[0-9\]\{4\}", "2024"), (r"\[0-9\]", "3"), (r"\[cs\]", "s")):
        pattern = re.sub(a, b, pattern)
    while (p := re.sub(r"\(([^()]*)\)([?*]?)", lambda m: "" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|")), pattern)) != pattern:
        pattern = p
    return rng.choice(re.sub(r"(\S)\?", lambda m: rng.choice(["", m[1]]), pattern).split("|"))


def _found(spark, texts: list, rules: list) -> list:
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    rows = sorted(license_scan.scan(docs, catalog=rules).collect(), key=lambda r: r.doc_id)
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(d) for d in r.detections]) for r in rows]


def test_every_rule_against_brute_force(spark):
    rules, rng = license_rules.rules(), random.Random(3)
    texts = ["lorem (ipsum) " + _text_of(r.pattern, rng).replace(" ", rng.choice(["-", "  "])).upper() + " dolor. The MIT License, apache license; mit license mit license" for r in rules for _ in range(4)]
    want = [_licenses(t, rules) for t in texts]
    assert _found(spark, texts, rules) == want
    assert {d[2] for w in want for d in w[7]} == {r.no for r in rules}, "each rule has a text in which it stays"


def test_licenses_of_odd_texts(spark):
    rules = license_rules.rules()
    texts = [None, "", " ", "!!", "MIT LICENSE", "mit licenſe", "K mit licenKe", "gpl " * 3000, "general public license " * 400, "mit license" * 50, "Émit license", "mit\x00license", "apache license version 2 0 only", "x" * 100_000]
    assert _found(spark, texts, rules) == [_licenses(t, rules) for t in texts]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = license_scan.scan(spark.createDataFrame([(None, "gpl"), (None, "gpl")], "doc_id long, text string")).collect()
    assert [r.labels for r in twice] == ["gpl", "gpl"]


def test_licenses_of_the_table(spark):
    rules = license_rules.rules()
    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_license_scan(spark, SMALL).collect()}
    assert got == {r["doc_id"]: _licenses(r["text"], rules)[:7] for r in rows}


def test_rules_are_well_formed():
    rules = license_rules.rules()
    assert len(rules) > 200 and [r.no for r in rules] == list(range(len(rules))) and {r.priority for r in rules} == {1, 2, 3, 4}
    assert all(0 < r.confidence <= 1 and r.keyword == r.keyword.strip().lower() for r in rules)
