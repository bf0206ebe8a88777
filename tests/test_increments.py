"""What comes in parts gives what comes at once: moments, streams, ingest by days, change capture."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slotwise.functions import story
from slotwise.operators import diff, history, matching
from slotwise.plans import ingest
from slotwise.sources import sinks
from slotwise.streaming import changes, streams

START = datetime(2026, 2, 1)
ITEMS = "source_id string, run_id string, observed_at timestamp_ntz, rank long, title string, url string, fingerprint string"


def rows_of(df) -> list:
    return sorted((str(tuple(r)) for r in df.collect()))


def test_similar_counts_by_groups(spark):
    """Near copies, texts that begin with one passage, short lists and strangers."""
    rng, words = random.Random(1), [f"w{i}" for i in range(300)]
    lists: list = [None, [], ["w1"], ["w1", "w2"], ["w1", "w1", "w2"]]
    for i in range(240):
        k = list(words[:12])
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            k[rng.randrange(12)] = rng.choice(words)
        lists.append(list(dict.fromkeys(k))[: rng.choice([12, 12, 4, 6])])
        lists.append(words[40:47] + rng.sample(words[100:], 5))
        lists.append(rng.sample(words[:60], rng.randrange(12)))
    lists += lists[5:25]
    anchors = range(0, len(lists), 4)

    def match(a, b):
        a, b = set(a or ()), set(b or ())
        ov, score = len(a & b), len(a & b) / (len(a | b) or 1)
        return (ov >= 2 and score >= 0.24 if min(len(a), len(b)) <= 5 else ov >= 3 and score >= 0.30), round(score, 9)

    want = {}
    for i, a in enumerate(lists):
        hits = [(s, -j) for j in anchors if j != i for ok, s in [match(a, lists[j])] if ok]
        if hits:
            want[i] = (len(hits), -max(hits)[1], max(hits)[0])
    df = spark.createDataFrame(list(enumerate(lists)), "id long, keywords array<string>")
    got = matching.similar(df, df.where("id % 4 = 0")).collect()
    assert {r.id: (r.n_anchors, r.best_anchor, r.best_score) for r in got} == want
    cored = matching._cores(matching._ordered(df.where("size(keywords) > 1").select(F.col("id").alias("kid"), "keywords")).join(df.select(F.col("id").alias("kid"), "keywords"), "kid").withColumn("size", F.size("words")))
    assert cored.where(F.size("words") < F.size("all_words")).count() > 200


def test_moments_of_many_anchors(spark):
    rng = random.Random(2)
    nouns = "storm coast flood senate budget vote rocket launch court ruling market crash dealing border talk".split()
    rows = [
        (i, START + timedelta(minutes=rng.randrange(900), seconds=rng.randrange(60)), rng.choice(["cnn1", "bbc1", "zz"]), rng.choice(["hero:1", "top10:3", "other", None]), rng.choice([None, "", " ".join(rng.sample(nouns, rng.randrange(1, 7)))]), rng.choice([None, f"https://x/{rng.randrange(6)}/?utm_source=q", f"https://y/{i}"]))
        for i in range(160)
    ]
    rows += [(500, None, "cnn1", "hero:1", "Storm coast", None), rows[3], rows[4]]
    events = spark.createDataFrame(rows, "id long, observed_at timestamp_ntz, source_id string, slot_key string, title string, url string")
    anchors = events.where("id % 3 = 0 or id = 500").distinct().withColumnRenamed("id", "anchor_id")
    own = {k: F.col(f"s.{k}") for k in ("canonical_url", "fingerprint", "keywords")}
    other = {k: F.col(f"z.{k}") for k in own}
    a = anchors.select("anchor_id", F.col("observed_at").alias("t0"), story.story(F.col("url"), F.col("title")).alias("z"))
    e = events.where("slot_key in ('hero:1', 'top10:3')").distinct().withColumn("s", story.story(F.col("url"), F.col("title")))
    want = e.crossJoin(a).where("observed_at between t0 - interval 90 minutes and t0 + interval 20 minutes").where(matching.matches_cluster(own, other)).select("anchor_id", "t0", "id", "observed_at", "source_id", "slot_key", "title", "url")
    got = matching.moments(events, anchors, 90, 20)
    assert rows_of(got.select(*want.columns)) == rows_of(want) and want.count() > 50
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()
    assert matching.moments(events.limit(0), anchors, 90, 20).count() == 0 == matching.moments(events, anchors.limit(0), 90, 20).count()


def test_frames_of_moments_are_made_once(spark):
    """Frames come out of the last join as they are: none is compared with another. An anchor that comes with two stories gives each frame once."""
    rows = [(i, START + timedelta(minutes=i), "cnn1", "hero:1", "Storm coast flood", f"https://x/{i % 2}") for i in range(6)]
    events = spark.createDataFrame([*rows, rows[2]], "id long, observed_at timestamp_ntz, source_id string, slot_key string, title string, url string")
    anchors = events.where("id = 3").withColumnRenamed("id", "anchor_id")
    anchors = anchors.unionByName(anchors.withColumns({"url": F.lit("https://x/0"), "title": F.lit("Storm coast")}))
    got = matching.moments(events, anchors, 60, 1)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]


def made_items(seed: int, days: int = 4) -> list:
    rng, out = random.Random(seed), []
    for source in ("abc1", "cnn1"):
        for n in range(days * 3):
            at = START + timedelta(hours=8 * n, minutes=rng.randrange(300))
            if rng.random() < 0.2:
                continue
            run = f"{source}-{at:%d%H%M}"
            keys = rng.sample("abcdefg", rng.randrange(1, 5))
            out += [(source, run, at, r, rng.choice([None, "", f"T{k}", f"T{k} new"]), f"https://x/{k}", k) for r, k in enumerate([*keys, keys[0]][: rng.randrange(1, 6)], 1)]
            if rng.random() < 0.3:
                out.append((source, run, at, None, None, None, None))
    out.append(("abc1", "abc1-empty", START + timedelta(days=1, minutes=1), None, None, None, None))
    return out


def test_stream_of_snapshots_out_of_order_and_restarted(spark, tmp_path):
    """Rows of a run come in several micro-batches, runs in any order, and the query starts three times on one checkpoint."""
    rows = made_items(3)
    rng = random.Random(4)
    by_day: dict = {}
    for r in rows:
        by_day.setdefault(r[2].date(), []).append(r)
    parts: list = []
    for day in sorted(by_day):
        rng.shuffle(by_day[day])
        half = len(by_day[day]) // 2
        parts += [by_day[day][:half], by_day[day][half:] + by_day[day][:2]]
    parts.append([("tick", "t", START + timedelta(days=30), None, None, None, None)])
    late = [("abc1", "late", START, 1, "Too late", "https://x/z", "z")]
    stream = lambda: changes.snapshot_diff(spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")), watermark="26 hours")
    got, n = None, 0
    for group in (parts[:3], parts[3:], [late, parts[-1]]):
        for p in group:
            spark.createDataFrame(p, ITEMS).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03}"))
            n += 1
        got = streams.run_to_files(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    want = diff.snapshot_diff(spark.createDataFrame(rows, ITEMS))
    plain = lambda d: rows_of(d.where("source_id <> 'tick'").select(*[F.col("observed_at").cast("timestamp_ntz") if c == "observed_at" else c for c in want.columns]))
    assert plain(got) == plain(want) and len(plain(want)) > 40


def test_ingest_in_parts_is_ingest_at_once(spark, tmp_path):
    """Pages of several days in any order, late ones and repeated ones among them, leave the tables that one run leaves."""
    items = spark.createDataFrame(made_items(5, 3), ITEMS).where("rank is not null").withColumns({"related_links": F.array().cast("array<string>"), "id": F.concat_ws("|", "run_id", F.col("rank").cast("string")), "day": F.to_date("observed_at")})
    seen = items.groupBy("source_id", "run_id", "observed_at", "day").agg(F.min_by("title", "rank").alias("title"), F.min_by("url", "rank").alias("url"))
    seen = seen.select(F.col("run_id").alias("id"), "run_id", "source_id", "observed_at", F.lit("hero:1").alias("slot_key"), "title", "url", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("raw"), "day")
    runs = [r.run_id for r in seen.orderBy("run_id").collect()]
    random.Random(6).shuffle(runs)
    cut = len(runs) // 3
    for i, part in enumerate((runs, runs[:cut], runs[cut : 2 * cut], runs[2 * cut :] + runs[:3])):
        ingest.take(seen.where(F.col("run_id").isin(part)), items.where(F.col("run_id").isin(part)), str(tmp_path / ("parts" if i else "whole")))
    for name in ("attempts", "events", "items", "runs", "changes"):
        whole, parts = (spark.read.parquet(str(tmp_path / at / name)) for at in ("whole", "parts"))
        assert rows_of(parts.select(*whole.columns)) == rows_of(whole) and whole.count() > 0, name
    one = ingest.stored(spark, str(tmp_path / "parts/items"), items.schema, [START.date()])
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString() and {r.day for r in one.collect()} == {START.date()}


OBS = "id long, source_id string, observed_at timestamp_ntz, title string, url string, ok boolean, error string"
at = lambda h: START + timedelta(hours=h)


def test_history_keeps_rows_without_source_or_time(spark):
    rows = [(1, "a", at(0), "A", "u", True, None), (2, None, at(1), "B", "v", True, None), (3, None, at(30), "B", "v", True, None), (4, "a", None, "C", "w", True, None), (5, None, None, "D", "x", True, None)]
    obs = spark.createDataFrame(rows, OBS)
    assert sorted(r.id for r in history.changed_only(obs, ["title", "url"]).collect()) == [1, 2, 4, 5]
    assert sorted((r.source_id or "", r.island, r.url, r.seen_count) for r in history.islands(obs, ["url"]).collect()) == [("", 1, "x", 1), ("", 2, "v", 2), ("a", 1, "w", 1), ("a", 2, "u", 1)]


def test_late_and_blank_rows_are_compared_with_their_stored_neighbours(spark, tmp_path):
    path = str(tmp_path / "runs")
    put = lambda *rows: sinks.append_changed(spark.createDataFrame(rows, OBS), path)
    put((1, "a", at(10), "A", "u", True, None), (2, "a", at(12), "B", "u", True, None))
    put((3, "a", at(11), "A", "u", True, None), (4, None, at(11), "N", "n", True, None), (5, "a", None, "T", "t", True, None))
    put((6, "a", at(13), "B", "u", True, None), (7, "a", at(11) + timedelta(minutes=5), "C", "u", True, None), (8, None, at(12), "N", "n", True, ""))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 4, 5, 7]


def test_diff_events_name_both_runs(spark):
    rows = [("a", "r1", at(0), 1, "T", "u", "k"), ("a", "r2", at(1), 2, "T", "u", "k")]
    got = sinks.diff_events(diff.snapshot_diff(spark.createDataFrame(rows, ITEMS))).collect()
    assert sorted((r.event_type, r.from_run_id, r.run_id) for r in got) == [("ENTER", None, "r1"), ("MOVE", "r1", "r2")]


def test_attempts_say_how_they_went(spark):
    """The bag of an attempt holds what the reliability queries ask for; columns that pages lack are null, broken values too."""
    import json

    from slotwise.functions import text

    front = "<head><meta property='og:title' content='The page itself has a long title'><link rel='canonical' href='https://www.npr.org/2024/01/05/{}/a-story'></head>"
    rows = [
        (1, "npr1", "https://www.npr.org/", front.format(1), START, "https://www.npr.org/home", "200", "1500", "News"), (2, "npr1", "https://www.npr.org/", "<p>nothing</p>", START + timedelta(hours=1), None, "403", "x", None),
        (3, "npr1", "https://www.npr.org/", None, START + timedelta(hours=2), "https://www.npr.org/consent?next=1", None, "700", "Are you a robot? captcha"), (4, "npr1", "https://www.npr.org/", front.format(4), None, None, None, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, source_id string, url string, html string, observed_at timestamp, final_url string, http_status string, duration_ms string, page_title string")
    seen = ingest.observations(pages)
    bags = {json.loads(r.raw)["final_url"] + str(r.observed_at): json.loads(r.raw) for r in seen.collect()}
    got = {k: (b.get("http_status"), b.get("duration_ms"), b["blocked"], b.get("blocked_reason"), b["has_item"], b["profile"]) for k, b in bags.items()}
    assert got == {
        f"https://www.npr.org/home{START}": (200, 1500, False, None, True, "desktop"),
        f"https://www.npr.org/{START + timedelta(hours=1)}": (403, None, True, "http_403", False, "desktop"),
        f"https://www.npr.org/consent?next=1{START + timedelta(hours=2)}": (None, 700, True, "captcha", False, "desktop"),
        "https://www.npr.org/None": (None, None, False, None, True, "desktop"),
    }
    assert next(r for r, _ in text.BLOCKS) == "captcha"
    # The documented queries on stored attempts: blocked rate, and average duration of those that say one.
    bag = lambda k: F.get_json_object("raw", f"$.{k}")
    r = seen.agg(F.avg(F.coalesce(bag("blocked").try_cast("boolean"), F.lit(False)).cast("int")), F.avg(bag("duration_ms").try_cast("double"))).first()
    assert tuple(r) == (0.5, 1100.0)
    bare = ingest.observations(pages.select("page_id", "source_id", "url", "html", "observed_at"))
    assert {json.loads(r.raw)["final_url"] for r in bare.collect()} == {"https://www.npr.org/"} and bare.columns == seen.columns
