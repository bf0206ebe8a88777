"""Story matching: an anchor story against observation rows, by URL, fingerprint or keywords.

Keywords match at an overlap of 2 and a similarity of 0.24 if the shorter list has at most 5 of them, else at 3 and 0.30. Every
match by keywords therefore shares at least two of them, and lists hold 12 at most, so rows and anchors meet on pairs of
keywords (66 each at most) instead of each with each. Lists are put in one order, common keywords last: the first two that lists
share must leave enough behind them in both, so pairs of common keywords seldom lead to a comparison. Rows of equal keywords are
matched once, and near copies among the anchors are counted by what they have in common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import story, text
from ..sources import registry, shared

# Fixed values.
SHORT, SHORT_OVERLAP, SHORT_SCORE, LONG_OVERLAP, LONG_SCORE = 5, 2, 0.24, 3, 0.30
#: How many of the commonest keywords stand behind all others, the commonest last; they are broadcast.
COMMON = 20_000
#: Slices of a window in which frames are made, frames for each part, and most parts.
SLICES, PART, MOST_PARTS = 10, 1_000_000, 4000


def keywords_match(a: Column, b: Column) -> Column:
    score, overlap = text.jaccard(a, b)
    return _enough(F.least(F.size(a), F.size(b)), overlap, score)


def _enough(shorter: Column, overlap: Column, score: Column) -> Column:
    return F.when(shorter <= SHORT, (overlap >= SHORT_OVERLAP) & (score >= SHORT_SCORE)).otherwise((overlap >= LONG_OVERLAP) & (score >= LONG_SCORE))


def matches_cluster(row: dict[str, Column], anchor: dict[str, Column]) -> Column:
    """Canonical URL, fingerprint or keywords; for one anchor against many rows."""
    same = lambda k: (F.coalesce(anchor[k], F.lit("")) != "") & (F.coalesce(row[k], F.lit("")) == anchor[k])
    return F.coalesce(same("canonical_url"), F.lit(False)) | F.coalesce(same("fingerprint"), F.lit(False)) | F.coalesce(keywords_match(row["keywords"], anchor["keywords"]), F.lit(False))


def _kid(k: str) -> Column:
    """16 bytes that stand for a class of equal keywords."""
    return F.unhex(F.md5(F.col(k).cast("binary")))


def _ordered(classes: DataFrame) -> DataFrame:
    """kid and words: hashes of each class's distinct keywords, rare ones first, ties by hash."""
    each = classes.select("kid", F.explode(F.array_distinct("keywords")).alias("w"))
    common = each.groupBy("w").agg(F.count("*").alias("f")).orderBy(F.desc("f"), "w").limit(COMMON)
    ranked = each.join(F.broadcast(common), "w", "left")  # COMMON rows
    words = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.xxhash64("w").alias("h"))))
    return ranked.groupBy("kid").agg(F.transform(words, lambda x: x["h"]).alias("words"))


def _pairs(lists: DataFrame, key: str, *more: str) -> DataFrame:
    """key, size, and for each two words of a list: their hash (pair), their places i < j, the words before the second but the first of the two (early), how many stand behind them (behind), and whether they may be the first two of a match (lead)."""
    each = lists.where(F.size("words") >= 2).withColumn("j", F.explode(F.sequence(F.lit(2), F.size("words"))))
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("j") - 1)))
    word = lambda n: F.element_at("words", F.col(n))
    early = F.array_remove(F.slice("words", F.lit(1), F.col("j") - 1), word("i"))
    # Lists of nine and more match at an overlap of three at least, so their last word is none of the first two.
    lead = (F.col("j") < F.size("words")) | (F.col("size") < 9)
    return each.select(key, "size", F.xxhash64(word("i"), word("j")).alias("pair"), "i", "j", early.alias("early"), (F.size("words") - F.col("j")).alias("behind"), lead.alias("lead"), *more)


def _cores(anchors: DataFrame) -> DataFrame:
    """anchors (kid, keywords, words, size) with core, a part of their keywords, words cut to it, and all_words.

    A list joins the cluster of that pair of its words that most lists have. Where words that a sixteenth of a cluster's lists have make up half of all its words, as in a group of
    near copies or of texts that begin with one passage, those are the core (at most 192 words); a list's other words are its extras. Elsewhere all words are core.
    """
    pairs = _pairs(anchors, "kid").select("kid", "pair")
    often = pairs.groupBy("pair").agg(F.count("*").alias("f"))
    chosen = pairs.join(often, "pair").groupBy("kid").agg(F.max_by("pair", F.struct("f", "pair")).alias("cluster"))
    own = anchors.join(chosen, "kid", "left")
    df = own.where("cluster is not null").select("cluster", F.explode("words").alias("w")).groupBy("cluster", "w").agg(F.count("*").alias("f"))
    sizes = own.groupBy("cluster").agg(F.count("*").alias("m"))
    marked = df.join(sizes, "cluster").withColumn("often", F.col("f") * 16 >= F.col("m"))
    tight = F.sum(F.when(F.col("often"), F.col("f"))) * 2 >= F.sum("f")
    cores = marked.groupBy("cluster").agg(F.collect_list(F.when(F.col("often"), F.col("w"))).alias("core_words"), tight.alias("tight"), F.bool_and("often").alias("whole")).where("tight and not whole").drop("tight", "whole")
    out = own.join(cores, "cluster", "left")
    cut = lambda words, of: F.when(F.col("core_words").isNull(), words).otherwise(F.filter(words, lambda w: F.array_contains("core_words", of(w))))
    return out.select("kid", "keywords", "size", cut(F.col("keywords"), F.xxhash64).alias("core"), cut(F.col("words"), lambda h: h).alias("words"), F.col("words").alias("all_words"))


def similar(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """rows (id, keywords) against anchors (id, keywords): for each row that matches any anchor but itself: id, n_anchors, best_anchor (most similar, then smallest id), best_score.

    Matches are counted by groups. Anchors of equal core (see `_cores`) and size are one bucket; a row that shares no extra word with an anchor overlaps it as it does the bucket's
    core, so a bucket counts at once for all its anchors. For anchors that do share an extra word with the row, few and found by pairs of words that hold one, the difference is made good.
    The best anchor is right too: what a bucket's core gives is never more than an anchor's own similarity, and equal where no extra word is shared.
    Lists meet on the first two words that they share, so each row and bucket meet once. Hashes choose who meets; the keywords decide. Keywords are written once to the shared folder.
    """
    key = F.array_join(F.array_sort("keywords"), " ")
    joined = lambda d, name: shared.settle(d.select("id", F.array_distinct("keywords").alias("keywords")), name).select("id", "keywords", key.alias("k")).where("k <> ''").withColumn("kid", _kid("k"))
    r, a = joined(rows, "rows"), joined(anchors, "anchors")
    classes = r.select("kid", "keywords", F.lit(0).alias("side")).unionByName(a.select("kid", "keywords", F.lit(1).alias("side")))
    classes = shared.settle(classes.groupBy("kid").agg(F.first("keywords").alias("keywords"), (F.min("side") == 0).alias("is_row"), (F.max("side") == 1).alias("is_anchor")), "classes")
    lists = shared.settle(_ordered(classes).join(classes, "kid").withColumn("size", F.size("words")), "lists")
    row_lists = lists.where("is_row").select("kid", F.col("keywords").alias("ka"), F.col("size").alias("sa"))

    # Anchors by class, then by bucket: how many, the smallest id and the next.
    firsts = a.groupBy("kid").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    second = a.join(firsts.select("kid", "lo"), "kid").where("id > lo").groupBy("kid").agg(F.min("id").alias("second"))
    cored = _cores(lists.where("is_anchor")).withColumn("bid", F.unhex(F.md5(F.concat_ws(",", F.array_join(F.array_sort("core"), " "), F.col("size").cast("string")).cast("binary"))))
    cored = shared.settle(cored.join(firsts, "kid").join(second, "kid", "left"), "cored")
    buckets = cored.groupBy("bid").agg(F.first("core").alias("core"), F.first("words").alias("words"), F.first("size").alias("size"), F.sum("n").alias("n"), F.min("lo").alias("lo"))
    after = cored.select("bid", F.col("lo").alias("l"), "second").join(buckets.select("bid", "lo"), "bid").groupBy("bid").agg(F.min(F.when(F.col("l") == F.col("lo"), F.col("second")).otherwise(F.col("l"))).alias("second"))
    buckets = shared.settle(buckets.join(after, "bid"), "buckets")

    right = shared.settle(_pairs(buckets, "bid").where("lead").select("pair", "bid", F.col("size").alias("sb"), F.col("behind").alias("bb"), F.col("early").alias("eb")), "bucket-pairs")
    extra = _pairs(cored.where(F.size("words") < F.size("all_words")).select("kid", "size", F.col("words").alias("core_words"), F.col("all_words").alias("words")), "kid", "words", "core_words")
    is_extra = lambda n: ~F.array_contains("core_words", F.element_at("words", F.col(n)))
    extra = extra.withColumns({"x1": is_extra("i"), "x2": is_extra("j")}).where("x1 or x2")
    extra = extra.select("pair", F.col("kid").alias("kkid"), F.col("i").alias("ib"), F.col("early").alias("eb"), F.array_except("early", "core_words").alias("xb"), "x1")
    extra = shared.settle(extra, "extra-pairs")
    # Of the rows' pairs only those go on that an anchor may have.
    pairs = shared.settle(shared.possible(_pairs(lists.where("is_row"), "kid"), F.col("pair"), right.select("pair").unionByName(extra.select("pair")).distinct()), "pairs")
    left = pairs.where("lead").select("pair", "kid", F.col("size").alias("sa"), F.col("behind").alias("ba"), F.col("early").alias("ea"))
    most = F.least("ba", "bb") + 2
    hopeful = _enough(F.least("sa", "sb"), most, most / (F.col("sa") + F.col("sb") - most)) & ~F.arrays_overlap("ea", "eb")
    enough = lambda ov, sb: _enough(F.least(F.col("sa"), sb), ov, ov / (F.col("sa") + sb - ov))
    score = lambda ov, sb: F.round(ov / (F.col("sa") + sb - ov), 9)
    met = left.join(right, "pair").where(hopeful).select("kid", "bid").join(row_lists, "kid").join(buckets.select("bid", "core", F.col("size").alias("sb"), "n", "lo", "second"), "bid")
    met = met.withColumn("ov", F.size(F.array_intersect("ka", "core"))).where(enough(F.col("ov"), F.col("sb")))
    met = met.select("kid", "bid", F.lit(None).cast("binary").alias("kkid"), F.lit(1).alias("sign"), "n", "lo", "second", score(F.col("ov"), F.col("sb")).alias("score"))

    # Rows and anchors that share an extra word and another.
    # Each row and anchor meet once: on the first extra word that they share and the first other word.
    apart = lambda x, y: ~F.arrays_overlap(x, y)
    before = apart(F.slice("early", F.lit(1), F.col("i") - 1), F.slice("eb", F.lit(1), F.col("ib") - 1))
    once = before & F.when(F.col("x1"), apart("early", "eb")).otherwise(apart("early", "xb"))
    more = pairs.select("pair", "kid", "i", "early").join(extra, "pair").where(once).select("kid", "kkid").join(row_lists, "kid")
    more = more.join(cored.select(F.col("kid").alias("kkid"), "bid", F.col("keywords").alias("kb"), "core", F.col("size").alias("sb"), "n", "lo", "second"), "kkid")
    more = more.withColumn("ov", F.size(F.array_intersect("ka", "kb"))).withColumn("was", F.size(F.array_intersect("ka", "core"))).where(enough(F.col("ov"), F.col("sb")))
    more = more.select("kid", "bid", "kkid", F.when(enough(F.col("was"), F.col("sb")), 0).otherwise(1).alias("sign"), "n", "lo", "second", score(F.col("ov"), F.col("sb")).alias("score"))

    # A row that is an anchor too is not its own match: one less in its own bucket and its own class.
    found = met.unionByName(more)
    ids = a.join(cored.select("kid", F.col("bid").alias("own_bid")), "kid").select("id", "own_bid")
    out = r.select("id", "kid").join(ids, "id", "left").join(found, "kid")
    own = F.col("own_bid").isNotNull() & F.when(F.col("kkid").isNull(), F.col("bid") == F.col("own_bid")).otherwise(F.col("kkid") == F.col("kid"))
    others = F.col("n") - F.when(own, 1).otherwise(0)
    best = F.when(own & (F.col("lo") == F.col("id")), F.col("second")).otherwise(F.col("lo"))
    out = out.withColumn("m", others).where("m > 0").withColumn("best", best)
    out = out.groupBy("id").agg(F.sum(F.col("m") * F.col("sign")).alias("n_anchors"), F.max_by("best", F.struct("score", -F.col("best"))).alias("best_anchor"), F.max("score").alias("best_score"))
    return out


def moments(events: DataFrame, anchors: DataFrame, lookback_minutes: int, forward_minutes: int) -> DataFrame:
    """Frames of many anchor stories at once: for each row of anchors (anchor_id, observed_at, title, url) the rows of events (id, observed_at, source_id, slot_key, title, url) in lead and
    ranked slots, from lookback before it to forward behind it, that match its story: anchor_id, t0, id, observed_at, source_id, slot_key, title, url, rank, source_name.

    Stories are matched first, frames made last: rows of equal URL, fingerprint and keywords are one class, and classes meet by time bucket and canonical URL, bucket and fingerprint, or bucket
    and the first two keywords that they share. A bucket is as long as the whole window, so an anchor lies in two at most and an event in one. Events and anchors of classes that match then
    meet once, in slices of a bucket, and exact bounds decide; no frame is shuffled or compared with another. Their number is that of the matches itself, the product of both sides in a busy
    hour. Events or anchors without a time match nothing; rows that repeat as a whole give one frame.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    back, ahead = lookback_minutes * 60_000_000, forward_minutes * 60_000_000
    step = -(-max(back + ahead, 60_000_000) // SLICES)
    own = ["id", "observed_at", "source_id", "slot_key", "title", "url"]
    piece, bucket = lambda c: F.floor(c / step), lambda c: F.floor(c / SLICES)
    facts = lambda d: d.withColumn("x", F.explode(F.array(story.story(F.col("url"), F.col("title"))))).withColumns({"cu": F.coalesce("x.canonical_url", F.lit("")), "fp": F.col("x.fingerprint"), "kw": F.array_distinct(F.coalesce("x.keywords", F.array().cast("array<string>")))}).drop("x").withColumn("kid", _kid_of("kw")).withColumn("cid", F.unhex(F.md5(F.to_json(F.struct("cu", "fp", F.hex("kid"))).cast("binary"))))
    an = facts(anchors.select("anchor_id", F.col("observed_at").alias("t0"), "title", "url").withColumn("at", micros("t0")).where("at is not null")).drop("title", "url")
    an = shared.settle(an.withColumns({"s0": piece(F.col("at") - back), "s1": piece(F.col("at") + ahead)}), "moment-anchors")
    first, last = an.agg(F.min("at"), F.max("at")).first()
    slots = events.where((F.col("slot_key") == "hero:1") | F.col("slot_key").rlike(story.SLOT_TOP)).select(*own).withColumn("t", micros("observed_at"))
    # Only events that some anchor's window may hold are read into stories.
    slots = slots.where(F.col("t").between(first - back, last + ahead)) if first is not None else slots.where("false")
    ev = registry.with_name(slots.distinct().withColumn("rank", story.slot_rank(F.col("slot_key"))))
    ev = shared.settle(facts(ev).withColumn("s", piece(F.col("t"))).withColumn("b", bucket(F.col("s"))), "moment-events")

    # Classes of the events and of the anchors by bucket, and which of them match.
    facets = ["b", "cid", "cu", "fp", "kid"]
    by_bucket = an.withColumn("b", F.explode(F.sequence(bucket(F.col("s0")), bucket(F.col("s1")))))
    ec = shared.settle(ev.groupBy(facets).agg(F.count("*").alias("n")), "moment-classes")
    ac = shared.settle(by_bucket.select(facets).distinct(), "moment-classes")
    keys = F.explode(F.filter(F.array(F.concat(F.lit("u"), F.nullif("cu", F.lit(""))), F.concat(F.lit("f"), "fp")), lambda k: k.isNotNull())).alias("key")
    same = ec.select("b", "cid", keys).join(ac.select("b", F.col("cid").alias("acid"), keys), ["b", "key"]).select("b", "cid", "acid")

    lists = ev.select("kid", "kw").unionByName(an.select("kid", "kw")).groupBy("kid").agg(F.first("kw").alias("keywords"))
    lists = shared.settle(_ordered(lists).join(lists, "kid").withColumn("size", F.size("words")), "moment-lists")
    pairs = shared.settle(_pairs(lists, "kid").where("lead").select("kid", "size", "pair", "behind", "early"), "moment-pairs")
    side = lambda d, x: d.select("b", "kid").distinct().join(pairs, "kid").select("b", "pair", F.col("kid").alias(f"kid{x}"), F.col("size").alias(f"s{x}"), F.col("behind").alias(f"b{x}"), F.col("early").alias(f"e{x}"))
    most = F.least("ba", "bb") + 2
    hopeful = _enough(F.least("sa", "sb"), most, most / (F.col("sa") + F.col("sb") - most)) & ~F.arrays_overlap("ea", "eb")
    words = lambda x: lists.select(F.col("kid").alias(f"kid{x}"), F.col("keywords").alias(f"k{x}"))
    met = side(ec, "a").join(side(ac, "b"), ["b", "pair"]).where(hopeful).select("b", "kida", "kidb").join(words("a"), "kida").join(words("b"), "kidb").where(keywords_match(F.col("ka"), F.col("kb"))).select("b", "kida", "kidb")
    alike = met.join(ec.select("b", F.col("kid").alias("kida"), "cid"), ["b", "kida"]).join(ac.select("b", F.col("kid").alias("kidb"), F.col("cid").alias("acid")), ["b", "kidb"]).select("b", "cid", "acid")
    met = same.unionByName(alike).distinct()

    # An anchor whose id and time come with several stories is one anchor still: its classes together are its group.
    groups = an.groupBy("anchor_id", "t0", "at", "s0", "s1").agg(F.array_sort(F.collect_set("cid")).alias("cids"))
    groups = shared.settle(groups.withColumn("gid", F.unhex(F.md5(F.array_join(F.transform("cids", F.hex), ",").cast("binary")))), "moment-groups")
    members = groups.withColumn("b", F.explode(F.sequence(bucket(F.col("s0")), bucket(F.col("s1"))))).groupBy("b", "gid").agg(F.first("cids").alias("cids"), F.count("*").alias("m"))
    met = shared.settle(met.join(members.select("b", "gid", "m", F.explode("cids").alias("acid")), ["b", "acid"]).groupBy("b", "cid", "gid").agg(F.first("m").alias("m")), "moment-met")
    # One part for a million frames that may be, so that none is a task of its own.
    frames = met.join(ec.groupBy("b", "cid").agg(F.sum("n").alias("n")), ["b", "cid"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, math.ceil(frames / PART)))
    left = ev.join(met.select("b", "cid", "gid"), ["b", "cid"]).select("s", "gid", "t", *own, "rank", "source_name").repartition(parts, "s", "gid")
    right = groups.select("anchor_id", "t0", "at", "gid", F.explode(F.sequence("s0", "s1")).alias("s")).repartition(parts, "s", "gid")
    frames = left.join(right, ["s", "gid"]).where(F.col("t").between(F.col("at") - back, F.col("at") + ahead))
    return frames.select("anchor_id", "t0", *own, "rank", "source_name")


def _kid_of(keywords: str) -> Column:
    return F.unhex(F.md5(F.array_join(F.array_sort(keywords), " ").cast("binary")))
