"""License detection by ordered signature rules, in DataFrame functions only.

A text becomes its lower-cased words with one space between them. Rules are gated twice: a text without any of a few stems is not
looked at, and a rule's pattern runs only where its keyword stands. Places are kept as counts of words between and within matches, so texts leave the
first pass and only numbers go on. A detection gives way to one that contains it, has the same priority or a higher one, and, if both
have the same place and priority, comes first; a running maximum of ends, in order of starts, tells that without comparing pairs.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _work
from .license_rules import Rule, rules

#: The contract's phrases and their labels: always reported, whatever the rules say.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that stand in too many texts to tell anything.
COMMON = frozenset("a and are as by for in is it no not of on or shall that the this to under use used with without you all any be copy software terms open source must may".split())
PRIORITIES = (1, 2, 3, 4)


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def gate(catalog: list[Rule]) -> dict[str, str]:
    """A word for each keyword, as few different ones as taking the word of most keywords again and again gives; a text without that word is spared the keyword."""
    left, out = {r.keyword for r in catalog}, {}
    while left:
        words = sorted({w for k in left for w in k.split(" ") if w not in COMMON} or {w for k in left for w in k.split(" ")})
        best = max(words, key=lambda w: sum(f" {w} " in f" {k} " for k in left))
        out |= {k: best for k in left if f" {best} " in f" {k} "}
        left -= out.keys()
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: list[Rule] | None = None) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null is the empty text. n_base are the places of BASE's phrases, first_word and last_word the smallest and largest
    word at which one starts (null if none), base_labels their labels. detections are the rules' places that stay, in order of place: label, rule, priority, confidence, first word and the word after the last. labels
    are the base labels and the detections', distinct, sorted and joined by commas. score is the highest confidence of what stays, 0.5 for a base phrase, 0 without either. Rows that repeat an id stay
    apart, ids may be null, an empty table gives an empty result, and other columns are ignored.
    """
    catalog = rules() if catalog is None else catalog
    work = _work.shared_dir(docs.sparkSession)
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))

    # Base phrases.
    base = " (?:" + "|".join(BASE) + ")(?= )"
    pieces = F.when(F.col("norm").contains(" license "), F.split("norm", base, -1))
    rows = rows.withColumn("between", F.when(F.size(pieces) > 1, pieces))
    last = F.element_at("between", -1)
    n_words = F.when(F.length("norm") > 2, _spaces(F.col("norm")) - 1).otherwise(F.lit(0).cast("long"))
    last_match = F.element_at(F.regexp_extract_all("norm", F.lit(base), F.lit(0)), -1)
    last_word = n_words - (_spaces(last) - 1) - _spaces(last_match)
    labels = [F.when(F.col("norm").contains(f" {p} "), F.lit(name)) for p, name in sorted(BASE.items(), key=lambda x: x[1])]

    # Rules: those whose keyword stands in the text, then their matches as (words before, words within).
    by_word = gate(catalog)
    keywords = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(f" {k} ").alias("keyword")) for k, w in sorted(by_word.items())])
    table = F.array(*[F.struct(F.lit(r.no).alias("no"), F.lit(f" {r.keyword} ").alias("keyword"), F.lit(f" (?:{r.pattern})(?= )").alias("pattern")) for r in catalog])
    gates = F.array_intersect(F.array(*[F.lit(w) for w in sorted(set(by_word.values()))]), F.split("norm", " "))
    standing = F.transform(F.filter(keywords, lambda k: F.array_contains(F.col("gates"), k["word"]) & F.col("norm").contains(k["keyword"])), lambda k: k["keyword"])
    tried = F.transform(F.filter(table, lambda r: F.array_contains(F.col("standing"), r["keyword"])), lambda r: F.struct(r["no"].alias("no"), r["pattern"].alias("pattern"), F.split(F.col("norm"), r["pattern"], -1).alias("between")))
    counts = lambda texts: F.transform(texts, _spaces)
    found = F.transform(F.filter(tried, lambda t: F.size(t["between"]) > 1), lambda t: F.struct(t["no"].alias("no"), counts(t["between"]).alias("before"), counts(F.regexp_extract_all(F.col("norm"), t["pattern"], F.lit(0))).alias("within")))
    rows = rows.withColumn("gates", gates).withColumn("standing", F.when(F.size("gates") > 0, standing))
    rows = rows.select(
        "row", "id", n_words.alias("n_words"), F.coalesce(F.size("between") - 1, F.lit(0)).cast("long").alias("n_base"), _spaces(F.element_at("between", 1)).alias("first_word"), F.when(F.col("between").isNotNull(), last_word).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"), F.when(F.size("standing") > 0, found).alias("found"),
    )
    rows = _work.settle(rows, f"{work}/rows")

    # Detections as rows; only documents that have some.
    one = rows.where("found is not null").select("row", F.explode("found").alias("m")).select("row", F.col("m.no").alias("rule"), F.posexplode(F.arrays_zip(F.slice("m.before", 1, F.size("m.within")).alias("before"), F.col("m.within").alias("within"))).alias("i", "x"))
    so_far = _window("row", "rule").orderBy("i").rowsBetween(_first(), 0)
    first = (F.sum("x.before").over(so_far) + F.sum("x.within").over(so_far) - F.col("x.within")).alias("first")
    one = one.select("row", "rule", first, F.col("x.within").alias("n")).withColumn("after", F.col("first") + F.col("n")).drop("n")
    facts = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in sorted(catalog)])
    numbers = {r.no: i for i, r in enumerate(sorted(catalog))}
    assert numbers == {r.no: r.no for r in catalog}, "rules are numbered from 0"
    one = one.withColumn("fact", F.get(facts, F.col("rule"))).select("row", "rule", "first", "after", "fact.*")
    before = _window("row").orderBy("first", F.desc("after"), F.desc("priority"), "rule").rowsBetween(_first(), -1)
    for p in PRIORITIES:
        one = one.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("after"))).over(before))
    over = F.lit(None)
    for p in PRIORITIES:
        over = F.when(F.col("priority") == p, F.col(f"reach{p}")).otherwise(over)
    stays = one.where(F.coalesce(over < F.col("after"), F.lit(True)))
    each = stays.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "after", "rule", "label", "priority", "confidence"))).alias("detections"))
    out = rows.drop("found").join(each, "row", "left")
    detections = F.coalesce("detections", F.array().cast(each.schema["detections"].dataType))
    named = F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.transform(detections, lambda d: d["label"])))), ",")
    sure = F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform(detections, lambda d: d["confidence"])), F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), named.alias("labels"), sure.alias("score"), detections.alias("detections"))


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _first() -> int:
    from pyspark.sql import Window

    return Window.unboundedPreceding
