"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Weights go down a tree of domain, language and source. At each node the budget is shared among the children in proportion to
their weights, but no child gets more than its subtree can give (its tokens times max_epochs). What a short child leaves goes
to its siblings; only when all of them are full is the node itself short, and then its own siblings have already been given
the rest, for a node's capacity is the sum of its leaves'. Shares are exact integers: sorted by capacity over weight, the full
children are a prefix, and the others split what is left by cumulative rounding.

A leaf's share is a prefix of its seeded epochs: as many whole passes as fit, then the head of one more pass in the order of
md5(seed|epoch|id). The head is found from token totals of ranges of that order; only the range in which the share ends is
put in order row by row, so a leaf with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _work

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a leaf's range that one task puts in order, about.
RANGE_ROWS = 4096


def _weight(weights: Mapping[str, int], path: Column) -> Column:
    known = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]
    return F.coalesce(F.create_map(*known)[path] if known else F.lit(None), F.lit(1)).cast("long")


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def share(children: DataFrame, parent: list[str], name: str, budget: str = "budget", cap: str = "cap", weight: str = "w") -> DataFrame:
    """Adds `share`: each child's part of its parent's budget, an integer up to its cap."""
    by = Window.partitionBy(*parent).orderBy(F.col(cap) / F.col(weight), name)
    upto, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    c = children.withColumn("_upto", F.sum(cap).over(upto)).withColumn("_after", F.coalesce(F.sum(weight).over(after), F.lit(0)))
    c = c.withColumn("_full", _wide("_upto") * _wide(weight) + _wide(cap) * _wide("_after") <= _wide(budget) * _wide(weight))
    whole = Window.partitionBy(*parent)
    c = c.withColumn("_rest", F.col(budget) - F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0)).over(whole))
    open_ = F.when(F.col("_full"), 0).otherwise(F.col(weight))
    c = c.withColumn("_w", F.sum(open_).over(whole)).withColumn("_cum", F.sum(open_).over(upto))
    c = c.withColumn("_hi", F.expr(f"(cast(_rest as decimal(18,0)) * cast(_cum as decimal(18,0))) div cast(nullif(_w, 0) as decimal(18,0))"))
    c = c.withColumn("_lo", F.expr(f"(cast(_rest as decimal(18,0)) * cast(_cum - {weight} as decimal(18,0))) div cast(nullif(_w, 0) as decimal(18,0))"))
    c = c.withColumn("share", F.when(F.col("_full"), F.col(cap)).otherwise(F.col("_hi") - F.col("_lo")))
    return c.drop("_upto", "_after", "_full", "_rest", "_w", "_cum", "_hi", "_lo")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, int], fraction_pct: int = 60, max_epochs: int = 3) -> DataFrame:
    """leaves: domain, lang, source, tokens, docs. Returns them with `share`, the tokens that each leaf is to give.

    weights: by path `domain`, `domain/lang` or `domain/lang/source`; 1 where none is given, 0 shuts a subtree. The whole
    budget is fraction_pct hundredths of all tokens there are, and never more than the tree can give.
    """
    w1, w2, w3 = (_weight(weights, F.concat_ws("/", *cols)) for cols in (["domain"], ["domain", "lang"], ["domain", "lang", "source"]))
    all_ = Window.partitionBy("root")
    t = leaves.withColumn("root", F.lit(0)).withColumn("total", F.sum("tokens").over(all_))
    t = t.withColumn("w1", w1).withColumn("w2", w2).withColumn("w3", w3).withColumn("cap3", F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("long")))
    d = t.groupBy("root", "domain").agg(F.first("total").alias("total"), F.first("w1").alias("w"), F.sum("cap3").alias("cap")).where("w > 0")
    d = d.withColumn("budget", F.least(F.expr(f"(total * {int(fraction_pct)}) div 100"), F.sum("cap").over(all_)))
    d = share(d, ["root"], "domain").select("domain", F.col("share").alias("budget"))
    g = t.groupBy("domain", "lang").agg(F.first("w2").alias("w"), F.sum("cap3").alias("cap")).where("w > 0").join(d, "domain")
    g = share(g, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    s = t.select("domain", "lang", "source", "tokens", "docs", F.col("w3").alias("w"), F.col("cap3").alias("cap")).where("w > 0").join(g, ["domain", "lang"])
    return share(s, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "docs", "share")


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, int], fraction_pct: int = 60, max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and epoch that is taken: id_col, domain, lang, source, n_tokens, epoch.

    domain: a Column over docs that names a row's domain. Null domain, lang or source count as ''. Null and empty texts have no
    tokens: they come along with their epoch, and a leaf of such texts only gives nothing. Rows that repeat an id are ordered
    together, and each counts. An empty table gives an empty result. The last document of a prefix may exceed the share.
    """
    work = _work.shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    rows = _work.settle(rows, f"{work}/rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = leaf_budgets(leaves, weights, fraction_pct, max_epochs).where("share > 0")
    plan = plan.withColumn("passes", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens"))
    plan = plan.withColumn("digits", F.greatest(F.lit(0), F.least(F.lit(8), F.ceil(F.log(16.0, F.col("docs") / RANGE_ROWS)))).cast("int"))
    plan = _work.settle(plan.select(*leaf, "passes", "rest", "digits"), f"{work}/plan")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col("passes") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    ranked = rows.join(plan, leaf).withColumn("order", order).withColumn("range", F.expr("substring(order, 1, digits)"))
    ranges = ranked.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("range_tokens"))
    before = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_tokens").over(before), F.lit(0).cast("long")))
    ranked = ranked.join(ranges, [*leaf, "range"])
    whole, edge = F.col("range_start") + F.col("range_tokens") <= F.col("rest"), (F.col("range_start") < F.col("rest")) & (F.col("range_start") + F.col("range_tokens") > F.col("rest"))
    keep = ["id", *leaf, "n_tokens", "passes"]
    within = Window.partitionBy(*leaf, "range").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranked.where(edge).withColumn("start", F.col("range_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0).cast("long")))
    ends = ends.select(*keep, (F.col("start") < F.col("rest")).alias("head"))
    rest = ranked.where(~edge).select(*keep, (whole & (F.col("rest") > 0)).alias("head"))
    taken = rest.unionByName(ends).withColumn("times", F.col("passes") + F.col("head").cast("long")).where("times > 0")
    return taken.select(F.col("id").alias(id_col), *leaf, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("epoch"))
