"""The twelve observed sources and the ids they were once known by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SOURCES = (
    ("abc1", "ABC News", "https://abcnews.com/"),
    ("cbs1", "CBS News", "https://www.cbsnews.com/"),
    ("usat1", "USA Today", "https://www.usatoday.com/"),
    ("nbc1", "NBC News", "https://www.nbcnews.com/"),
    ("cnn1", "CNN", "https://www.cnn.com/"),
    ("guardian1", "The Guardian", "https://www.theguardian.com/"),
    ("ap1", "Associated Press", "https://apnews.com/"),
    ("latimes1", "Los Angeles Times", "https://www.latimes.com/"),
    ("npr1", "NPR", "https://www.npr.org/"),
    ("bbc1", "BBC", "https://www.bbc.com/"),
    ("fox1", "Fox News", "https://www.foxnews.com/"),
    ("yahoo1", "Yahoo News", "https://www.yahoo.com/news/"),
)
ALIASES = {"guardian": "guardian1", "reuters1": "guardian1", "reuters": "guardian1", "yahoo": "yahoo1", "wp1": "yahoo1", "wp": "yahoo1", "wapo": "yahoo1", "washingtonpost": "yahoo1"}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "id string, name string, home_url string")


def canonical_id(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(table[s], s)


def checked_id(c: Column) -> Column:
    """The canonical id; an unknown one is an error."""
    s = canonical_id(c)
    return F.when(s.isin(*[r[0] for r in SOURCES]), s).otherwise(F.raise_error(F.concat(F.lit("unknown source "), s)))


def with_name(df: DataFrame, col: str = "source_id") -> DataFrame:
    """Adds source_name; an unknown source goes by its id. The registry has twelve rows."""
    names = F.broadcast(sources(df.sparkSession).select(F.col("id").alias("_id"), F.col("name").alias("source_name")))
    return df.join(names, F.lower(F.col(col)) == F.col("_id"), "left").drop("_id").withColumn("source_name", F.coalesce("source_name", F.col(col)))


def guardrail(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids that are on one side only: id, missing (true: expected, not seen)."""
    s, e = seen.select("id").distinct(), expected.select("id").distinct()
    return e.join(s, "id", "left_anti").withColumn("missing", F.lit(True)).unionByName(s.join(e, "id", "left_anti").withColumn("missing", F.lit(False)))
