"""Corpus pipeline over `documents`: quality, exact copies, near copies, benchmark passages, mixture.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the next stage's
docs. All but the last return rows of documents with all their columns; the last returns the mixture, a row for each document
and epoch that is taken.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import _sieve, _work, decontam, exact_index, hyperminhash, mixing, quality_cnn
from slotwise.llm.queries import FRACTION_PCT, MAX_EPOCHS, SEED, WEIGHTS, domain, fold


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go. The network learns from labelled rows outside the held-out fold."""
    _work.small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs, labels, fold("doc_id", 5) != 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat its doc_id too, one. Groups of null ids only stay. A row is told by its doc_id, null too, and its text."""
    _work.small_batches(spark)
    work = _work.shared_dir(spark)
    result = _work.settle(exact_index.exact_dedup(docs).where("group_size > 1 and keep_id is not null"), f"{work}/exact")
    verdict = result.groupBy(F.col("doc_id").alias("v_id"), F.col("text_sha256").alias("v_text")).agg(F.max("kept").alias("v_kept"), F.count("*").alias("v_n"))
    key = lambda i: F.xxhash64(F.coalesce(i.cast("string"), F.lit("")))
    # Columns go by their place, so that none clashes with a name used here.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (F.col(plain[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = own.cast("long")
    flagged = _sieve.flag(docs.toDF(*plain), key(own), verdict.select(key(F.col("v_id")).alias("v_key")), "v_maybe")
    normal = F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    met = flagged.where("v_maybe").withColumn("v_sha", normal).join(verdict, own.eqNullSafe(F.col("v_id")) & (F.col("v_sha") == F.col("v_text")), "left").where("coalesce(v_kept, true)")
    met = _work.settle(met.withColumn("v_one", own).drop("v_maybe", "v_id", "v_text", "v_kept"), f"{work}/met")
    once, many = met.where("coalesce(v_n, 1) = 1"), met.where("v_n > 1").dropDuplicates(["v_one", "v_sha"])
    return flagged.where("not v_maybe").select(*plain).unionByName(once.select(*plain)).unionByName(many.select(*plain)).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their five-word shingles, or are linked by such, the document with the smallest id stays. Null ids stay."""
    _work.small_batches(spark)
    work = _work.shared_dir(spark)
    gone = _work.settle(hyperminhash.near_dedup(docs).where("not kept").select("doc_id"), f"{work}/gone")
    return _sieve.without(docs, "doc_id", gone)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go; the others stay as they are."""
    _work.small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, domain(), WEIGHTS, FRACTION_PCT, MAX_EPOCHS, SEED)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]

#: The quality network can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = _work.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = _work.settle(stage(spark, docs, sf_dir), f"{work}/{i}-{name}")
        if i:
            _work.drop(spark, f"{work}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
