"""Cleaning of a document corpus in five stages: quality, near copies, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.llm import bpe, contamination, near, private, quality
from flowvigil.llm.queries import table, tokenizer
from flowvigil.session import materialise, scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (4): rows that they reject go, each by its own text."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (2): of each group of near copies the row with the smallest id stays (null ids last, then any one).

    Rows are told apart by a key of their own, so rows that share an id or have none are documents each.
    """
    named = _keyed(spark, docs)
    ids = named.select("key", named[f"c{docs.columns.index('doc_id')}"].alias("doc_id"))
    groups = near.near_groups(named.select(F.col("key").alias("doc_id"), named[f"c{docs.columns.index('text')}"].alias("text")))
    copies = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
    members = materialise(copies.union(copies.select("component", "component").distinct()))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = members.join(ids, "key").groupBy("component").agg(F.min(order)["key"].alias("key"))
    gone = members.join(stay.select("key"), "key", "left_anti").select("key")
    return named.join(gone, "key", "left_anti").drop("key").toDF(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): rows that hold a test item go, each by its own text."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"), materialise)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (5): personal data is replaced by its kind; n_chars follows the new text."""
    out = private.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*(f"`{c}`" for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (9): doc_id, the token ids and their number."""
    encoded = bpe.encode(docs, *tokenizer())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with columns c0, c1, ... and a unique ``key`` for each row, written once so that every read has the same keys."""
    path = scratch_path(spark, "keyed")
    docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("key", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


STAGES = [("quality_rules", keep_good), ("near_dedup", keep_one_of_each), ("decontamination", keep_uncontaminated),
          ("private_data", mask_private), ("byte_bpe", encode)]

# Trees, MinHash and tokens are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
