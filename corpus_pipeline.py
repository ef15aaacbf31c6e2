"""A training corpus from documents: stages that each write their result and read the one before.

Every stage but the last returns the columns of documents. Rows are dropped by a stage's decision alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.llm import decontaminate, language, mixing, sharding, similar
from stagelens.llm.common import materialize, table

#: Sets of ids up to this many (8 bytes each) are sent to all tasks; larger ones are joined by shuffle.
SENT_IDS = 1_000_000
MIN_LANGUAGE_SCORE = 0.5
NULL_ID = -(1 << 63)


def without(docs: DataFrame, key: F.Column, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in the one column of gone (nulls match)."""
    gone = materialize(gone.select(F.col(gone.columns[0]).alias("__gone")).distinct())
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key.eqNullSafe(F.col("__gone")), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no letter, no text, or no language that the network gives at least MIN_LANGUAGE_SCORE."""
    net = language.train(*language.labelled_windows(docs.filter(~language.held_out())))
    kept = language.predict(docs, net).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 on five-word shingles (SimHash candidates first), the one with the least doc_id (null first) stays.

    If doc_ids repeat, rows are told apart by a hash of (doc_id, text), which then decides who stays; equal rows are one.
    """
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) if unique else F.xxhash64("doc_id", "text")
    ids = docs.select(key.alias("id"), "text")
    labels = similar.groups(ids if unique else ids.dropDuplicates(["id"]))
    kept = without(docs, key, labels.filter("node <> label").select("node"))
    return kept if unique else kept.withColumn("__k", key).dropDuplicates(["__k"]).drop("__k")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least half of a benchmark item, whatever the order of its passages.

    If doc_ids repeat (null ones too), rows are told apart by a hash of (doc_id, text).
    """
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    key = F.col("doc_id") if unique else F.xxhash64("doc_id", "text")
    return without(docs, key, decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, ...; the mix has 1.5 times the words, no source more than twice its own."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, uniformly shuffled into 8 shards whose row counts differ by one at most."""
    return sharding.uniform_shards(docs.withColumn("__h", F.xxhash64("text")), 8, ["doc_id", "__h"]).drop("__h")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages train a network, hash and permute: SQL cannot express their rows. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
