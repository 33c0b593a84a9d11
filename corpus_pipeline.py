"""From raw documents to mixing rates: toxicity, near-dedup, substring dedup, decontamination, mixing.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables. All
but the last return documents with their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm import decontam, mixing, simhash, spans, toxicity
from docassay.sources.folders import scratch

SHARES = {"good": 0.9, "poor": 0.1}
LONG = 12  # sentences of more words are cut further in the substring stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spans.clean(docs, long=LONG)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def set_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("quality") > 0, "good").when(F.col("quality") == 0, "poor")
    return mixing.mix(docs, _table(spark, sf_dir, "labels"), domain, SHARES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_sentences),
    ("decontamination", drop_leaked),
    ("mixing", set_rates),
]
#: SQL does not express the trained, hashed and iterated stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
