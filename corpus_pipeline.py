"""A training corpus from raw documents: five stages, each one operator of ``trialstats.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what stays of ``docs``, the last
one the shards. ``run`` writes every stage's result to the shared checkpoint folder and reads it for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trialstats.llm import decontamination, mixing, neardup, sharding, toxicity
from trialstats.llm.common import DOCUMENT_COLUMNS, table
from trialstats.session import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    return docs.where(toxicity.toxicity(docs, table(spark, sf_dir, "labels")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs.select(*DOCUMENT_COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs.select(*DOCUMENT_COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.op6_sharding(spark, sf_dir, docs.select(*DOCUMENT_COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: no SQL: learned scores and hashed draws; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
