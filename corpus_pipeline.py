"""The corpus pipeline: documents in, filtered, mixed and sharded documents out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents its successor works on. ``run`` writes each result as
Parquet into the shared checkpoint folder and reads it back, so a stage starts
from files that survive the loss of executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import decontam, mixing, queries, sharding, simhash, toxicity
from feedlens.llm.common import read_table
from feedlens.session import checkpoint_dir


def detox(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; learned from the tables of ``sf_dir``."""
    scored = toxicity.score(docs, queries.toxicity_scorer(spark, sf_dir), out="_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped mix of their sources takes them."""
    mixed = mixing.mix(docs, weights=queries.MIX_WEIGHTS, max_epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED,
                       out=("_size", "_source_size", "_target", "_taken"))
    return mixing.repeated(mixed, "_size", "_taken").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard of at most ``SHARD_BYTES``."""
    return sharding.shard(docs, queries.SHARD_BYTES)


STAGES = [
    ("detox", detox),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Learned scores and SimHash components can't be told in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
