"""From raw documents to training shards: rate, thin out copies, decontaminate, mix, shard.

Defined cases: null and empty texts are rated like any text, are copies of each other, have no words to cut or to mix
(a source of such texts only takes nothing, in others they are taken by their place); null ids go by their text;
repeated rows are copies; columns beside those of ``documents`` travel along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.llm import decontaminate, mixing, nearcopies, quality, sharding
from clusterloom.sources.storage import shared_dir, stored


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def thin_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id: op6's fingerprints link them, and minimum
    hashes those of like texts that two bits miss; links are checked exactly (five-word Jaccard 0.8 or more)."""
    return nearcopies.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every benchmark passage cut out."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blend(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents read back through the committed manifest, with the shard that holds each.

    The added column is ``shard``, with underscores before it where the documents have such a column."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    store = sharding.shard_documents(docs, shared_dir(spark))
    return store.read().withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


STAGES = [("quality", rate), ("near_duplicates", thin_out), ("decontamination", clean), ("mixing", blend), ("sharding", shard)]

#: No SQL: the learned model and the fingerprints' hash have no form in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
