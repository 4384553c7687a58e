"""A corpus pipeline: five stages, each calling one operator, from raw documents to shards.

Stages decide row by row, by a row's own text: rows with null or repeated ids are rows like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hitflow.llm import decontaminate, minhash_dedup, mixing, shards, toxicity
from hitflow.llm.frames import prepare
from hitflow.llm.registry import QUALITY_MIX, TOXIC_CHAIN, chain_labels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain's toxicity model rejects go."""
    model = toxicity.fit_chain(docs, chain_labels(_table(spark, sf_dir, "labels")), TOXIC_CHAIN)
    return toxicity.without(docs, model, "toxic")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8), the row with the smallest id stays."""
    return minhash_dedup.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin poor-quality documents until good ones hold their target share of tokens; rates stay at or below 1,
    so no document repeats and documents that are surely good all stay."""
    return mixing.resampled(docs, _table(spark, sf_dir, "labels"), QUALITY_MIX, "quality", max_rate=1.0)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of near-equal bytes."""
    return shards.with_law(shards.shard(docs, 40))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_quality),
    ("sharding", shard_documents),
]

#: Fitted models and component searches are beyond SQL; tests/llm/test_pipeline.py holds each stage against planted rows and brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next.

    A stage's files go once the next stage is written; those of the last but one stay, as the result reads them.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before.rpartition("/")[0])
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
