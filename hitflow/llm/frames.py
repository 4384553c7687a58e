"""Small DataFrame helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that a Python worker gets: 10 000 texts would be some 30 MB, held by the executor and its worker each.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure a checkpoint folder is set.

    The cluster names the shared folder in spark.checkpoint.dir. Where that is unset, a folder of our
    own is used on one machine (master local), and anywhere else this is an error: other machines
    would not see it. With spark.cleaner.referenceTracking.cleanCheckpoints=true Spark removes what is no longer used.
    Arrow batches are bounded by bytes, where the session does not bound them itself.
    """
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


def saved(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared checkpoint folder, and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def text_volume(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column (one scan of that column)."""
    return int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def group_count(volume: int, per_group: int = 2 << 20, least: int = 64) -> int:
    """How many groups of about `per_group` bytes hold `volume` bytes."""
    return max(least, -(-volume // per_group))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n", hot: int = 10_000, most: int = 1_000) -> DataFrame:
    """Inner join of rows with a table of one row per key (nulls are a key like others), however many rows a key has.

    `table` must be computed (saved); its column `count` is the number of rows of the key, and goes. Keys with more than `hot` rows are broadcast,
    at most `most` of them (the largest): all further keys have few rows or are few enough to matter little, and are shuffled.
    """
    first = table.where(F.col(count) > hot).orderBy(F.desc(count), *keys).limit(most)  # broadcast: bounded by `most`
    table, first = table.drop(count), F.broadcast(first.drop(count))
    named = lambda t: t.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in t.columns if c not in keys))
    same = lambda: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    gone = [f"_{k}" for k in keys]
    large = rows.join(named(first), same()).drop(*gone)
    small = rows.join(named(first).select(*gone), same(), "left_anti").join(named(table), same()).drop(*gone)
    return large.unionByName(small)
