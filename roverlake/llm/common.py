"""Small Spark helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that names none (a test on one machine) gets a private one.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, short lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path (URI) under the shared folder."""
    return os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: str, of: int):
    """crc32 of the id's text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of
