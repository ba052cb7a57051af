"""Parquet table access with explicit column lists (pruned at the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roverlake.session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    configure(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that arrived in fewer splits than the cluster has task
    slots (e.g. a file with one row group) before per-row heavy work such as
    JSON parsing. A no-op when the input is already split widely, which is
    the case for large tables; round-robin, so no key skew is introduced.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)
