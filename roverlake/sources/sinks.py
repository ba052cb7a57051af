"""Sink writers (S3, S4, S5, S9; the status table is ``sources.keyed_table``).

Each writer takes the rows produced by ``operators.route`` / ``operators.status``
and a target path; with a ``batch_id`` the path gets a ``batch=<id>``
component and is overwritten, so a repeated micro-batch rewrites the same
files instead of adding duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _target(path: str, batch_id: int | None, part: str = "batch") -> str:
    return path if batch_id is None else f"{path.rstrip('/')}/{part}={batch_id}"


def write_timeseries(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Time-series table (S3, S9): partitioned by ``event_date`` (then by ``batch`` for
    stream writes). Rows are ranged and sorted by date, robot and time, with the
    partition columns first (the writer would otherwise sort again by them alone), so
    that Parquet min/max statistics act as the ``(robot_id, time)`` index of the
    reference: files and row groups hold narrow ranges of robots, and a busy
    robot spreads over several. A stream batch overwrites only its own
    ``(event_date, batch)`` partitions, so a repeated batch replaces its files."""
    out = rows.withColumn("event_date", F.to_date("time"))
    ranged = out.repartitionByRange("event_date", "robot_id", "time")
    if batch_id is None:
        ranged.sortWithinPartitions("event_date", "robot_id", "time").write.mode("overwrite").partitionBy("event_date").parquet(path)
        return
    (ranged.withColumn("batch", F.lit(batch_id).cast("long")).sortWithinPartitions("event_date", "batch", "robot_id", "time")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "batch").parquet(path))


def write_objects(blobs: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Object writes (S4), partitioned by bucket; readers keep the last write per key."""
    blobs.write.mode("overwrite").partitionBy("bucket").parquet(_target(path, batch_id))


def write_topics_files(topic_rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Forwarded records (S5) as files, one folder per topic."""
    topic_rows.write.mode("overwrite").partitionBy("topic").parquet(_target(path, batch_id))


def write_topics_kafka(topic_rows: DataFrame, brokers: str, compression: str = "gzip") -> None:
    """Forwarded records (S5) to Kafka: the per-row ``topic`` column selects the
    topic, ``value`` is the raw message. Needs the Spark Kafka connector."""
    (topic_rows.select("topic", F.col("value").cast("string").alias("value"))
     .write.format("kafka")
     .option("kafka.bootstrap.servers", brokers)
     .option("kafka.compression.type", compression)
     .save())


def write_rejects(rejects: DataFrame, path: str, batch_id: int | None = None) -> None:
    rejects.write.mode("overwrite").parquet(_target(path, batch_id))
