"""Metric roll-up on a stream (A1 as a watermarked window aggregate, append mode).

A window is sent once, when the watermark has passed its end. Rows that come later than
that are dropped by the aggregate, though the ingest job stores every accepted row; so
the stored rows settle what the stream has sent: ``settled`` gives each window as it
was sent, those still open when the input ends (the final flush), and how many rows
came too late for theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.functions.time import time_window
from roverlake.operators.telemetry import metric_buckets

VALUES = ("avg_value", "min_value", "max_value", "data_points")
CLOSED, LATE, OPEN = "closed", "late", "open"


def rollup_stream(telemetry: DataFrame, metric_name: str, interval: str, watermark: str, on_bad: str = "null") -> DataFrame:
    """robot_id, bucket and the values of each window, once it is complete. ``watermark``
    says how late rows may come; widths in months have no fixed end and are refused."""
    rows = telemetry.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", watermark)
    windows = metric_buckets(rows, metric_name, interval, on_bad=on_bad, bucket=time_window("time", interval))
    return windows.withColumn("bucket", F.col("bucket.start"))


def settled(sent: DataFrame, stored: DataFrame, metric_name: str, interval: str, on_bad: str = "null") -> DataFrame:
    """Every window of the stored rows: its values, ``state`` and ``late_rows``.

    ``closed``: as the stream sent it, nothing missing. ``late``: as sent, without
    ``late_rows`` rows that came after it. ``open``: not sent yet; the values so far.
    """
    full = metric_buckets(stored.withColumn("time", F.col("time").cast("timestamp")), metric_name, interval, on_bad=on_bad)
    keys = ["robot_id", "bucket"]
    was = sent.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*VALUES).alias("_sent"))
    joined = full.join(was, full["robot_id"].eqNullSafe(was["_robot_id"]) & (full["bucket"] == was["_bucket"]), "left")
    missing = F.col("data_points") - F.col("_sent.data_points")
    out = F.col("_sent").isNotNull()
    return joined.select(
        *keys, *[F.when(out, F.col("_sent")[v]).otherwise(F.col(v)).alias(v) for v in VALUES],
        F.when(~out, OPEN).when(missing > 0, LATE).otherwise(CLOSED).alias("state"),
        F.when(out, missing).otherwise(0).cast("long").alias("late_rows"))


def late_counts(windows: DataFrame) -> DataFrame:
    """The side table: windows that rows came too late for, with their number."""
    return windows.where(F.col("late_rows") > 0).select("robot_id", "bucket", "late_rows")
