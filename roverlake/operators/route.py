"""Routing of accepted envelopes to the sinks.

One parsed batch feeds every sink: callers persist it once (see
``streaming.ingest``) and each function below is a narrow projection or
filter of it. Only the object view (last write per key) shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake import schemas as S
from roverlake.functions.time import iso_format

ROUTE_TIMESERIES = "timeseries"
ROUTE_BLOB = "blob"
ROUTE_FORWARD_ONLY = "forward_only"


def route_of(dtype_col: str = "data_type"):
    d = F.col(dtype_col)
    return (
        F.when(d.isin(*S.TIMESERIES_TYPES), F.lit(ROUTE_TIMESERIES))
        .when(d.isin(*S.BLOB_TYPES), F.lit(ROUTE_BLOB))
        .otherwise(F.lit(ROUTE_FORWARD_ONLY))
    )


def timeseries_rows(acc: DataFrame) -> DataFrame:
    """Rows of the time-series table (S3): types telemetry, imu, odometry, status."""
    return acc.where(F.col("data_type").isin(*S.TIMESERIES_TYPES)).select(
        F.col("ts").cast("timestamp_ntz").alias("time"),
        "robot_id", "sensor_id", "data_type",
        F.col("data").alias("value"), "metadata", "arrival_seq",
    )


def blob_rows(acc: DataFrame) -> DataFrame:
    """Object writes (S4): bucket by type, key ``robot/isoformat(ts)/sensor``,
    payload = the data JSON as UTF-8 bytes, length = its byte length."""
    d = acc.where(F.col("data_type").isin(*S.BLOB_TYPES))
    bucket = F.when(F.col("data_type") == "sensor_image", F.lit(S.BLOB_BUCKETS["sensor_image"])) \
        .otherwise(F.lit(S.BLOB_BUCKETS["point_cloud"]))
    name = F.concat_ws(
        "/", F.coalesce(F.col("robot_id"), F.lit("None")),
        iso_format(F.col("ts").cast("timestamp_ntz")), F.coalesce(F.col("sensor_id"), F.lit("None")),
    )
    payload = F.encode(F.col("data"), "UTF-8")
    return d.select(
        bucket.alias("bucket"), name.alias("object_name"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("length"), "metadata", "arrival_seq",
    )


def object_view(blobs: DataFrame) -> DataFrame:
    """Current objects: a later write to the same key replaces the earlier one.

    ``max_by`` aggregates partially per map task; a hot key costs one row
    per task before the shuffle.
    """
    latest = F.max_by(F.struct("payload", "length", "metadata", "arrival_seq"), F.col("arrival_seq"))
    return blobs.groupBy("bucket", "object_name").agg(latest.alias("o")).select("bucket", "object_name", "o.*")


def topic_rows(acc: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Forwarded records (S5): every accepted type goes to ``processed-<type>``
    with the *raw* message as value."""
    return acc.select(
        F.concat(F.lit(S.TOPIC_PREFIX), F.col("data_type")).alias("topic"),
        F.col(raw_col).alias("value"), "arrival_seq",
    )


def processed_by_type(acc: DataFrame) -> DataFrame:
    """Processed counter per data type (A2)."""
    return acc.groupBy("data_type").agg(F.count(F.lit(1)).alias("processed"))


def route_counts(parsed: DataFrame) -> DataFrame:
    """Messages per outcome: rejected, or the route of an accepted type."""
    outcome = F.when(F.col("reject_reason").isNotNull(), F.lit("rejected")).otherwise(route_of())
    return parsed.groupBy(outcome.alias("route")).agg(F.count(F.lit(1)).alias("messages"))
