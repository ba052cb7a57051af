"""Queries on the time-series table.

All operators take the stored telemetry (``time, robot_id, sensor_id,
data_type, value, metadata, arrival_seq``) and return a DataFrame. Nothing is
collected: reference times such as ``as_of`` are Columns (a literal, or a
scalar subquery like ``df.agg(F.max('time')).scalar()``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.functions import json as J
from roverlake.functions.time import time_bucket
from roverlake.functions.util import as_col

HISTORY_COLUMNS = ("time", "sensor_id", "data_type", "value", "metadata")


def _ts(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else F.lit(x)


def _date_prune(df: DataFrame, start: Column, end: Column | None, partition_col: str = "event_date") -> Column:
    """Partition predicate matching a time range, for tables partitioned by
    ``event_date`` (Catalyst does not derive it from the time predicate);
    TRUE for other inputs."""
    if partition_col not in df.columns:
        return F.lit(True)
    cond = F.col(partition_col) >= F.to_date(start)
    if end is not None:
        cond = cond & (F.col(partition_col) <= F.to_date(end))
    return cond


def query_telemetry(df: DataFrame, start, end, robot_id: str | None = None, data_type: str | None = None) -> DataFrame:
    """History of one robot (or of every robot when ``robot_id`` is None)
    with ``start <= time <= end``, optionally one data type, newest first.

    An empty ``data_type`` means no type filter, as in the reference.
    Equality and range predicates reach the Parquet scan as pushed filters.
    """
    cond = F.col("time").between(_ts(start), _ts(end)) & _date_prune(df, _ts(start), _ts(end))
    if robot_id is not None:
        cond = cond & (F.col("robot_id") == F.lit(robot_id))
    if data_type:
        cond = cond & (F.col("data_type") == F.lit(data_type))
    cols = list(HISTORY_COLUMNS) + ["arrival_seq"]
    if robot_id is None:
        cols = ["robot_id"] + cols
    out = df.where(cond).select(*cols)
    order = [F.desc("time"), F.desc("arrival_seq")]
    if robot_id is None:
        order = [F.asc("robot_id")] + order
    return out.orderBy(*order)


def metric_buckets(df: DataFrame, metric_name: str, interval: str, per_robot: bool = True, on_bad: str = "null", bucket: Column | None = None) -> DataFrame:
    """avg/min/max/count of one JSON field by time bucket (and robot), of the rows that have
    it. ``bucket`` replaces the bucket's start as the grouping."""
    x = J.to_double(J.field_text("value", metric_name), on_bad)
    keys = ([F.col("robot_id")] if per_robot else []) + [(time_bucket("time", interval) if bucket is None else bucket).alias("bucket")]
    return df.where(J.has_key("value", metric_name)).groupBy(*keys).agg(
        F.avg(x).alias("avg_value"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.count(F.lit(1)).alias("data_points"),
    )


def aggregate_metrics(
    df: DataFrame,
    metric_name: str,
    interval: str = "1 hour",
    as_of=None,
    horizon: str = "24 hours",
    robot_id: str | None = None,
    on_bad: str = "null",
) -> DataFrame:
    """Time-bucketed avg/min/max/count of one numeric JSON field (A1).

    Rows qualify when the payload has the key (a JSON null counts, and is
    counted by ``data_points`` but skipped by avg/min/max) and
    ``time > as_of - horizon`` (strict). Buckets count from the reference
    origin; empty buckets are absent; newest bucket first. With
    ``robot_id=None`` every robot is rolled up in the same pass.
    Plan: filter -> partial hash aggregate -> exchange on (robot, bucket) ->
    final aggregate; no per-robot loop.
    """
    as_of = F.current_timestamp().cast("timestamp_ntz") if as_of is None else _ts(as_of)
    since = as_of - F.expr(f"INTERVAL {horizon}")
    cond = (F.col("time") > since) & _date_prune(df, since, None)
    if robot_id is not None:
        cond = cond & (F.col("robot_id") == F.lit(robot_id))
    out = metric_buckets(df.where(cond), metric_name, interval, robot_id is None, on_bad)
    order = [F.desc("bucket")] if robot_id is not None else [F.asc("robot_id"), F.desc("bucket")]
    return out.orderBy(*order)


def latest_per_robot(df: DataFrame) -> DataFrame:
    """Newest telemetry row per robot.

    ``max_by`` over ``(time, arrival_seq)`` is a partial aggregate: each map
    task keeps one row per robot before the shuffle, so a robot holding a
    third of the rows costs no more than any other.
    """
    row = F.struct(*[F.col(c) for c in ("time", "arrival_seq", "sensor_id", "data_type", "value", "metadata")])
    best = F.max_by(row, F.struct("time", "arrival_seq")).alias("r")
    return df.groupBy("robot_id").agg(best).select("robot_id", "r.*")


def load_profile(df: DataFrame, metric_name: str = "k", slot_hours: int = 4) -> DataFrame:
    """Message load by slot of the day (A9): 00, 04, ... 20."""
    slot = (F.floor(F.hour("time") / slot_hours) * slot_hours).cast("bigint").alias("slot")
    x = J.to_double(J.field_text("value", metric_name))
    return (
        df.groupBy(slot)
        .agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg(x), 6).alias("avg_value"))
        .orderBy("slot")
    )


def messages_by_weekday(df: DataFrame) -> DataFrame:
    """Message count by ISO weekday, 1 = Monday ... 7 = Sunday (A10)."""
    dow = (F.weekday("time") + 1).cast("bigint").alias("isodow")
    return df.groupBy(dow).agg(F.count(F.lit(1)).alias("messages")).orderBy("isodow")


def time_range(df: DataFrame, start, end, partition_col: str = "event_date", time_col: str = "time") -> DataFrame:
    """Time filter plus the matching partition filter, so that a table
    partitioned by ``event_date`` prunes whole folders (Catalyst does not
    derive the partition predicate from the time predicate)."""
    s, e = _ts(start), _ts(end)
    out = df.where(F.col(time_col).between(s, e))
    if partition_col in df.columns:
        out = out.where(F.col(partition_col).between(F.to_date(s), F.to_date(e)))
    return out


def as_of_max(df: DataFrame, col: str = "time") -> Column:
    """Scalar subquery: the newest time in ``df`` (evaluated once, no collect)."""
    return df.agg(F.max(as_col(col))).scalar()
