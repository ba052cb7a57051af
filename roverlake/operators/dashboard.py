"""Dashboard answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.operators import status as st


def robot_list(robots: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Robot list (P11) with display flags (P10): registry ⟕ status snapshot.

    Both sides have one row per robot; AQE picks broadcast at run time when
    one side is small and a sort-merge join otherwise.
    """
    s = snapshot.select("robot_id", "status", "battery_level", "last_seen")
    return robots.join(s, "robot_id", "left").select(
        "robot_id", "name", "type", "status",
        F.col("battery_level").alias("battery"), "last_seen",
        st.is_online("status").alias("is_online"),
        st.battery_ok("battery_level").alias("battery_ok"),
    )


def robot_message_counts(telemetry: DataFrame) -> DataFrame:
    """Messages per robot; partial aggregation before any join."""
    return telemetry.groupBy("robot_id").agg(F.count(F.lit(1)).alias("messages"))


def robot_telemetry_counts(robots: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Robot 1-N telemetry (J3): every registered robot with its message count
    (0 without telemetry). Telemetry is reduced to one row per robot first,
    so a hot robot never meets the join as a third of the rows."""
    counts = robot_message_counts(telemetry)
    return robots.join(counts, "robot_id", "left").select(
        "robot_id", "name", F.coalesce("messages", F.lit(0)).cast("long").alias("messages")
    )


def orphan_telemetry(robots: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Telemetry whose robot is not registered (J3 anti join), per robot id."""
    counts = robot_message_counts(telemetry)
    return counts.join(robots.select("robot_id"), "robot_id", "left_anti")


def dashboard_stats(snapshot: DataFrame, telemetry: DataFrame, as_of) -> DataFrame:
    """Headline counters (A3-A5) as one row.

    ``robots_offline`` counts every status but 'online', as the page does.
    ``system_health`` is online / all robots (our formula; the reference
    sends a constant). Message counters come from scalar subqueries, so the
    two inputs are aggregated independently and never joined.
    """
    online = F.count_if(st.is_online("status"))
    total = F.count(F.lit(1))
    msgs = telemetry.agg(F.count(F.lit(1))).scalar()
    today = telemetry.agg(F.count_if(F.to_date("time") == F.to_date(as_of))).scalar()
    return snapshot.agg(
        total.alias("robots_total"),
        online.alias("robots_online"),
        (total - online).alias("robots_offline"),
        F.round(online / F.greatest(total, F.lit(1)), 6).alias("system_health"),
    ).select("*", msgs.alias("total_messages"), today.alias("today_messages"))


def ingest_latency(landed: DataFrame, time_col: str = "time", created_col: str = "received_at") -> DataFrame:
    """Per-robot ingest latency in milliseconds (A5 ``average_latency``; our
    formula: receive time minus message time, the two times the telemetry
    model keeps apart)."""
    ms = (F.unix_micros(F.col(created_col).cast("timestamp")) - F.unix_micros(F.col(time_col).cast("timestamp"))) / 1000.0
    return landed.groupBy("robot_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.round(F.avg(ms), 6).alias("avg_latency_ms"),
        F.max(ms).alias("max_latency_ms"),
    )
