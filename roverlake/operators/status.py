"""Robot status table.

The reference upserts one row per status message ("last arrival wins",
whole-row replace). Here the table is a snapshot rebuilt from status rows
(and the previous snapshot, when there is one) with one ``max_by`` per robot:
a partial aggregate, so a robot that sends a third of all messages is folded
to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.functions import json as J
from roverlake.functions.exact_json import object_fields
from roverlake.sources.keyed_table import KeyedTable

# ---------------------------------------------------------------------------
# Status defaults and battery bands.
#   absent status -> "unknown"; absent location -> {} ; online status "online"
#   bands (lower bound inclusive): >=80 excellent, >=60 good, >=40 fair,
#   >=20 low, else critical
# ---------------------------------------------------------------------------
DEFAULT_STATUS = "unknown"
ONLINE = "online"
OFFLINE = "offline"
BATTERY_BANDS = ((80, "excellent"), (60, "good"), (40, "fair"), (20, "low"))
BATTERY_FLOOR_BAND = "critical"
LOW_BATTERY_OK_ABOVE = 20

SNAPSHOT_COLUMNS = ("robot_id", "last_seen", "status", "battery_level", "location", "active_mission", "arrival_seq")


def status_rows(df: DataFrame, data_col: str = "data", time_col: str = "time") -> DataFrame:
    """One candidate status row per status message.

    Absent ``status`` -> 'unknown', absent ``location`` -> '{}'; a missing
    battery or mission is NULL and *overwrites* an older value (the upsert
    replaces the whole row).
    """
    d = F.col("_d")
    battery = d["battery_level"]
    return df.withColumn("_d", object_fields(data_col, ("status", "battery_level", "location", "active_mission"))).select(
        F.col("robot_id"),
        F.col(time_col).alias("last_seen"),
        F.when(d["status"]["kind"].isNotNull(), _shown(d["status"])).otherwise(F.lit(DEFAULT_STATUS)).alias("status"),
        J.to_double(_shown(battery)).alias("battery_level"),
        F.coalesce(d["location"]["json"], F.lit("{}")).alias("location"),
        _shown(d["active_mission"]).alias("active_mission"),
        F.col("arrival_seq"),
    )


def _shown(field: Column) -> Column:
    """A decoded field as text: strings as they are, other values as written; null is NULL."""
    return F.when(field["kind"].isin("object", "array"), field["json"]).otherwise(field["text"])


def upsert_status(rows: DataFrame, previous: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Fold status rows (and an optional previous snapshot) to one row per robot.

    ``order='arrival'`` keeps the last arrival, as the reference does (a late,
    older message moves ``last_seen`` back); ``order='event_time'`` keeps the
    newest ``last_seen`` (ties by arrival).
    """
    cand = rows.select(*SNAPSHOT_COLUMNS)
    if previous is not None:
        cand = previous.select(*SNAPSHOT_COLUMNS).unionByName(cand)
    if order == "arrival":
        key: Column = F.col("arrival_seq")
    elif order == "event_time":
        key = F.struct("last_seen", "arrival_seq")
    else:
        raise ValueError("order must be 'arrival' or 'event_time'")
    row = F.struct(*[F.col(c) for c in SNAPSHOT_COLUMNS[1:]])
    return cand.groupBy("robot_id").agg(F.max_by(row, key).alias("s")).select("robot_id", "s.*")


def status_table(path: str, order: str = "arrival", **options) -> KeyedTable:
    """The status table that micro-batches update (S6, R5), in either order of W2."""
    orders = {"arrival": ("arrival_seq",), "event_time": ("last_seen", "arrival_seq")}
    if order not in orders:
        raise ValueError("order must be 'arrival' or 'event_time'")
    return KeyedTable(path, "robot_id", SNAPSHOT_COLUMNS, orders[order], **options)


def is_online(status: Column | str = "status") -> Column:
    """IsOnline (P9)."""
    return F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit("")) == ONLINE


def set_online(df: DataFrame, as_of) -> DataFrame:
    """SetOnline: status online and last_seen = as_of."""
    return df.withColumns({"status": F.lit(ONLINE), "last_seen": as_of})


def set_offline(df: DataFrame) -> DataFrame:
    """SetOffline: status offline; last_seen unchanged."""
    return df.withColumn("status", F.lit(OFFLINE))


def battery_status(battery: Column | str = "battery_level") -> Column:
    """GetBatteryStatus bands (F12); NULL battery gives NULL."""
    b = F.col(battery) if isinstance(battery, str) else battery
    expr = None
    for bound, name in BATTERY_BANDS:
        expr = F.when(b >= bound, F.lit(name)) if expr is None else expr.when(b >= bound, F.lit(name))
    return F.when(b.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(BATTERY_FLOOR_BAND)))


def battery_ok(battery: Column | str = "battery_level") -> Column:
    """Display flag of the dashboard (P10): above 20 is fine, 20 itself is low."""
    b = F.col(battery) if isinstance(battery, str) else battery
    return b > LOW_BATTERY_OK_ABOVE
