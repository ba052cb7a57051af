"""Row shapes, closed value sets and length rules of the fleet tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Data types accepted on the telemetry stream (closed, case-sensitive set):
#   telemetry, sensor_image, point_cloud, imu, odometry, diagnostics, command, status
# Types written to the time-series table: telemetry, imu, odometry, status
# Types written to the object store: sensor_image -> bucket robot-images,
#   point_cloud -> bucket point-clouds
# Column limits: robot_id 50, sensor_id 50, data_type 30 (time series);
#   status 20, active_mission 100 (status table)
# Robot status values: online, offline, error, charging, maintenance
# Forwarded topic name: "processed-" followed by the data type
# ---------------------------------------------------------------------------
DATA_TYPES = ("telemetry", "sensor_image", "point_cloud", "imu", "odometry", "diagnostics", "command", "status")
TIMESERIES_TYPES = ("telemetry", "imu", "odometry", "status")
BLOB_BUCKETS = {"sensor_image": "robot-images", "point_cloud": "point-clouds"}
BLOB_TYPES = tuple(BLOB_BUCKETS)
MAX_LEN_ROBOT_ID = 50
MAX_LEN_SENSOR_ID = 50
MAX_LEN_DATA_TYPE = 30
MAX_LEN_STATUS = 20
MAX_LEN_MISSION = 100
ROBOT_STATUSES = ("online", "offline", "error", "charging", "maintenance")
TOPIC_PREFIX = "processed-"

# Raw message as it arrives from a topic or landing folder. ``arrival_seq`` is
# any sortable value: a long for topics and replays, a struct (batch, row) or
# (landed_at, file, row) for landing folders.
RAW_MESSAGE = T.StructType([
    T.StructField("raw", T.StringType()),
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("received_at", T.TimestampType()),
])

# Parsed envelope (the reference's SensorData); data/metadata stay JSON text.
SENSOR_DATA = T.StructType([
    T.StructField("robot_id", T.StringType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("data", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

# Time-series table, partitioned by event_date and sorted by robot_id, time.
ROBOT_TELEMETRY = T.StructType([
    T.StructField("time", T.TimestampType(), False),
    T.StructField("robot_id", T.StringType(), False),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("arrival_seq", T.LongType()),
])

ROBOT_STATUS = T.StructType([
    T.StructField("robot_id", T.StringType(), False),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("battery_level", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("active_mission", T.StringType()),
])

POSITION = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z")])

RESOURCES = T.StructType([
    T.StructField("cpu_cores", T.IntegerType()),
    T.StructField("memory_gb", T.DoubleType()),
    T.StructField("gpu_memory_gb", T.DoubleType()),
    T.StructField("disk_gb", T.DoubleType()),
    T.StructField("cpu_usage", T.DoubleType()),
    T.StructField("memory_usage", T.DoubleType()),
])

# Edge controller event log: one row per register / heartbeat / deploy request.
EDGE_EVENT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("cpu", T.DoubleType()),
    T.StructField("mem", T.DoubleType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("version", T.StringType()),
])

BLOB = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("object_name", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("length", T.LongType()),
    T.StructField("metadata", T.StringType()),
])
