"""Envelope parsing and validation.

A raw message is accepted or rejected as a whole (``reject_reason`` is NULL
for accepted rows). Each message is decoded once, byte-exactly
(``functions.exact_json``): of a repeated key the last value counts, NaN and
numbers of any length are read, trailing text is refused, and ``data`` and
``metadata`` are slices of the message. All rules are column expressions on
the decoded fields.

Defaults follow the reference's ``dict.get(key, default)``: an *absent* key
takes the default, an explicit JSON null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake import schemas as S
from roverlake.functions.exact_json import MALFORMED, OBJECT, object_fields
from roverlake.functions.time import parse_iso

# ---------------------------------------------------------------------------
# Defaults of absent envelope keys.
#   sensor_id -> "unknown", data_type -> "telemetry", data -> {}, metadata -> {}
# Reject reasons (ours), checked in this order:
#   malformed_json, not_object, bad_data_type, bad_timestamp,
#   not_storable (a stored value that a JSON column cannot hold),
#   missing_robot_id, robot_id_too_long, sensor_id_too_long,
#   bad_status_payload, status_too_long, mission_too_long, bad_battery_level
# ---------------------------------------------------------------------------
DEFAULT_SENSOR_ID = "unknown"
DEFAULT_DATA_TYPE = "telemetry"


def parse_envelope(
    df: DataFrame, raw_col: str = "raw", received_col: str | None = None, robot_col: str | None = None
) -> DataFrame:
    """Adds ``robot_id, sensor_id, data_type, ts, data, metadata,
    reject_reason`` to a DataFrame of raw JSON messages.

    ``received_col`` (optional) is the receive time used when a body has no
    ``timestamp`` (the HTTP path); the stream path requires a timestamp.
    ``robot_col`` (optional) supplies the robot id from outside the body
    (the URL path of the HTTP route).
    """
    staged = df.withColumn("_m", object_fields(raw_col, FIELDS))
    m = F.col("_m")

    def present(key: str) -> Column:
        # absent key -> SQL NULL; a JSON null is of kind null
        return m[key]["kind"].isNotNull()

    def string(key: str) -> Column:
        return F.when(m[key]["kind"] == "string", m[key]["text"])

    data_type = F.when(~present("data_type"), F.lit(DEFAULT_DATA_TYPE)).when(string("data_type").isin(*S.DATA_TYPES), string("data_type"))
    ts = parse_iso(string("timestamp"))
    if received_col is not None:
        ts = F.when(present("timestamp"), ts).otherwise(F.col(received_col).cast("timestamp"))

    def json_or_default(key: str, default: str) -> Column:
        # the slice of the message (a JSON null is the text null)
        return F.when(present(key), m[key]["json"]).otherwise(F.lit(default))

    parsed = staged.withColumns({
        "robot_id": F.col(robot_col) if robot_col else m["robot_id"]["text"],
        "sensor_id": F.when(present("sensor_id"), m["sensor_id"]["text"]).otherwise(F.lit(DEFAULT_SENSOR_ID)),
        "data_type": data_type,
        "ts": ts,
        "data": json_or_default("data", "{}"),
        "metadata": json_or_default("metadata", "{}"),
        "_state": m["state"],
        "_storable": F.coalesce(m["data"]["storable"], F.lit(True)) & F.coalesce(m["metadata"]["storable"], F.lit(True)),
    })
    return with_reject_reason(parsed.drop("_m")).drop("_state", "_storable")


FIELDS = ("robot_id", "sensor_id", "data_type", "timestamp", "data", "metadata")
STATUS_FIELDS = ("status", "battery_level", "location", "active_mission")


def _status_checks(df: DataFrame) -> DataFrame:
    """Fields of a status payload that the status table constrains."""
    staged = df.withColumn("_d", object_fields(F.when(F.col("data_type") == "status", F.col("data")), STATUS_FIELDS))
    d = F.col("_d")
    battery = d["battery_level"]
    battery_ok = battery["kind"].isNull() | battery["kind"].isin("null", "number") | ((battery["kind"] == "string") & battery["text"].try_cast("double").isNotNull())
    return staged.withColumns({
        "_data_is_obj": F.coalesce(d["state"] == OBJECT, F.lit(False)),
        "_status_len": F.length(d["status"]["text"]),
        "_mission_len": F.length(d["active_mission"]["text"]),
        "_battery_ok": battery_ok,
    })


def with_reject_reason(parsed: DataFrame) -> DataFrame:
    """Adds why a parsed envelope cannot be stored; NULL when accepted.

    Checks the parse first, then the column limits of the table the type is
    written to, then (status only) the status-table fields.
    """
    df = _status_checks(parsed)
    dtype = F.col("data_type")
    stored = dtype.isin(*S.TIMESERIES_TYPES)
    is_status = dtype == "status"
    reason = (
        F.when(F.coalesce(F.col("_state"), F.lit(MALFORMED)) == MALFORMED, F.lit("malformed_json"))
        .when(F.col("_state") != OBJECT, F.lit("not_object"))
        .when(dtype.isNull(), F.lit("bad_data_type"))
        .when(F.col("ts").isNull(), F.lit("bad_timestamp"))
        .when(stored & ~F.col("_storable"), F.lit("not_storable"))
        .when(stored & F.col("robot_id").isNull(), F.lit("missing_robot_id"))
        .when(stored & (F.length("robot_id") > S.MAX_LEN_ROBOT_ID), F.lit("robot_id_too_long"))
        .when(stored & (F.coalesce(F.length("sensor_id"), F.lit(0)) > S.MAX_LEN_SENSOR_ID), F.lit("sensor_id_too_long"))
        .when(is_status & ~F.col("_data_is_obj"), F.lit("bad_status_payload"))
        .when(is_status & (F.coalesce(F.col("_status_len"), F.lit(0)) > S.MAX_LEN_STATUS), F.lit("status_too_long"))
        .when(is_status & (F.coalesce(F.col("_mission_len"), F.lit(0)) > S.MAX_LEN_MISSION), F.lit("mission_too_long"))
        .when(is_status & ~F.col("_battery_ok"), F.lit("bad_battery_level"))
    )
    df = df.withColumn("reject_reason", reason).drop(
        "_d", "_data_is_obj", "_status_len", "_mission_len", "_battery_ok"
    )
    return _fence(df, ENVELOPE_FIELDS)


ENVELOPE_FIELDS = ("robot_id", "sensor_id", "data_type", "ts", "data", "metadata", "reject_reason")


def _fence(df: DataFrame, produced: tuple[str, ...]) -> DataFrame:
    """Emit the parsed fields through a one-row ``inline`` so that later
    filters on them (accept / reject splits) stay above the parse.

    Without it Catalyst pushes ``reject_reason IS NULL`` below the projection
    by substituting the full parse expression, which parses every message a
    second time inside the filter.
    """
    keep = [c for c in df.columns if c not in produced]
    return df.select(*keep, F.inline(F.array(F.struct(*produced))))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def http_envelope(df: DataFrame) -> DataFrame:
    """Gateway POST bodies (S2): ``robot_id`` comes from the URL path, the body
    must be a JSON object; a missing ``timestamp`` takes the receive time and a
    missing ``data_type`` is ``telemetry``.

    Input columns: ``robot_id, received_at, body, arrival_seq``.
    """
    return parse_envelope(
        df.withColumnRenamed("robot_id", "_path_robot"), raw_col="body",
        received_col="received_at", robot_col="_path_robot",
    ).drop("_path_robot")
