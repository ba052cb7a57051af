"""Fleet-shaped views over the driver's test tables.

The test tables are generic (events, customer, orders, ...). Each function
here maps them onto one fleet input with plain column expressions, so every
view is a narrow projection of a whole table: no sampling, no id subsets.
The fault and variety rules are deterministic functions of the row ids so
that an independent SQL engine can rebuild the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.sources.tables import load, spread

# ---------------------------------------------------------------------------
# Fixed values of the adapters (our test conventions).
# Event type -> telemetry data type:
#   view -> telemetry, click -> imu, purchase -> odometry, signup -> status,
#   error -> diagnostics
# Envelope data types by (event_id div 16) % 8:
#   0 telemetry, 1 sensor_image, 2 point_cloud, 3 imu, 4 odometry,
#   5 diagnostics, 6 command, 7 status
# Envelope faults by event_id % 16:
#   0 no timestamp, 1 timestamp 'not-a-date', 2 type 'bogus', 3 type null,
#   4 no type, 5 no sensor, 6 sensor null, 7 no data, 8 data null,
#   9 robot null, 10 robot id of 60 characters, 11 '[1,2]', 12 '{bad',
#   13 timestamp '2025', 14 and 15 valid or odd
# Odd envelopes by (event_id div 128) % 8, where the fault is 14 or 15:
#   0 none, 1 an earlier robot_id "ghost", 2 data with NaN, 3 trailing text,
#   4 data with a number of 45 digits, 5 blanks around tokens,
#   6 an escape in the sensor id, 7 a repeated key in data
# Status values by event_id % 5: online, offline, error, charging, maintenance
# Edge event kind: signup -> register, view/click -> heartbeat, purchase -> deploy
# Command by order priority: 1 move (linear, angular), 2 move (no values),
#   3 goto, 4 stop, 5 spin (unknown)
# Arrival permutation for status events: (event_id * 7919) % 100003 within
#   blocks of 100003 ids
# ---------------------------------------------------------------------------
EVENT_TYPE_TO_DATA_TYPE = {
    "view": "telemetry", "click": "imu", "purchase": "odometry", "signup": "status", "error": "diagnostics",
}
ENVELOPE_TYPES = ("telemetry", "sensor_image", "point_cloud", "imu", "odometry", "diagnostics", "command", "status")
STATUS_CYCLE = ("online", "offline", "error", "charging", "maintenance")
EDGE_KIND = {"signup": "register", "view": "heartbeat", "click": "heartbeat", "error": "heartbeat", "purchase": "deploy"}
LONG_NUMBER = "123456789" * 5
PERMUTATION_PRIME = 7919
PERMUTATION_BLOCK = 100003


def _map(col: Column, mapping: dict) -> Column:
    expr = None
    for src, dst in mapping.items():
        expr = F.when(col == src, F.lit(dst)) if expr is None else expr.when(col == src, F.lit(dst))
    return expr


def _k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("long")


def _q(c: Column) -> Column:
    """JSON string literal of a text column (the ids and names used here need no escapes)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def robot_id(user_col: str) -> Column:
    return F.concat(F.lit("robot-"), F.col(user_col).cast("string"))


def events(spark, sf_dir, *cols) -> DataFrame:
    return load(spark, sf_dir, "events", *(cols or ("event_id", "ts", "user_id", "event_type", "value", "props")))


def telemetry(spark, sf_dir) -> DataFrame:
    """Stored time-series rows: one per event."""
    return telemetry_of(events(spark, sf_dir))


def telemetry_of(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("arrival_seq"),
        F.col("ts").alias("time"),
        robot_id("user_id").alias("robot_id"),
        F.lit("unknown").alias("sensor_id"),
        _map(F.col("event_type"), EVENT_TYPE_TO_DATA_TYPE).alias("data_type"),
        F.col("props").alias("value"),
        F.lit("{}").alias("metadata"),
    )


def service_requests(spark, sf_dir) -> DataFrame:
    """Requests with latency and outcome for the alert rules: one per event, error
    events failed; every seventh has no latency."""
    e = events(spark, sf_dir)
    return e.select(
        robot_id("user_id").alias("robot_id"), F.col("ts").alias("time"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 10).alias("latency_ms"),
        (F.col("event_type") == "error").alias("is_error"))


def robots(spark, sf_dir) -> DataFrame:
    """Robot registry from customers. Accounts in debt (negative balance) stand
    for robots that were registered anew under a spare id, so the telemetry under
    their old id has no robot; customers without events are robots without
    telemetry."""
    c = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    spare = F.concat(F.lit("spare-"), F.col("c_custkey").cast("string"))
    return c.select(
        F.when(F.col("c_acctbal") < 0, spare).otherwise(robot_id("c_custkey")).alias("robot_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("type"),
    )


def envelope_raw(spark, sf_dir) -> DataFrame:
    return envelope_raw_of(spread(events(spark, sf_dir)))


def envelope_raw_of(e: DataFrame) -> DataFrame:
    """Raw JSON envelopes, one per event, with faults by ``event_id % 16``; those of
    14 and 15 are odd, but for trailing text legal, by ``event_id div 128 % 8``."""
    fault = F.col("event_id") % 16
    odd = F.when(fault >= 14, F.floor(F.col("event_id") / 128) % 8).otherwise(0)
    dtype = F.element_at(F.array(*[F.lit(t) for t in ENVELOPE_TYPES]), ((F.floor(F.col("event_id") / 16) % 8) + 1).cast("int"))
    ts_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rid = F.when(fault == 10, F.concat(F.lit("robot-"), F.repeat(F.lit("x"), 54)))\
        .otherwise(robot_id("user_id"))
    sensor = F.when(odd == 6, F.lit("\\u0041")).otherwise((F.col("event_id") % 3).cast("string"))
    data = _map(odd, {2: '{"k":NaN}', 4: '{"k":%s}' % LONG_NUMBER, 5: '{ "k" :\t7 }', 7: '{"k":0,"k":5}'}).otherwise(F.col("props"))
    parts = [
        F.when(odd == 1, F.lit('"robot_id":"ghost"')),
        F.when(fault == 9, F.lit('"robot_id":null')).otherwise(F.concat(F.lit('"robot_id":'), _q(rid))),
        F.when(fault == 5, F.lit(None)).when(fault == 6, F.lit('"sensor_id":null'))
        .otherwise(F.concat(F.lit('"sensor_id":"sensor-'), sensor, F.lit('"'))),
        F.when(fault == 4, F.lit(None)).when(fault == 3, F.lit('"data_type":null'))
        .when(fault == 2, F.lit('"data_type":"bogus"'))
        .otherwise(F.concat(F.lit('"data_type":'), _q(dtype))),
        F.when(fault == 0, F.lit(None)).when(fault == 1, F.lit('"timestamp":"not-a-date"'))
        .when(fault == 13, F.lit('"timestamp":"2025"'))
        .otherwise(F.concat(F.lit('"timestamp":'), _q(ts_text))),
        F.when(fault == 7, F.lit(None)).when(fault == 8, F.lit('"data":null'))
        .otherwise(F.concat(F.lit('"data":'), data)),
        F.lit('"metadata":{}'),
    ]
    obj = F.concat(F.when(odd == 5, "\n {\t").otherwise("{"), F.concat_ws(",", *parts), F.when(odd == 5, " }\n").when(odd == 3, "} x").otherwise("}"))
    raw = F.when(fault == 11, F.lit("[1,2]")).when(fault == 12, F.lit("{bad")).otherwise(obj)
    return e.select(
        raw.alias("raw"),
        F.col("event_id").alias("arrival_seq"),
        F.col("ts").alias("received_at"),
    )


def http_body(spark, sf_dir) -> DataFrame:
    """Gateway POST bodies: robot id from the path, body ``{"data": props}``;
    only odd ids carry a ``timestamp``; the gateway receives each body
    ``event_id % 250`` milliseconds after its timestamp."""
    e = spread(events(spark, sf_dir))
    ts_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.when(
        F.col("event_id") % 2 == 1,
        F.concat(F.lit('{"timestamp":"'), ts_text, F.lit('","data":'), F.col("props"), F.lit("}")),
    ).otherwise(F.concat(F.lit('{"data":'), F.col("props"), F.lit("}")))
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("event_id") % 250) / 1000).cast("decimal(18,6)"))
    return e.select(
        robot_id("user_id").alias("robot_id"),
        (F.col("ts") + delay).alias("received_at"),
        body.alias("body"),
        F.col("event_id").alias("arrival_seq"),
    )


def status_events(spark, sf_dir) -> DataFrame:
    return status_events_of(spread(events(spark, sf_dir)))


def status_events_of(e: DataFrame) -> DataFrame:
    """Status messages (signup events) with a permuted arrival order."""
    e = e.where(F.col("event_type") == "signup")
    eid = F.col("event_id")
    arrival = (eid * PERMUTATION_PRIME) % PERMUTATION_BLOCK + F.floor(eid / PERMUTATION_BLOCK) * PERMUTATION_BLOCK
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_CYCLE]), ((eid % 5) + 1).cast("int"))
    parts = [
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit('"status":'), _q(status))),
        F.when(eid % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit('"battery_level":'), F.least(F.col("value"), F.lit(100.0)).cast("string"))),
        F.concat(F.lit('"location":'), F.col("props")),
        F.when(eid % 3 == 0, F.lit('"active_mission":null'))
        .otherwise(F.concat(F.lit('"active_mission":"mission-'), _k().cast("string"), F.lit('"'))),
    ]
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        arrival.cast("long").alias("arrival_seq"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("data"),
    )


def edge_log(spark, sf_dir) -> DataFrame:
    return edge_log_of(events(spark, sf_dir))


def edge_log_of(e: DataFrame) -> DataFrame:
    """Edge controller requests: registers, heartbeats (error events report a
    degraded node and no memory), deploy requests. Every third request names no GPU;
    registers name none, an empty list, one or two models."""
    eid = F.col("event_id")
    text = lambda c: c.cast("string")
    register = F.col("event_type") == "signup"
    model = lambda n: F.concat(F.lit(f"base-{n}-"), text(eid % 3))
    return e.select(
        F.when(register, F.concat(F.lit("edge-"), text(eid % 7))).alias("name"),
        F.when(register, F.concat(F.lit("10.0."), text(eid % 4), F.lit("."), text(F.col("user_id") % 250))).alias("ip"),
        (eid % 8 + 4).cast("int").alias("cpu_cores"),
        F.when(F.col("event_type") != "error", (eid % 5 + 1) * 8.0).alias("memory_gb"),
        F.when(eid % 3 != 0, (eid % 2 + 1) * 12.0).alias("gpu_memory_gb"),
        (F.col("value") * 10).alias("disk_gb"),
        F.when(register & (eid % 4 == 1), F.array().cast("array<string>")).when(register & (eid % 4 == 2), F.array(model("a"))).when(register & (eid % 4 == 3), F.array(model("a"), model("b"))).alias("models"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("config"),
        _map(F.col("event_type"), EDGE_KIND).alias("kind"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("node_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("ts"),
        F.when(F.col("event_type") == "error", "degraded").otherwise("active").alias("status"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu"),
        _k().cast("double").alias("mem"),
        F.concat(F.lit("model-"), (F.col("event_id") % 9).cast("string")).alias("model_id"),
        F.lit("1.0").alias("version"),
    )


def payloads(spark, sf_dir) -> DataFrame:
    """Telemetry payloads of mixed shapes, by ``event_id % 6``."""
    e = spread(events(spark, sf_dir))
    eid, k = F.col("event_id"), _k().cast("string")
    v = F.col("value").cast("string")
    shape = eid % 6
    first = (
        F.when(shape == 0, F.concat(F.lit('"battery":'), v))
        .when(shape == 1, F.concat(F.lit('"battery":"'), k, F.lit('"')))
        .when(shape == 2, F.lit(None))
        .when(shape == 3, F.concat(F.lit('"position":{"x":'), v, F.lit(',"y":'), k, F.lit(',"z":0}')))
        .when(shape == 4, F.concat(F.lit('"position":{"x":'), v, F.lit("}")))
        .otherwise(F.concat(F.lit('"position":'), k))
    )
    status = F.when(eid % 2 == 0, F.lit('"status":"active"')).otherwise(F.concat(F.lit('"status":'), k))
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        eid.alias("arrival_seq"),
        F.concat(F.lit("{"), F.concat_ws(",", first, status, F.lit('"temperature":25.0')), F.lit("}")).alias("data"),
    )


def odometry(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("arrival_seq"),
        F.col("value").alias("vx"),
        _k().cast("double").alias("vy"),
        (F.col("value") / 100).alias("wz"),
    )


def battery_raw(spark, sf_dir) -> DataFrame:
    """Battery readings: a fraction on every fourth event, else 0 (decay)."""
    e = events(spark, sf_dir)
    p = F.when(F.col("event_id") % 4 == 0, (_k() % 100) / 100.0).otherwise(F.lit(0.0))
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("arrival_seq"),
        p.alias("percentage"),
    )


def lidar(spark, sf_dir) -> DataFrame:
    """Laser scans: five copies of each embedding (320 beams)."""
    m = spread(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    r = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return m.select(
        F.col("vec_id").alias("scan_id"),
        F.concat(r, r, r, r, r).alias("ranges"),
        F.lit(-3.14).alias("angle_min"),
        F.lit(3.14).alias("angle_max"),
        F.lit(0.01).alias("angle_increment"),
        F.lit(0.12).alias("range_min"),
        F.lit(3.5).alias("range_max"),
    )


def diagnostics(spark, sf_dir) -> DataFrame:
    """Diagnostic arrays (error events): three entries, one repeated name, each with two
    values of which the key of odd levels is repeated."""
    e = events(spark, sf_dir).where(F.col("event_type") == "error")
    k, eid = _k(), F.col("event_id")

    def entry(name: str, level: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), level.cast("int").alias("level"),
            F.concat(F.lit(name), F.lit(" level "), level.cast("string")).alias("message"),
            F.array(
                F.struct(F.lit("volts").alias("key"), k.cast("string").alias("value")),
                F.struct(F.when(level % 2 == 1, "volts").otherwise("amps").alias("key"), eid.cast("string").alias("value")),
            ).alias("values"),
        )

    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        eid.alias("arrival_seq"),
        F.array(entry("d0", k % 3), entry("d1", (k + 1) % 2), entry("d0", eid % 3)).alias("status"),
    )


def bridge_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """The bridge's sensor messages by kind: poses and twists (purchases), laser scans of
    40 beams (views, every beam a third longer), inertia (clicks), battery (signups), diagnostics (errors)."""
    e = events(spark, sf_dir)
    at = [robot_id("user_id").alias("robot_id"), F.col("ts").alias("time"), F.col("event_id").alias("arrival_seq")]

    def of(event_type: str) -> DataFrame:
        return e.where(F.col("event_type") == event_type)

    k, zero = _k().cast("double"), F.lit(0.0)
    return {
        "odometry": of("purchase").select(
            *at, F.col("value").alias("px"), k.alias("py"), zero.alias("pz"), zero.alias("ox"), zero.alias("oy"), (k / 100).alias("oz"), F.lit(1.0).alias("ow"),
            F.col("value").alias("vx"), k.alias("vy"), (F.col("value") / 100).alias("wz")),
        "scans": of("view").select(
            *at, F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.col("value") + i / 3).alias("ranges"),
            F.lit(-3.14).alias("angle_min"), F.lit(3.14).alias("angle_max"), F.lit(0.01).alias("angle_increment"), F.lit(0.12).alias("range_min"), F.lit(3.5).alias("range_max")),
        "imu": imu(spark, sf_dir),
        "battery": of("signup").select(*at, F.when(F.col("event_id") % 4 == 0, (_k() % 100) / 100.0).otherwise(0.0).alias("percentage")),
        "diagnostics": diagnostics(spark, sf_dir),
    }


def channel_readings(spark, sf_dir) -> DataFrame:
    return channel_readings_of(events(spark, sf_dir))


def channel_readings_of(e: DataFrame) -> DataFrame:
    """Sensor readings per channel (one channel per event type)."""
    channel = _map(F.col("event_type"), {
        "view": "battery", "click": "imu", "purchase": "odometry", "signup": "temperature", "error": "laser",
    })
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("arrival_seq"),
        channel.alias("channel"),
        F.col("value").alias("reading"),
    )


def blobs_in(spark, sf_dir) -> DataFrame:
    """Large payloads: pages as camera images, documents as point clouds.

    Ids i and i+10 within each block of 20 share robot, time and sensor, so
    their object keys collide and the later arrival must win.
    """
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

    def shape(df: DataFrame, id_col: str, text_col: str, dtype: str, seq_offset: int) -> DataFrame:
        i = F.col(id_col)
        return df.select(
            robot_id_expr(i % 10).alias("robot_id"),
            F.lit("cam0" if dtype == "sensor_image" else "lidar0").alias("sensor_id"),
            F.lit(dtype).alias("data_type"),
            (base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(i / 20) * 20).cast("decimal(18,6)"))).alias("ts"),
            F.to_json(F.struct(F.col(text_col).alias("content"))).alias("data"),
            F.lit("{}").alias("metadata"),
            (i * 2 + seq_offset).alias("arrival_seq"),
        )

    pages = shape(spread(load(spark, sf_dir, "pages", "page_id", "html")), "page_id", "html", "sensor_image", 0)
    docs = shape(spread(load(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", "point_cloud", 1)
    return pages.unionByName(docs)


def blob_messages(spark, sf_dir) -> DataFrame:
    """The large payloads as raw messages, with metadata, as they come from the topic."""
    b = blobs_in(spark, sf_dir)
    parts = [
        F.concat(F.lit(f'"{key}":'), _q(value))
        for key, value in (("robot_id", F.col("robot_id")), ("sensor_id", F.col("sensor_id")), ("data_type", F.col("data_type")), ("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    ]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit(',"data":'), "data", F.lit(',"metadata":{"seq":'), F.col("arrival_seq").cast("string"), F.lit(', "unit": null}}'))
    return b.select(raw.alias("raw"), "arrival_seq", F.col("ts").alias("received_at"))


def robot_id_expr(c: Column) -> Column:
    return F.concat(F.lit("robot-"), c.cast("string"))


def commands(spark, sf_dir) -> DataFrame:
    """Cloud commands from orders, by priority."""
    o = spread(load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate"))
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    lin = (F.col("o_totalprice") / 1000).cast("string")
    ang = ((F.col("o_orderkey") % 7 - 3) / 10).cast("string")
    body = (
        F.when(prio == "1", F.concat(F.lit('{"type":"move","linear":'), lin, F.lit(',"angular":'), ang, F.lit("}")))
        .when(prio == "2", F.lit('{"type":"move"}'))
        .when(prio == "3", F.concat(F.lit('{"type":"goto","x":'), lin, F.lit("}")))
        .when(prio == "4", F.lit('{"type":"stop"}'))
        .otherwise(F.lit('{"type":"spin"}'))
    )
    return o.select(
        F.col("o_orderkey").alias("command_id"),
        robot_id("o_custkey").alias("robot_id"),
        F.col("o_orderdate").alias("issued_at"),
        body.alias("command"),
    )


def imu(spark, sf_dir) -> DataFrame:
    """IMU messages (click events): acceleration from value and k, yaw rate value/100."""
    e = events(spark, sf_dir).where(F.col("event_type") == "click")
    return e.select(
        robot_id("user_id").alias("robot_id"),
        F.col("ts").alias("time"),
        F.col("event_id").alias("arrival_seq"),
        F.col("value").alias("ax"), (_k().cast("double") / 10).alias("ay"), F.lit(9.81).alias("az"),
        F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), (F.col("value") / 100).alias("gz"),
        F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(1.0).alias("ow"),
    )
