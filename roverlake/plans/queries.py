"""Named query plans over the test tables: name -> fn(spark, sf_dir) -> DataFrame.

Each plan reads whole tables through the adapters and applies the library
operators; ``__spark_entry__`` exposes this registry to the driver and
``plans.oracle`` holds the matching SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roverlake.functions import json as J
from roverlake.functions import sensors as SF
from roverlake.operators import alerts
from roverlake.operators import commands as cmd
from roverlake.operators import dashboard as dash
from roverlake.operators import edge
from roverlake.operators import envelope as env
from roverlake.operators import route as rt
from roverlake.operators import sensors as sens
from roverlake.operators import status as st
from roverlake.operators import telemetry as tel
from roverlake.session import checkpoint_dir
from roverlake.sources import adapters as ad
from roverlake.sources import file_index, files, sinks
from roverlake.sources import streams as srcs
from roverlake.streaming import dense
from roverlake.streaming import edge as edge_streams
from roverlake.streaming import ingest as ing
from roverlake.streaming import liveness as live
from roverlake.streaming import rollup
from roverlake.streaming import snapshots as snaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def _rollup(spark, sf_dir, interval: str, horizon: str) -> DataFrame:
    t = ad.telemetry(spark, sf_dir)
    out = tel.aggregate_metrics(t, "k", interval, as_of=tel.as_of_max(t), horizon=horizon)
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("metric_rollup_24h")
def metric_rollup_24h(spark, sf_dir):
    return _rollup(spark, sf_dir, "1 hour", "24 hours")


@query("metric_rollup_5h")
def metric_rollup_5h(spark, sf_dir):
    return _rollup(spark, sf_dir, "5 hours", "31 days")


@query("metric_rollup_7d")
def metric_rollup_7d(spark, sf_dir):
    return _rollup(spark, sf_dir, "7 days", "31 days")


@query("metric_rollup_15min")
def metric_rollup_15min(spark, sf_dir):
    return _rollup(spark, sf_dir, "15 minutes", "31 days")


@query("metric_rollup_1mon")
def metric_rollup_1mon(spark, sf_dir):
    return _rollup(spark, sf_dir, "1 month", "31 days")


def _history(spark, sf_dir, data_type=None):
    t = ad.telemetry(spark, sf_dir)
    bounds = t.agg(F.struct(F.min("time").alias("lo"), F.max("time").alias("hi"))).scalar()
    return tel.query_telemetry(t, bounds["lo"], bounds["hi"], data_type=data_type)


@query("telemetry_history")
def telemetry_history(spark, sf_dir):
    return _history(spark, sf_dir)


HISTORY_ROBOT, HISTORY_FROM, HISTORY_TO = "robot-7", "2024-01-08 00:00:00", "2024-01-21 12:00:00"


@query("history_one_robot")
def history_one_robot(spark, sf_dir):
    """One robot (P4) in a closed range inside the data (P5), newest first."""
    bounds = [F.lit(t).cast("timestamp_ntz") for t in (HISTORY_FROM, HISTORY_TO)]
    return tel.query_telemetry(ad.telemetry(spark, sf_dir), *bounds, robot_id=HISTORY_ROBOT)


@query("history_indexed")
def history_indexed(spark, sf_dir):
    """The same lookup on the stored table: its file index names the files to open."""
    base = _scratch(spark, "stored")
    sinks.write_timeseries(ad.telemetry(spark, sf_dir), f"{base}/timeseries")
    file_index.index_table(spark, f"{base}/timeseries", f"{base}/index")
    bounds = [F.lit(t).cast("timestamp_ntz") for t in (HISTORY_FROM, HISTORY_TO)]
    stored = file_index.read_for(spark, f"{base}/timeseries", f"{base}/index", HISTORY_ROBOT, *bounds)
    return tel.query_telemetry(stored, *bounds, robot_id=HISTORY_ROBOT)


@query("alert_windows")
def alert_windows(spark, sf_dir):
    return alerts.alert_windows(ad.service_requests(spark, sf_dir), "6 hours").withColumn("worst", F.round("worst", 6))


@query("telemetry_history_typed")
def telemetry_history_typed(spark, sf_dir):
    return _history(spark, sf_dir, "status")


@query("telemetry_latest")
def telemetry_latest(spark, sf_dir):
    return tel.latest_per_robot(ad.telemetry(spark, sf_dir))


@query("messages_by_weekday")
def messages_by_weekday(spark, sf_dir):
    return tel.messages_by_weekday(ad.telemetry(spark, sf_dir))


@query("load_profile_4h")
def load_profile_4h(spark, sf_dir):
    return tel.load_profile(ad.telemetry(spark, sf_dir))


# --- envelope, landing, routing -------------------------------------------


def _parsed(spark, sf_dir):
    return env.parse_envelope(ad.envelope_raw(spark, sf_dir))


ENVELOPE_COLUMNS = ("arrival_seq", "robot_id", "sensor_id", "data_type", "ts", "data", "metadata")


@query("envelope_parse")
def envelope_parse(spark, sf_dir):
    acc = env.accepted(_parsed(spark, sf_dir))
    return acc.select(*ENVELOPE_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("envelope_rejects")
def envelope_rejects(spark, sf_dir):
    return env.rejected(_parsed(spark, sf_dir)).select("arrival_seq", "reject_reason")


@query("http_landing")
def http_landing(spark, sf_dir):
    acc = env.accepted(env.http_envelope(ad.http_body(spark, sf_dir)))
    return rt.timeseries_rows(acc)


@query("ingest_latency")
def ingest_latency(spark, sf_dir):
    acc = env.accepted(env.http_envelope(ad.http_body(spark, sf_dir)))
    landed = acc.select("robot_id", F.col("ts").cast("timestamp_ntz").alias("time"), "received_at")
    return dash.ingest_latency(landed)


@query("route_counts")
def route_counts(spark, sf_dir):
    return rt.route_counts(_parsed(spark, sf_dir))


@query("route_timeseries")
def route_timeseries(spark, sf_dir):
    return rt.timeseries_rows(env.accepted(_parsed(spark, sf_dir)))


@query("fanout_topics")
def fanout_topics(spark, sf_dir):
    return rt.topic_rows(env.accepted(_parsed(spark, sf_dir)))


@query("processed_by_type")
def processed_by_type(spark, sf_dir):
    return rt.processed_by_type(env.accepted(_parsed(spark, sf_dir)))


@query("route_blobs")
def route_blobs(spark, sf_dir):
    """Objects of raw messages: the payload's bytes (by digest), length and metadata."""
    acc = env.accepted(env.parse_envelope(ad.blob_messages(spark, sf_dir)))
    objects = rt.object_view(rt.blob_rows(acc))
    return objects.select("bucket", "object_name", "arrival_seq", "length", F.sha2("payload", 256).alias("payload_sha256"), "metadata")


# --- status and dashboard ---------------------------------------------------


def _snapshot(spark, sf_dir, order="arrival"):
    return st.upsert_status(st.status_rows(ad.status_events(spark, sf_dir)), order=order)


@query("status_upsert")
def status_upsert(spark, sf_dir):
    return _snapshot(spark, sf_dir)


@query("status_upsert_event_time")
def status_upsert_event_time(spark, sf_dir):
    return _snapshot(spark, sf_dir, "event_time")


@query("robots_online_flag")
def robots_online_flag(spark, sf_dir):
    s = _snapshot(spark, sf_dir)
    return s.select("robot_id", "status", st.is_online("status").alias("is_online"))


@query("battery_bands")
def battery_bands(spark, sf_dir):
    s = _snapshot(spark, sf_dir)
    return s.select("robot_id", "battery_level", st.battery_status("battery_level").alias("battery_status"))


@query("robot_list")
def robot_list(spark, sf_dir):
    return dash.robot_list(ad.robots(spark, sf_dir), _snapshot(spark, sf_dir))


@query("dashboard_stats")
def dashboard_stats(spark, sf_dir):
    t = ad.telemetry(spark, sf_dir)
    return dash.dashboard_stats(_snapshot(spark, sf_dir), t, tel.as_of_max(t))


@query("robot_telemetry_counts")
def robot_telemetry_counts(spark, sf_dir):
    return dash.robot_telemetry_counts(ad.robots(spark, sf_dir), ad.telemetry(spark, sf_dir))


@query("orphan_telemetry")
def orphan_telemetry(spark, sf_dir):
    return dash.orphan_telemetry(ad.robots(spark, sf_dir), ad.telemetry(spark, sf_dir))


# --- payload getters and sensors --------------------------------------------


# Channels of the snapshot query and their values before the first reading.
SNAPSHOT_CHANNELS = {"battery": 100.0, "temperature": 25.0, "imu": 0.0, "odometry": 0.0, "laser": None}


@query("telemetry_getters")
def telemetry_getters(spark, sf_dir):
    p = ad.payloads(spark, sf_dir)
    pos = J.position_of("data")
    return p.select(
        "robot_id", "arrival_seq",
        J.number_or("data", "battery").alias("battery"),
        pos["x"].alias("pos_x"), pos["y"].alias("pos_y"), pos["z"].alias("pos_z"),
        J.string_or("data", "status").alias("status"),
    )


@query("payload_keys")
def payload_keys(spark, sf_dir):
    p = ad.payloads(spark, sf_dir)
    return p.select("arrival_seq", F.array_join(J.sorted_keys("data"), ",").alias("keys"))


@query("payload_render")
def payload_render(spark, sf_dir):
    p = ad.payloads(spark, sf_dir)
    return p.select("arrival_seq", J.render("data").alias("rendered"))


@query("odometry_motion")
def odometry_motion(spark, sf_dir):
    o = ad.odometry(spark, sf_dir)
    return o.select(
        "robot_id", "time", "arrival_seq",
        SF.planar_speed("vx", "vy").alias("linear"), F.col("wz").alias("angular"),
    )


@query("imu_reshape")
def imu_reshape(spark, sf_dir):
    i = ad.imu(spark, sf_dir)
    s = SF.imu_state("ax", "ay", "az", "gx", "gy", "gz", "ox", "oy", "oz", "ow").alias("imu")
    return i.select("robot_id", "arrival_seq", s).select(
        "robot_id", "arrival_seq",
        F.col("imu.linear_accel.x").alias("accel_x"), F.col("imu.linear_accel.y").alias("accel_y"),
        F.col("imu.linear_accel.z").alias("accel_z"), F.col("imu.angular_vel.z").alias("yaw_rate"),
        F.col("imu.orientation.w").alias("orient_w"),
    )


@query("lidar_downsample")
def lidar_downsample(spark, sf_dir):
    s = ad.lidar(spark, sf_dir)
    info = SF.laser_info("ranges", "angle_min", "angle_max", "angle_increment", "range_min", "range_max")
    out = s.select("scan_id", SF.laser_downsample("ranges").alias("sampled"), info.alias("info"))
    # posexplode_outer + null filter = posexplode, but Catalyst infers no
    # size(sampled) > 0 filter to push below the projection (which would
    # evaluate the down-sampling a second time, per element).
    return out.select(
        "scan_id",
        F.col("info.total_points").alias("total_points"),
        F.col("info.sampled_points").alias("sampled_points"),
        F.round("info.angle_increment", 6).alias("angle_increment"),
        F.posexplode_outer("sampled").alias("beam", "range"),
    ).where(F.col("beam").isNotNull())


@query("diagnostics_rollup")
def diagnostics_rollup(spark, sf_dir):
    d = sens.diagnostics_rollup(ad.diagnostics(spark, sf_dir))
    return d.select(
        "robot_id", "arrival_seq", "status",
        F.size("diagnostics").alias("entries"),
        F.col("diagnostics")["d0"]["level"].alias("d0_level"),
        F.col("diagnostics")["d1"]["level"].alias("d1_level"),
        F.col("diagnostics")["d0"]["values"]["volts"].alias("d0_volts"),
        F.col("diagnostics")["d1"]["values"]["amps"].alias("d1_amps"),
    )


@query("battery_series")
def battery_series(spark, sf_dir):
    b = sens.battery_series(ad.battery_raw(spark, sf_dir))
    return b.select("robot_id", "time", "arrival_seq", F.round("battery", 6).alias("battery"))


@query("snapshot_2s")
def snapshot_2s(spark, sf_dir):
    s = sens.snapshots(ad.channel_readings(spark, sf_dir), SNAPSHOT_CHANNELS, tick_seconds=2)
    return s.select("robot_id", "tick", *SNAPSHOT_CHANNELS, "readings", F.col("metadata.source").alias("source"))


def _dense_range(df: DataFrame, time: str = "time"):
    """The ten minutes that end a minute before the newest row."""
    newest = df.agg(F.max(time)).scalar()
    return newest - F.expr("INTERVAL 11 MINUTES"), newest - F.expr("INTERVAL 1 MINUTE")


@query("snapshot_dense")
def snapshot_dense(spark, sf_dir):
    """Every 2 s tick of a range, for every robot: newest value of each channel."""
    readings = ad.channel_readings(spark, sf_dir)
    channels = {c: F.lit(v).cast("double") for c, v in SNAPSHOT_CHANNELS.items()}
    return sens.dense_snapshots(sens.by_channel(readings, channels), channels, *_dense_range(readings), chunk="2 minutes")


@query("bridge_record")
def bridge_record(spark, sf_dir):
    """The bridge's whole cache at every 2 s tick of a range, for every robot."""
    r = sens.bridge_record(sens.bridge_messages(**ad.bridge_inputs(spark, sf_dir)), *_dense_range(ad.telemetry(spark, sf_dir)), chunk="2 minutes")
    return r.select(
        "robot_id", "tick", F.round("battery", 6).alias("battery"), "position.x", "position.y", "orientation.z", "orientation.w", "velocity.linear", "velocity.angular",
        F.size("laser_ranges").alias("beams"), F.round(F.try_element_at("laser_ranges", F.lit(-1)), 6).alias("last_beam"),
        F.col("laser_info.sampled_points").alias("sampled_points"), F.col("imu.linear_accel.y").alias("accel_y"), F.col("imu.orientation.w").alias("orient_w"),
        "status", F.col("diagnostics")["d0"]["level"].alias("d0_level"), "temperature", "last_update", F.col("metadata.robot_type").alias("robot_type"))


# --- edge nodes ---------------------------------------------------------------


def _edge(spark, sf_dir):
    log = ad.edge_log(spark, sf_dir)
    return log, edge.requests_decided(log), log.agg(F.max("ts")).scalar()


@query("heartbeat_accepted")
def heartbeat_accepted(spark, sf_dir):
    _, d, _ = _edge(spark, sf_dir)
    return d.where((F.col("kind") == "heartbeat") & F.col("accepted")).select("node_id", "seq", "ts", "epoch")


@query("deploy_accepted")
def deploy_accepted(spark, sf_dir):
    _, d, _ = _edge(spark, sf_dir)
    return d.where((F.col("kind") == "deploy") & F.col("accepted")).select("node_id", "seq", "model_id", "epoch")


@query("deploy_rejected")
def deploy_rejected(spark, sf_dir):
    _, d, _ = _edge(spark, sf_dir)
    return d.where((F.col("kind") == "deploy") & ~F.col("accepted")).select("node_id", "seq", "model_id")


@query("node_list")
def node_list(spark, sf_dir):
    log, _, as_of = _edge(spark, sf_dir)
    return edge.current_nodes(log, as_of)


@query("node_usage_latest")
def node_usage_latest(spark, sf_dir):
    log, _, as_of = _edge(spark, sf_dir)
    return edge.current_nodes(log, as_of).select("node_id", "cpu", "mem")


@query("node_deployed_models")
def node_deployed_models(spark, sf_dir):
    _, d, _ = _edge(spark, sf_dir)
    return edge.deployed_models(d)


@query("deployment_status")
def deployment_status(spark, sf_dir):
    log, _, as_of = _edge(spark, sf_dir)
    return edge.deployments(log, as_of)


@query("deployment_lookup")
def deployment_lookup(spark, sf_dir):
    """One deployment by id (P13): the first in id order."""
    log, _, as_of = _edge(spark, sf_dir)
    deps = edge.deployments(log, as_of)
    return edge.deployment_status(deps, deps.agg(F.min("deployment_id")).scalar())


@query("edge_health")
def edge_health(spark, sf_dir):
    log, _, as_of = _edge(spark, sf_dir)
    return edge.health(edge.current_nodes(log, as_of), edge.deployments(log, as_of), as_of)


@query("live_registrations")
def live_registrations(spark, sf_dir):
    log = ad.edge_log(spark, sf_dir)
    return edge.live_registrations(log, log.where(F.col("kind") == "register").agg(F.max("ts")).scalar())


@query("registration_cache")
def registration_cache(spark, sf_dir):
    return edge.registration_cache(ad.edge_log(spark, sf_dir))


@query("node_offline_intervals")
def node_offline_intervals(spark, sf_dir):
    log, _, as_of = _edge(spark, sf_dir)
    return edge.offline_intervals(log, as_of)


# --- commands -------------------------------------------------------------------


@query("command_normalise")
def command_normalise(spark, sf_dir):
    return cmd.normalise_commands(ad.commands(spark, sf_dir)).drop("issued_at")


# --- streams: run to completion on the table, read the sink back --------------


MICRO_BATCHES = 5


_STEPPED: dict[tuple[str, str], tuple[str, int]] = {}


def _stream_events(spark, sf_dir):
    """The events table as a stream of several micro-batches: written to the shared
    folder in ``MICRO_BATCHES`` steps by event id, one step each micro-batch, once for
    all stream queries of an application."""
    events, made = ad.events(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if made not in _STEPPED:
        _STEPPED[made] = _write_steps(spark, events)
    path, n_files = _STEPPED[made]
    return srcs.parquet_replay(spark, path, events.schema, n_files)


def _write_steps(spark, events: DataFrame) -> tuple[str, int]:
    """The folder of the steps and the number of files of each, which is the same for all:
    a micro-batch takes so many, in the order they were written. The files are as many as
    the task slots (or a step's share of the input splits), so every slot has work."""
    path = _scratch(spark, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    n_files = max(spark.sparkContext.defaultParallelism, -(-events.rdd.getNumPartitions() // MICRO_BATCHES))
    steps = MICRO_BATCHES if low is not None else 1
    for k in range(steps):
        step = F.least(F.floor((F.col("event_id") - F.lit(low)) * MICRO_BATCHES / F.lit(high - low + 1)), F.lit(MICRO_BATCHES - 1)) if low is not None else F.lit(0)
        events.where(step == k).repartition(n_files, "event_id", "ts", "user_id").write.mode("append").parquet(path)
        for _ in range((k + 1) * n_files - sum(n.startswith("part-") for n in files.names(spark, path))):
            spark.createDataFrame([], events.schema).write.mode("append").parquet(path)  # an empty partition writes no file
    return path, n_files


def _scratch(spark, name: str) -> str:
    """Sink and checkpoint folder under the cluster's shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/roverlake-streams/{name}-{uuid.uuid4().hex}"


def _run_to_end(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception():
        raise query_handle.exception()


def _run_ingest(spark, sf_dir) -> str:
    base = _scratch(spark, "ingest")
    msgs = ad.envelope_raw_of(_stream_events(spark, sf_dir))
    _run_to_end(ing.start_ingest(msgs, f"{base}/out", f"{base}/ckpt"))
    return f"{base}/out"


@query("stream_route_counts")
def stream_route_counts(spark, sf_dir):
    out = _run_ingest(spark, sf_dir)
    ts = ing.read_timeseries(spark, out).groupBy().count().select(F.lit("timeseries").alias("route"), F.col("count").alias("messages"))
    blobs = spark.read.parquet(f"{out}/objects").groupBy().count().select(F.lit("blob").alias("route"), F.col("count").alias("messages"))
    rej = spark.read.parquet(f"{out}/rejects").groupBy().count().select(F.lit("rejected").alias("route"), F.col("count").alias("messages"))
    fwd = (spark.read.parquet(f"{out}/topics")
           .where(~F.col("topic").isin(*[f"processed-{t}" for t in ("telemetry", "imu", "odometry", "status", "sensor_image", "point_cloud")]))
           .groupBy().count().select(F.lit("forward_only").alias("route"), F.col("count").alias("messages")))
    return ts.unionByName(blobs).unionByName(rej).unionByName(fwd).where(F.col("messages") > 0)


@query("stream_ingest_rows")
def stream_ingest_rows(spark, sf_dir):
    """The stored time-series rows of the ingest job, field by field."""
    stored = ing.read_timeseries(spark, _run_ingest(spark, sf_dir))
    return stored.select("time", "robot_id", "sensor_id", "data_type", "value", "metadata", "arrival_seq")


@query("stream_status_upsert")
def stream_status_upsert(spark, sf_dir):
    base = _scratch(spark, "status")
    msgs = ad.status_events_of(_stream_events(spark, sf_dir))

    table = st.status_table(f"{base}/status", buckets=8)
    _run_to_end(msgs.writeStream.option("checkpointLocation", f"{base}/ckpt").foreachBatch(lambda df, bid: table.merge(st.status_rows(df), bid))
                .trigger(availableNow=True).start())
    return table.read(spark)


@query("stream_node_offline")
def stream_node_offline(spark, sf_dir):
    base = _scratch(spark, "liveness")
    rows = live.offline_stream(ad.edge_log_of(_stream_events(spark, sf_dir)), watermark="0 seconds")  # the table is in order
    _run_to_end(rows.writeStream.format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
                .trigger(availableNow=True).start())
    return live.settled(spark.read.parquet(f"{base}/out")).select(
        "node_id",
        *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "offline_from", "offline_until")],
    )


@query("stream_snapshot_2s")
def stream_snapshot_2s(spark, sf_dir):
    base = _scratch(spark, "snapshots")
    rows = snaps.snapshot_stream(ad.channel_readings_of(_stream_events(spark, sf_dir)), SNAPSHOT_CHANNELS, watermark="0 seconds")
    _run_to_end(rows.writeStream.format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
                .trigger(availableNow=True).start())
    out = spark.read.parquet(f"{base}/out").drop("late")
    return out.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("stream_snapshot_dense")
def stream_snapshot_dense(spark, sf_dir):
    """Every tick of the range on a stream in several micro-batches."""
    base = _scratch(spark, "dense")
    newest = ad.events(spark, sf_dir).agg(F.max("ts")).first()[0] or dt.datetime(1970, 1, 2)
    rows = dense.dense_stream(
        ad.channel_readings_of(_stream_events(spark, sf_dir)), SNAPSHOT_CHANNELS, newest - dt.timedelta(minutes=11), newest - dt.timedelta(minutes=1), watermark="0 seconds")
    _run_to_end(rows.writeStream.format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
                .trigger(availableNow=True).start())
    return dense.ticks(spark.read.parquet(f"{base}/out")).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


def _sent(spark, rows, name: str) -> DataFrame:
    """What an append-mode stream has written when its input ends."""
    base = _scratch(spark, name)
    _run_to_end(rows.writeStream.format("parquet").option("path", f"{base}/out")
                .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
                .trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/out")


@query("stream_metric_rollup")
def stream_metric_rollup(spark, sf_dir):
    """Hourly roll-up on a stream; windows still open when the input ends are listed as such."""
    rows = rollup.rollup_stream(ad.telemetry_of(_stream_events(spark, sf_dir)), "k", "1 hour", watermark="0 seconds")
    windows = rollup.settled(_sent(spark, rows, "rollup"), ad.telemetry(spark, sf_dir), "k", "1 hour")
    return windows.withColumns({"bucket": F.col("bucket").cast("timestamp_ntz"), "avg_value": F.round("avg_value", 6)})


@query("stream_requests_decided")
def stream_requests_decided(spark, sf_dir):
    """Acceptance of every request, with what was known when it arrived."""
    decided = _sent(spark, edge_streams.decided_stream(ad.edge_log_of(_stream_events(spark, sf_dir))), "decided")
    return decided.select("kind", "node_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "model_id", "epoch", "accepted")


@query("stream_deployment_status")
def stream_deployment_status(spark, sf_dir):
    """Deployments from the change log of their transitions."""
    changes = _sent(spark, edge_streams.deployment_stream(ad.edge_log_of(_stream_events(spark, sf_dir)), watermark="0 seconds"), "deployments")
    return edge_streams.deployments_now(changes).withColumn("deployed_at", F.col("deployed_at").cast("timestamp_ntz"))


@query("stream_registration_cache")
def stream_registration_cache(spark, sf_dir):
    """Registration cache entries from the change log of their ends."""
    changes = _sent(spark, edge_streams.registration_stream(ad.edge_log_of(_stream_events(spark, sf_dir)), watermark="0 seconds"), "registrations")
    return edge_streams.cache_entries(changes).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("registered_at", "expires_at", "live_until")})
