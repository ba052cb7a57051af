"""Oracle SQL (DuckDB dialect) for each registered query.

Every statement rebuilds its fleet views from the raw test tables (see
``views_sql``) and computes the answer with plain SQL, independent of the
Spark code path. Column names equal the Spark query's aliases.
"""

from __future__ import annotations

from roverlake.plans.views_sql import with_views

_KD = "TRY_CAST(value->>'k' AS DOUBLE)"


def _rollup(interval: str, horizon: str) -> str:
    return with_views("telemetry") + f"""
SELECT robot_id, time_bucket(INTERVAL '{interval}', time) AS bucket,
       round(avg({_KD}), 6) AS avg_value, min({_KD}) AS min_value, max({_KD}) AS max_value,
       count(*) AS data_points
FROM telemetry
WHERE json_exists(value, '$.k') AND time > (SELECT max(time) FROM telemetry) - INTERVAL '{horizon}'
GROUP BY 1, 2"""


ORACLE: dict[str, str] = {
    "metric_rollup_24h": _rollup("1 hour", "24 hours"),
    "metric_rollup_5h": _rollup("5 hours", "31 days"),
    "metric_rollup_7d": _rollup("7 days", "31 days"),
    "metric_rollup_15min": _rollup("15 minutes", "31 days"),
    "metric_rollup_1mon": _rollup("1 month", "31 days"),
    "telemetry_history": with_views("telemetry") + """
SELECT robot_id, time, sensor_id, data_type, value, metadata, arrival_seq
FROM telemetry
WHERE time BETWEEN (SELECT min(time) FROM telemetry) AND (SELECT max(time) FROM telemetry)""",
    "history_one_robot": with_views("telemetry") + """
SELECT time, sensor_id, data_type, value, metadata, arrival_seq
FROM telemetry
WHERE robot_id = 'robot-7' AND time BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-21 12:00:00'""",
    "telemetry_history_typed": with_views("telemetry") + """
SELECT robot_id, time, sensor_id, data_type, value, metadata, arrival_seq
FROM telemetry
WHERE time BETWEEN (SELECT min(time) FROM telemetry) AND (SELECT max(time) FROM telemetry)
  AND data_type = 'status'""",
    "telemetry_latest": with_views("telemetry") + """
SELECT robot_id, time, arrival_seq, sensor_id, data_type, value, metadata
FROM telemetry
QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY time DESC, arrival_seq DESC) = 1""",
    "messages_by_weekday": with_views("telemetry") + """
SELECT CAST(isodow(time) AS BIGINT) AS isodow, count(*) AS messages FROM telemetry GROUP BY 1""",
    "load_profile_4h": with_views("telemetry") + f"""
SELECT CAST(hour(time) // 4 * 4 AS BIGINT) AS slot, count(*) AS messages, round(avg({_KD}), 6) AS avg_value
FROM telemetry GROUP BY 1""",
}

_ENV = with_views("envelope_raw", "envelope_parsed")
_TS_TYPES = "('telemetry','imu','odometry','status')"

ORACLE.update({
    "envelope_parse": _ENV + """
SELECT arrival_seq, robot_id, sensor_id, data_type, ts, data, metadata
FROM envelope_parsed WHERE reject_reason IS NULL""",
    "envelope_rejects": _ENV + """
SELECT arrival_seq, reject_reason FROM envelope_parsed WHERE reject_reason IS NOT NULL""",
    "route_counts": _ENV + f"""
SELECT CASE WHEN reject_reason IS NOT NULL THEN 'rejected'
            WHEN data_type IN {_TS_TYPES} THEN 'timeseries'
            WHEN data_type IN ('sensor_image','point_cloud') THEN 'blob'
            ELSE 'forward_only' END AS route,
       count(*) AS messages
FROM envelope_parsed GROUP BY 1""",
    "route_timeseries": _ENV + f"""
SELECT ts AS time, robot_id, sensor_id, data_type, data AS value, metadata, arrival_seq
FROM envelope_parsed WHERE reject_reason IS NULL AND data_type IN {_TS_TYPES}""",
    "fanout_topics": _ENV + """
SELECT 'processed-' || data_type AS topic, raw AS value, arrival_seq
FROM envelope_parsed WHERE reject_reason IS NULL""",
    "processed_by_type": _ENV + """
SELECT data_type, count(*) AS processed FROM envelope_parsed WHERE reject_reason IS NULL GROUP BY 1""",
    "http_landing": with_views("http_body") + """
SELECT CASE WHEN json_exists(body, '$.timestamp') THEN TRY_CAST(body->>'timestamp' AS TIMESTAMP)
            ELSE received_at END AS time,
       robot_id, 'unknown' AS sensor_id, 'telemetry' AS data_type,
       data_text AS value, '{}' AS metadata, arrival_seq
FROM http_body WHERE json_type(body) = 'OBJECT'""",
    "ingest_latency": with_views("http_body") + """,
landed AS (
  SELECT robot_id, received_at,
         CASE WHEN json_exists(body, '$.timestamp') THEN TRY_CAST(body->>'timestamp' AS TIMESTAMP)
              ELSE received_at END AS time
  FROM http_body WHERE json_type(body) = 'OBJECT')
SELECT robot_id, count(*) AS messages,
       round(avg((epoch_us(received_at) - epoch_us(time)) / 1000.0), 6) AS avg_latency_ms,
       max((epoch_us(received_at) - epoch_us(time)) / 1000.0) AS max_latency_ms
FROM landed GROUP BY 1""",
    "route_blobs": with_views("blobs_in") + """
SELECT CASE data_type WHEN 'sensor_image' THEN 'robot-images' ELSE 'point-clouds' END AS bucket,
       robot_id || '/' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END
         || '/' || sensor_id AS object_name,
       max(arrival_seq) AS arrival_seq,
       arg_max(octet_length(encode(data)), arrival_seq) AS length,
       arg_max(sha256(data), arrival_seq) AS payload_sha256,
       '{"seq":' || max(arrival_seq) || ', "unit": null}' AS metadata
FROM blobs_in GROUP BY 1, 2""",
})

_STATUS_ROWS = with_views("status_events") + """,
status_rows AS (
  SELECT robot_id, time AS last_seen,
         CASE WHEN json_exists(data, '$.status') THEN data->>'status' ELSE 'unknown' END AS status,
         TRY_CAST(data->>'battery_level' AS DOUBLE) AS battery_level,
         location_text AS location,
         data->>'active_mission' AS active_mission, arrival_seq
  FROM status_events)"""
_SNAP = _STATUS_ROWS.replace("WITH ", "WITH ", 1) + """,
snapshot AS (
  SELECT * FROM status_rows
  QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY arrival_seq DESC) = 1)
"""
_SNAP_ROBOTS = _SNAP.rstrip() + ",\n" + with_views("robots")[5:]
_TEL_ROBOTS = with_views("telemetry", "robots")

ORACLE.update({
    "status_upsert": _SNAP + "SELECT * FROM snapshot",
    "status_upsert_event_time": _STATUS_ROWS + """
SELECT * FROM status_rows
QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY last_seen DESC, arrival_seq DESC) = 1""",
    "robots_online_flag": _SNAP + "SELECT robot_id, status, coalesce(status, '') = 'online' AS is_online FROM snapshot",
    "battery_bands": _SNAP + """
SELECT robot_id, battery_level,
       CASE WHEN battery_level IS NULL THEN NULL WHEN battery_level >= 80 THEN 'excellent'
            WHEN battery_level >= 60 THEN 'good' WHEN battery_level >= 40 THEN 'fair'
            WHEN battery_level >= 20 THEN 'low' ELSE 'critical' END AS battery_status
FROM snapshot""",
    "robot_list": _SNAP_ROBOTS + """
SELECT r.robot_id, r.name, r.type, s.status, s.battery_level AS battery, s.last_seen,
       coalesce(s.status, '') = 'online' AS is_online, s.battery_level > 20 AS battery_ok
FROM robots r LEFT JOIN snapshot s USING (robot_id)""",
    "dashboard_stats": _SNAP.rstrip() + ",\n" + with_views("telemetry")[5:] + """
SELECT count(*) AS robots_total,
       count(*) FILTER (WHERE coalesce(status, '') = 'online') AS robots_online,
       count(*) FILTER (WHERE coalesce(status, '') <> 'online') AS robots_offline,
       round(count(*) FILTER (WHERE coalesce(status, '') = 'online') / greatest(count(*), 1), 6) AS system_health,
       (SELECT count(*) FROM telemetry) AS total_messages,
       (SELECT count(*) FROM telemetry WHERE CAST(time AS DATE) = (SELECT CAST(max(time) AS DATE) FROM telemetry))
         AS today_messages
FROM snapshot""",
    "robot_telemetry_counts": _TEL_ROBOTS + """
SELECT r.robot_id, r.name, CAST(count(t.robot_id) AS BIGINT) AS messages
FROM robots r LEFT JOIN telemetry t USING (robot_id) GROUP BY r.robot_id, r.name""",
    "orphan_telemetry": _TEL_ROBOTS + """
SELECT robot_id, count(*) AS messages FROM telemetry
WHERE robot_id NOT IN (SELECT robot_id FROM robots) GROUP BY 1""",
})

_NUM = "('BIGINT','UBIGINT','DOUBLE','INTEGER','HUGEINT')"


def _coord(c: str) -> str:
    return (f"CASE WHEN json_type(data, '$.position') <> 'OBJECT' OR json_type(data, '$.position') IS NULL THEN NULL "
            f"WHEN json_type(data, '$.position.{c}') IN {_NUM} THEN CAST(data->'position'->>'{c}' AS DOUBLE) "
            f"ELSE 0.0 END")


_SNAP_CH = ("battery", "temperature", "imu", "odometry", "laser")
_SNAP_DEFAULT = {"battery": "100.0", "temperature": "25.0", "imu": "0.0", "odometry": "0.0", "laser": None}


def _snapshot_sql() -> str:
    fills = ",\n".join(
        f"last_value(CASE WHEN channel = '{c}' THEN reading END IGNORE NULLS) OVER w AS f_{c}" for c in _SNAP_CH
    )
    outs = ", ".join(
        (f"coalesce(f_{c}, {_SNAP_DEFAULT[c]}) AS {c}" if _SNAP_DEFAULT[c] else f"f_{c} AS {c}") for c in _SNAP_CH
    )
    return with_views("channel_readings") + f""",
filled AS (
  SELECT robot_id, time, arrival_seq,
         make_timestamp(CAST((epoch_us(time) + 1999999) // 2000000 * 2000000 AS BIGINT)) AS tick,
         {fills}
  FROM channel_readings
  WINDOW w AS (PARTITION BY robot_id ORDER BY time, arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT robot_id, tick, {outs}, count(*) OVER (PARTITION BY robot_id, tick) AS readings,
       'gazebo_simulation' AS source
FROM filled
QUALIFY row_number() OVER (PARTITION BY robot_id, tick ORDER BY time DESC, arrival_seq DESC) = 1"""


ORACLE.update({
    "telemetry_getters": with_views("payloads") + f"""
SELECT robot_id, arrival_seq,
       CASE WHEN json_type(data, '$.battery') IN {_NUM} THEN CAST(data->>'battery' AS DOUBLE) ELSE 0.0 END AS battery,
       {_coord('x')} AS pos_x, {_coord('y')} AS pos_y, {_coord('z')} AS pos_z,
       CASE WHEN json_type(data, '$.status') = 'VARCHAR' THEN data->>'status' ELSE '' END AS status
FROM payloads""",
    "payload_keys": with_views("payloads") + """
SELECT arrival_seq, array_to_string(list_sort(json_keys(data)), ',') AS keys FROM payloads""",
    "payload_render": with_views("payloads") + """
SELECT arrival_seq,
       array_to_string(list_transform(json_keys(data), lambda x: x || ': ' || coalesce(data->>x, 'null')), ', ') AS rendered
FROM payloads""",
    "odometry_motion": f"""
SELECT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id, ts AS time, event_id AS arrival_seq,
       sqrt(value * value + CAST(props->>'k' AS DOUBLE) * CAST(props->>'k' AS DOUBLE)) AS linear,
       value / 100 AS angular
FROM events WHERE event_type = 'purchase'""",
    "imu_reshape": """
SELECT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id, event_id AS arrival_seq,
       value AS accel_x, CAST(props->>'k' AS DOUBLE) / 10 AS accel_y, CAST(9.81 AS DOUBLE) AS accel_z,
       value / 100 AS yaw_rate, CAST(1.0 AS DOUBLE) AS orient_w
FROM events WHERE event_type = 'click'""",
    "lidar_downsample": """
WITH scans AS (
  SELECT vec_id AS scan_id,
         list_concat(list_concat(list_concat(list_concat(embedding, embedding), embedding), embedding), embedding) AS r
  FROM embeddings),
st AS (SELECT scan_id, r, CASE WHEN len(r) > 36 THEN len(r) // 36 ELSE 1 END AS step FROM scans),
sampled AS (SELECT scan_id, len(r) AS total_points, step,
                   list_filter(r, lambda x, i: (i - 1) % step = 0) AS s FROM st)
SELECT scan_id, CAST(total_points AS INTEGER) AS total_points, CAST(len(s) AS INTEGER) AS sampled_points,
       CAST(round(0.01 * step, 6) AS DOUBLE) AS angle_increment,
       CAST(u.i - 1 AS INTEGER) AS beam, CAST(s[u.i] AS DOUBLE) AS range
FROM sampled, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) u""",
    "diagnostics_rollup": """
WITH d AS (
  SELECT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id, event_id AS arrival_seq,
         CAST(props->>'k' AS BIGINT) AS k, CAST(props->>'k' AS BIGINT) % 3 AS l0, (CAST(props->>'k' AS BIGINT) + 1) % 2 AS l1, event_id % 3 AS l2
  FROM events WHERE event_type = 'error')
SELECT robot_id, arrival_seq,
       CASE WHEN greatest(l0, l1, l2) > 1 THEN 'warning' WHEN greatest(l0, l1, l2) > 0 THEN 'degraded'
            ELSE 'active' END AS status,
       2 AS entries, CAST(l2 AS INTEGER) AS d0_level, CAST(l1 AS INTEGER) AS d1_level,
       CASE WHEN l2 % 2 = 1 THEN CAST(arrival_seq AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS d0_volts,
       CASE WHEN l1 % 2 = 0 THEN CAST(arrival_seq AS VARCHAR) END AS d1_amps
FROM d""",
    "battery_series": with_views("battery_raw") + """,
g AS (
  SELECT *, sum(CASE WHEN percentage > 0 THEN 1 ELSE 0 END)
              OVER (PARTITION BY robot_id ORDER BY time, arrival_seq ROWS UNBOUNDED PRECEDING) AS grp
  FROM battery_raw),
i AS (
  SELECT *, first_value(CASE WHEN percentage > 0 THEN percentage * 100 END)
              OVER (PARTITION BY robot_id, grp ORDER BY time, arrival_seq) AS base,
            row_number() OVER (PARTITION BY robot_id, grp ORDER BY time, arrival_seq) AS rn
  FROM g)
SELECT robot_id, time, arrival_seq,
       round(greatest(0.0, coalesce(base, 100.0) - 0.01 * (rn - CASE WHEN grp > 0 THEN 1 ELSE 0 END)), 6) AS battery
FROM i""",
    "snapshot_2s": _snapshot_sql(),
})

# every tick of the ten minutes that end a minute before the newest row
_TICKS = """bounds AS (
  SELECT epoch_us(max(ts) - INTERVAL 11 MINUTE) AS low, epoch_us(max(ts) - INTERVAL 1 MINUTE) AS high FROM events),
ticks AS (
  SELECT robot_id, make_timestamp(CAST(t * 2000000 AS BIGINT)) AS tick
  FROM (SELECT DISTINCT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id FROM events),
       (SELECT unnest(range((low + 1999999) // 2000000, high // 2000000 + 1)) AS t FROM bounds))"""


def _newest(source: str, value: str, where: str, name: str) -> str:
    """CTE with each tick's newest row of ``source`` that ``where`` picks."""
    return f"""{name} AS (
  SELECT t.robot_id, t.tick, {value} FROM ticks t ASOF LEFT JOIN (
    SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY robot_id, time ORDER BY arrival_seq DESC) = 1) s
  ON t.robot_id = s.robot_id AND t.tick >= s.time)"""


def _dense_sql() -> str:
    parts = [_newest("channel_readings", f"s.reading AS {c}", f"channel = '{c}'", f"c_{c}") for c in _SNAP_CH]
    values = ", ".join(f"coalesce({c}, {_SNAP_DEFAULT[c]}) AS {c}" if _SNAP_DEFAULT[c] else c for c in _SNAP_CH)
    joins = " ".join(f"JOIN c_{c} USING (robot_id, tick)" for c in _SNAP_CH)
    return with_views("channel_readings").rstrip() + ",\n" + _TICKS + ",\n" + ",\n".join(parts) + f"\nSELECT robot_id, tick, {values} FROM ticks {joins}"


ORACLE["snapshot_dense"] = _dense_sql()
ORACLE["bridge_record"] = f"""
WITH {_TICKS},
e AS (
  SELECT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id, ts AS time, event_id AS arrival_seq, event_type, value, CAST(props->>'k' AS BIGINT) AS k FROM events),
islands AS (
  SELECT *, CASE WHEN arrival_seq % 4 = 0 THEN (k % 100) / 100.0 ELSE 0 END AS p,
         sum(CASE WHEN arrival_seq % 4 = 0 AND k % 100 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY robot_id ORDER BY time, arrival_seq ROWS UNBOUNDED PRECEDING) AS island
  FROM e WHERE event_type = 'signup'),
charge AS (
  SELECT robot_id, time, arrival_seq,
         greatest(0, CASE WHEN island = 0 THEN 100.0 ELSE first_value(p * 100) OVER w END - 0.01 * (row_number() OVER w - CASE WHEN island = 0 THEN 0 ELSE 1 END)) AS level
  FROM islands WINDOW w AS (PARTITION BY robot_id, island ORDER BY time, arrival_seq)),
{_newest("charge", "s.level AS battery", "true", "b")},
{_newest("e", "s.time AS last_update, s.value AS ov, s.k AS ok", "event_type = 'purchase'", "o")},
{_newest("e", "s.value AS lv", "event_type = 'view'", "l")},
{_newest("e", "s.k AS ik", "event_type = 'click'", "i")},
{_newest("e", "s.k AS dk, s.arrival_seq AS ds", "event_type = 'error'", "d")}
SELECT robot_id, tick, round(coalesce(battery, 100.0), 6) AS battery, coalesce(ov, 0.0) AS x, coalesce(CAST(ok AS DOUBLE), 0.0) AS y, coalesce(ok / 100, 0.0) AS z, CAST(1.0 AS DOUBLE) AS w,
       coalesce(sqrt(ov * ov + CAST(ok AS DOUBLE) * ok), 0.0) AS linear, coalesce(ov / 100, 0.0) AS angular,
       CASE WHEN lv IS NULL THEN 0 ELSE 40 END AS beams, round(lv + 39 / 3, 6) AS last_beam, CASE WHEN lv IS NOT NULL THEN 40 END AS sampled_points,
       coalesce(ik / 10, 0.0) AS accel_y, CASE WHEN ik IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS orient_w,
       CASE WHEN dk IS NULL THEN 'active' WHEN greatest(dk % 3, (dk + 1) % 2, ds % 3) > 1 THEN 'warning' WHEN greatest(dk % 3, (dk + 1) % 2, ds % 3) > 0 THEN 'degraded' ELSE 'active' END AS status,
       CAST(ds % 3 AS INTEGER) AS d0_level, CAST(25.0 AS DOUBLE) AS temperature, last_update, 'turtlebot3' AS robot_type
FROM ticks JOIN b USING (robot_id, tick) JOIN o USING (robot_id, tick) JOIN l USING (robot_id, tick) JOIN i USING (robot_id, tick) JOIN d USING (robot_id, tick)"""

_EDGE = with_views("edge_log")

ORACLE.update({
    "heartbeat_accepted": _EDGE + "SELECT node_id, seq, ts, epoch FROM edge_decided WHERE kind = 'heartbeat' AND epoch > 0",
    "deploy_accepted": _EDGE + "SELECT node_id, seq, model_id, epoch FROM edge_decided WHERE kind = 'deploy' AND epoch > 0",
    "deploy_rejected": _EDGE + "SELECT node_id, seq, model_id FROM edge_decided WHERE kind = 'deploy' AND epoch = 0",
    "node_list": _EDGE + "SELECT * FROM edge_nodes",
    "node_usage_latest": _EDGE + "SELECT node_id, cpu, mem FROM edge_nodes",
    "node_deployed_models": _EDGE + """,
last_register AS (
  SELECT node_id, max(epoch) AS e, max(seq) AS reg, arg_max(models, seq) AS models FROM edge_decided WHERE kind = 'register' GROUP BY 1)
SELECT node_id, i AS position, models[i] AS model_id, reg AS seq FROM (SELECT *, unnest(range(1, len(models) + 1)) AS i FROM last_register)
UNION ALL
SELECT d.node_id, len(m.models) + row_number() OVER (PARTITION BY d.node_id ORDER BY d.seq) AS position, d.model_id, d.seq
FROM edge_decided d JOIN last_register m ON d.node_id = m.node_id AND d.epoch = m.e
WHERE d.kind = 'deploy' AND d.epoch > 0""",
    "deployment_status": _EDGE + """
SELECT deployment_id, model_id, version, node_id, deployed_at, seq, config,
       CASE WHEN (SELECT as_of FROM edge_asof) >= deployed_at + INTERVAL 5 SECOND THEN 'deployed'
            ELSE 'deploying' END AS status
FROM edge_deployments""",
    "deployment_lookup": _EDGE + """
SELECT deployment_id, model_id, version, node_id, deployed_at, seq, config,
       CASE WHEN (SELECT as_of FROM edge_asof) >= deployed_at + INTERVAL 5 SECOND THEN 'deployed'
            ELSE 'deploying' END AS status
FROM edge_deployments WHERE deployment_id = (SELECT min(deployment_id) FROM edge_deployments)""",
    "edge_health": _EDGE + """
SELECT count(*) AS nodes_total,
       count(*) FILTER (WHERE last_seen > (SELECT as_of FROM edge_asof) - INTERVAL 5 MINUTE) AS nodes_active,
       (SELECT count(*) FROM edge_deployments) AS deployments,
       strftime((SELECT as_of FROM edge_asof), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM edge_nodes""",
    "registration_cache": _EDGE + """,
r AS (SELECT node_id, seq, ts, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, seq) AS nx
      FROM edge_log WHERE kind = 'register')
SELECT node_id, seq, ts AS registered_at, ts + INTERVAL 5 MINUTE AS expires_at,
       CASE WHEN nx IS NOT NULL AND nx < ts + INTERVAL 5 MINUTE THEN nx ELSE ts + INTERVAL 5 MINUTE END AS live_until
FROM r""",
    "live_registrations": _EDGE + """
SELECT node_id, arg_max(ts, seq) AS registered_at FROM edge_log WHERE kind = 'register' GROUP BY 1
HAVING arg_max(ts, seq) > (SELECT max(ts) FROM edge_log WHERE kind = 'register') - INTERVAL 5 MINUTE""",
    "node_offline_intervals": _EDGE + """,
nx AS (SELECT node_id, ts, lead(ts) OVER (PARTITION BY node_id ORDER BY ts, seq) AS next_ts FROM edge_signals)
SELECT node_id, ts AS last_seen, ts + INTERVAL 5 MINUTE AS offline_from, next_ts AS offline_until
FROM nx
WHERE (next_ts IS NOT NULL AND next_ts - ts > INTERVAL 5 MINUTE)
   OR (next_ts IS NULL AND (SELECT as_of FROM edge_asof) - ts > INTERVAL 5 MINUTE)""",
})

ORACLE["command_normalise"] = """
WITH c AS (
  SELECT o_orderkey AS command_id, 'robot-' || CAST(o_custkey AS VARCHAR) AS robot_id,
         substr(o_orderpriority, 1, 1) AS p, o_totalprice / 1000 AS lin, (o_orderkey % 7 - 3) / 10 AS ang
  FROM orders)
SELECT command_id, robot_id,
       CASE p WHEN '1' THEN 'move' WHEN '2' THEN 'move' WHEN '3' THEN 'goto' WHEN '4' THEN 'stop' ELSE 'spin' END AS type,
       CASE WHEN p IN ('1','2','4') THEN 'twist' WHEN p = '3' THEN 'goal' END AS action,
       CASE p WHEN '1' THEN lin WHEN '2' THEN 0.0 WHEN '4' THEN 0.0 END AS linear_x,
       CASE p WHEN '1' THEN ang WHEN '2' THEN 0.0 WHEN '4' THEN 0.0 END AS angular_z,
       CASE WHEN p = '3' THEN lin END AS goal_x,
       CASE WHEN p = '3' THEN CAST(0.0 AS DOUBLE) END AS goal_y,
       CASE WHEN p = '3' THEN CAST(1.0 AS DOUBLE) END AS goal_w,
       CASE WHEN p = '3' THEN 'map' END AS frame_id,
       p IN ('1','2','3','4') AS accepted
FROM c"""

ORACLE["stream_route_counts"] = ORACLE["route_counts"]
ORACLE["stream_ingest_rows"] = ORACLE["route_timeseries"]
ORACLE["stream_status_upsert"] = ORACLE["status_upsert"].replace("SELECT * FROM snapshot", "SELECT robot_id, last_seen, status, battery_level, location, active_mission, arrival_seq FROM snapshot")
# closed intervals and those still open when the input ends
ORACLE["stream_node_offline"] = ORACLE["node_offline_intervals"]

# Stream snapshots: the batch answer without each robot's last tick when the
# final watermark (max event time, in ms) has not passed it -- that tick is
# still open when the input ends.
ORACLE["stream_snapshot_2s"] = (
    "SELECT robot_id, tick, battery, temperature, imu, odometry, laser, readings FROM (\n"
    + _snapshot_sql() + "\n) s"
    + """

QUALIFY NOT (tick = max(tick) OVER (PARTITION BY robot_id)
             AND epoch_ms(tick) >= (SELECT epoch_ms(max(ts)) FROM events))"""
)

ORACLE["stream_snapshot_dense"] = ORACLE["snapshot_dense"]
ORACLE["stream_metric_rollup"] = with_views("telemetry") + """
SELECT robot_id, time_bucket(INTERVAL 1 HOUR, time) AS bucket, round(avg(CAST(value->>'k' AS DOUBLE)), 6) AS avg_value,
       min(CAST(value->>'k' AS DOUBLE)) AS min_value, max(CAST(value->>'k' AS DOUBLE)) AS max_value, count(*) AS data_points,
       CASE WHEN epoch_ms(time_bucket(INTERVAL 1 HOUR, time)) + 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) THEN 'closed' ELSE 'open' END AS state,
       CAST(0 AS BIGINT) AS late_rows
FROM telemetry WHERE json_exists(value, '$.k') GROUP BY 1, 2"""
ORACLE["stream_requests_decided"] = _EDGE + """
SELECT kind, node_id, seq, ts, model_id, epoch, kind = 'register' OR epoch > 0 AS accepted FROM edge_decided"""
ORACLE["stream_deployment_status"] = ORACLE["deployment_status"].replace("seq, config,", "seq,")
ORACLE["stream_registration_cache"] = ORACLE["registration_cache"]
ORACLE["history_indexed"] = ORACLE["history_one_robot"]
ORACLE["alert_windows"] = """
WITH health AS (
  SELECT 'robot-' || CAST(user_id AS VARCHAR) AS robot_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket,
         avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error_rate,
         quantile_disc(value * 10, 0.95) FILTER (WHERE event_id % 7 <> 0) AS p95_latency
  FROM events GROUP BY 1, 2),
broken AS (
  SELECT robot_id, bucket, 'error_rate' AS rule, error_rate AS value FROM health WHERE error_rate > 0.05
  UNION ALL SELECT robot_id, bucket, 'p95_latency', p95_latency FROM health WHERE p95_latency > 500),
runs AS (
  SELECT *, bucket - row_number() OVER (PARTITION BY robot_id, rule ORDER BY bucket) * INTERVAL 6 HOUR AS run FROM broken)
SELECT robot_id, rule, min(bucket) AS alert_from, max(bucket) + INTERVAL 6 HOUR AS alert_until, count(*) AS buckets, round(max(value), 6) AS worst
FROM runs GROUP BY robot_id, rule, run"""
