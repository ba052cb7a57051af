"""The adapter views of ``roverlake.sources.adapters`` written as SQL CTEs.

Used by the independent oracle (DuckDB) to rebuild the same fleet inputs
from the same test tables. Each entry is ``name AS (SELECT ...)``.
"""

from __future__ import annotations

_K = "CAST(props->>'k' AS BIGINT)"
_RID = "'robot-' || CAST(user_id AS VARCHAR)"
_TS_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"

VIEWS = {
    "telemetry": f"""telemetry AS (
  SELECT event_id AS arrival_seq, ts AS time, {_RID} AS robot_id, 'unknown' AS sensor_id,
         CASE event_type WHEN 'view' THEN 'telemetry' WHEN 'click' THEN 'imu' WHEN 'purchase' THEN 'odometry'
                         WHEN 'signup' THEN 'status' WHEN 'error' THEN 'diagnostics' END AS data_type,
         props AS value, '{{}}' AS metadata
  FROM events)""",
    "robots": """robots AS (
  SELECT CASE WHEN c_acctbal < 0 THEN 'spare-' ELSE 'robot-' END || CAST(c_custkey AS VARCHAR) AS robot_id,
         c_name AS name, c_mktsegment AS type
  FROM customer)""",
    "envelope_raw": f"""envelope_parts AS (
  SELECT event_id, ts, event_id % 16 AS fault, CASE WHEN event_id % 16 >= 14 THEN (event_id // 128) % 8 ELSE 0 END AS odd,
    CASE WHEN event_id % 16 = 9 THEN '"robot_id":null'
         ELSE '"robot_id":"' || CASE WHEN event_id % 16 = 10 THEN 'robot-' || repeat('x', 54) ELSE {_RID} END || '"' END AS robot,
    CASE event_id % 16 WHEN 5 THEN NULL WHEN 6 THEN '"sensor_id":null'
         ELSE '"sensor_id":"sensor-' || CASE WHEN event_id % 16 >= 14 AND (event_id // 128) % 8 = 6 THEN '\\u0041' ELSE CAST(event_id % 3 AS VARCHAR) END || '"' END AS sensor,
    CASE event_id % 16 WHEN 4 THEN NULL WHEN 3 THEN '"data_type":null' WHEN 2 THEN '"data_type":"bogus"'
         ELSE '"data_type":"' || ['telemetry','sensor_image','point_cloud','imu','odometry','diagnostics','command','status'][CAST((event_id // 16) % 8 AS INTEGER) + 1] || '"' END AS dtype,
    CASE event_id % 16 WHEN 0 THEN NULL WHEN 1 THEN '"timestamp":"not-a-date"' WHEN 13 THEN '"timestamp":"2025"'
         ELSE '"timestamp":"' || {_TS_TEXT} || '"' END AS stamped,
    CASE event_id % 16 WHEN 7 THEN NULL WHEN 8 THEN 'null'
         ELSE CASE CASE WHEN event_id % 16 >= 14 THEN (event_id // 128) % 8 ELSE 0 END
              WHEN 2 THEN '{{"k":NaN}}' WHEN 4 THEN '{{"k":' || repeat('123456789', 5) || '}}' WHEN 5 THEN '{{ "k" :' || chr(9) || '7 }}' WHEN 7 THEN '{{"k":0,"k":5}}'
              ELSE props END END AS data_text
  FROM events),
envelope_raw AS (
  SELECT CASE fault WHEN 11 THEN '[1,2]' WHEN 12 THEN '{{bad' ELSE
      CASE odd WHEN 5 THEN chr(10) || ' {{' || chr(9) ELSE '{{' END
      || concat_ws(',', CASE odd WHEN 1 THEN '"robot_id":"ghost"' END, robot, sensor, dtype, stamped, '"data":' || data_text, '"metadata":{{}}')
      || CASE odd WHEN 5 THEN ' }}' || chr(10) WHEN 3 THEN '}} x' ELSE '}}' END END AS raw,
    -- what an odd message decodes to, for JSON functions that do not read it; data is taken from data_text
    CASE WHEN fault = 11 THEN '[1,2]' WHEN fault = 12 OR odd = 3 THEN '{{bad' ELSE '{{' || concat_ws(',', robot, sensor, dtype, stamped, '"data":0', '"metadata":{{}}') || '}}' END AS plain,
    odd, data_text, event_id AS arrival_seq, ts AS received_at
  FROM envelope_parts)""",
    "status_events": f"""status_events AS (
  SELECT {_RID} AS robot_id, ts AS time,
         (event_id * 7919) % 100003 + (event_id // 100003) * 100003 AS arrival_seq,
         '{{' || concat_ws(',',
           CASE WHEN event_id % 11 = 0 THEN NULL
                ELSE '"status":"' || ['online','offline','error','charging','maintenance'][CAST(event_id % 5 AS INTEGER) + 1] || '"' END,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE '"battery_level":' || CAST(least(value, 100.0) AS VARCHAR) END,
           '"location":' || props,
           CASE WHEN event_id % 3 = 0 THEN '"active_mission":null'
                ELSE '"active_mission":"mission-' || CAST({_K} AS VARCHAR) || '"' END) || '}}' AS data, props AS location_text
  FROM events WHERE event_type = 'signup')""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n"

VIEWS["http_body"] = f"""http_body AS (
  SELECT {_RID} AS robot_id, ts + to_milliseconds(event_id % 250) AS received_at,
         CASE WHEN event_id % 2 = 1 THEN '{{"timestamp":"' || {_TS_TEXT} || '","data":' || props || '}}'
              ELSE '{{"data":' || props || '}}' END AS body,
         event_id AS arrival_seq, props AS data_text
  FROM events)"""

VIEWS["blobs_in"] = """blobs_in AS (
  SELECT 'robot-' || CAST(page_id % 10 AS VARCHAR) AS robot_id, 'cam0' AS sensor_id, 'sensor_image' AS data_type,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(page_id // 20 * 20 AS BIGINT)) AS ts,
         to_json(struct_pack(content := html)) AS data, page_id * 2 AS arrival_seq
  FROM pages
  UNION ALL
  SELECT 'robot-' || CAST(doc_id % 10 AS VARCHAR), 'lidar0', 'point_cloud',
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id // 20 * 20 AS BIGINT)),
         to_json(struct_pack(content := text)), doc_id * 2 + 1
  FROM documents)"""

# Envelope parsed with DuckDB's JSON functions; reject reasons in the same order
# as the library's.
VIEWS["envelope_parsed"] = """envelope_j AS (
  SELECT arrival_seq, raw, odd, data_text, CASE WHEN json_valid(plain) THEN CAST(plain AS JSON) END AS j FROM envelope_raw),
envelope_k AS (
  SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS keys FROM envelope_j),
envelope_f AS (
  SELECT arrival_seq, raw, odd, j, keys,
    j->>'robot_id' AS robot_id,
    CASE WHEN list_contains(keys, 'sensor_id') THEN j->>'sensor_id' ELSE 'unknown' END AS sensor_id,
    CASE WHEN NOT list_contains(keys, 'data_type') THEN 'telemetry'
         WHEN json_type(j, '$.data_type') = 'VARCHAR' AND j->>'data_type' IN
              ('telemetry','sensor_image','point_cloud','imu','odometry','diagnostics','command','status')
         THEN j->>'data_type' END AS data_type,
    CASE WHEN json_type(j, '$.timestamp') = 'VARCHAR' AND regexp_matches(j->>'timestamp', '^\\d{4}-\\d{2}-\\d{2}')
         THEN TRY_CAST(j->>'timestamp' AS TIMESTAMP) END AS ts,
    coalesce(data_text, '{}') AS data,
    CASE WHEN list_contains(keys, 'metadata') THEN coalesce(CAST(j->'metadata' AS VARCHAR), 'null') ELSE '{}' END AS metadata
  FROM envelope_k),
envelope_parsed AS (
  SELECT *, CASE
    WHEN j IS NULL THEN 'malformed_json'
    WHEN keys IS NULL THEN 'not_object'
    WHEN data_type IS NULL THEN 'bad_data_type'
    WHEN ts IS NULL THEN 'bad_timestamp'
    WHEN data_type IN ('telemetry','imu','odometry','status') AND odd = 2 THEN 'not_storable'
    WHEN data_type IN ('telemetry','imu','odometry','status') AND robot_id IS NULL THEN 'missing_robot_id'
    WHEN data_type IN ('telemetry','imu','odometry','status') AND length(robot_id) > 50 THEN 'robot_id_too_long'
    WHEN data_type IN ('telemetry','imu','odometry','status') AND coalesce(length(sensor_id), 0) > 50 THEN 'sensor_id_too_long'
    WHEN data_type = 'status' AND coalesce(json_type(TRY_CAST(data AS JSON)), '') <> 'OBJECT' THEN 'bad_status_payload'
    END AS reject_reason
  FROM envelope_f)"""

VIEWS["payloads"] = f"""payloads AS (
  SELECT {_RID} AS robot_id, ts AS time, event_id AS arrival_seq,
    '{{' || concat_ws(',',
      CASE event_id % 6
        WHEN 0 THEN '"battery":' || CAST(value AS VARCHAR)
        WHEN 1 THEN '"battery":"' || CAST({_K} AS VARCHAR) || '"'
        WHEN 2 THEN NULL
        WHEN 3 THEN '"position":{{"x":' || CAST(value AS VARCHAR) || ',"y":' || CAST({_K} AS VARCHAR) || ',"z":0}}'
        WHEN 4 THEN '"position":{{"x":' || CAST(value AS VARCHAR) || '}}'
        ELSE '"position":' || CAST({_K} AS VARCHAR) END,
      CASE WHEN event_id % 2 = 0 THEN '"status":"active"' ELSE '"status":' || CAST({_K} AS VARCHAR) END,
      '"temperature":25.0') || '}}' AS data
  FROM events)"""

VIEWS["battery_raw"] = f"""battery_raw AS (
  SELECT {_RID} AS robot_id, ts AS time, event_id AS arrival_seq,
         CASE WHEN event_id % 4 = 0 THEN ({_K} % 100) / 100.0 ELSE 0.0 END AS percentage
  FROM events)"""

VIEWS["channel_readings"] = f"""channel_readings AS (
  SELECT {_RID} AS robot_id, ts AS time, event_id AS arrival_seq,
         CASE event_type WHEN 'view' THEN 'battery' WHEN 'click' THEN 'imu' WHEN 'purchase' THEN 'odometry'
                         WHEN 'signup' THEN 'temperature' WHEN 'error' THEN 'laser' END AS channel,
         value AS reading
  FROM events)"""

VIEWS["edge_log"] = f"""edge_log AS (
  SELECT CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'deploy' ELSE 'heartbeat' END AS kind,
         'node-' || CAST(user_id AS VARCHAR) AS node_id, event_id AS seq, ts,
         CASE event_type WHEN 'error' THEN 'degraded' ELSE 'active' END AS status, least(value, 100.0) AS cpu, CAST({_K} AS DOUBLE) AS mem,
         'model-' || CAST(event_id % 9 AS VARCHAR) AS model_id, '1.0' AS version,
         CASE WHEN event_type = 'signup' THEN 'edge-' || (event_id % 7) END AS name,
         CASE WHEN event_type = 'signup' THEN '10.0.' || (event_id % 4) || '.' || (user_id % 250) END AS ip,
         CAST(event_id % 8 + 4 AS INTEGER) AS cpu_cores,
         CASE WHEN event_type <> 'error' THEN (event_id % 5 + 1) * CAST(8 AS DOUBLE) ELSE 0 END AS memory_gb,
         CASE WHEN event_id % 3 <> 0 THEN (event_id % 2 + 1) * CAST(12 AS DOUBLE) ELSE 0 END AS gpu_memory_gb,
         value * 10 AS disk_gb,
         CASE WHEN event_type <> 'signup' THEN [] WHEN event_id % 4 = 2 THEN ['base-a-' || (event_id % 3)]
              WHEN event_id % 4 = 3 THEN ['base-a-' || (event_id % 3), 'base-b-' || (event_id % 3)] ELSE [] END AS models,
         CASE WHEN event_type = 'purchase' THEN props END AS config
  FROM events),
edge_decided AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'register' THEN 1 ELSE 0 END)
              OVER (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM edge_log),
edge_asof AS (SELECT max(ts) AS as_of FROM edge_log),
edge_signals AS (
  SELECT * FROM edge_decided WHERE kind = 'register' OR (kind = 'heartbeat' AND epoch > 0)),
edge_nodes AS (
  SELECT node_id,
         CASE WHEN (SELECT as_of FROM edge_asof) - arg_max(ts, seq) > INTERVAL 5 MINUTE THEN 'offline'
              WHEN arg_max(kind, seq) = 'register' THEN 'active' ELSE arg_max(status, seq) END AS status,
         arg_max(cpu, seq) AS cpu, arg_max(mem, seq) AS mem, max(ts) AS last_seen,
         max(ts) FILTER (WHERE kind = 'register') AS registered_at,
         max(epoch) AS epoch,
         arg_max(name, seq) FILTER (WHERE kind = 'register') AS name, arg_max(ip, seq) FILTER (WHERE kind = 'register') AS ip,
         arg_max(cpu_cores, seq) AS cpu_cores, arg_max(memory_gb, seq) AS memory_gb, arg_max(gpu_memory_gb, seq) AS gpu_memory_gb, arg_max(disk_gb, seq) AS disk_gb
  FROM edge_signals GROUP BY node_id),
edge_deployments AS (
  SELECT model_id || '-' || node_id || '-' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS deployment_id,
         arg_max(model_id, seq) AS model_id, arg_max(version, seq) AS version, arg_max(node_id, seq) AS node_id,
         arg_max(ts, seq) AS deployed_at, max(seq) AS seq, arg_max(config, seq) AS config
  FROM edge_decided WHERE kind = 'deploy' AND epoch > 0 GROUP BY 1)"""
