"""Operators against hand-made rows and sequential Python models."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roverlake.operators import edge, envelope as env, scan, sensors as sens, status as st, telemetry as tel

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)


def _tel(spark, rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(seconds=s), "r1", "unknown", "telemetry", v, "{}", i) for i, (s, v) in enumerate(rows)],
        "time timestamp_ntz, robot_id string, sensor_id string, data_type string, value string, metadata string, arrival_seq long",
    )


def test_rollup_horizon_is_strict_and_nulls_counted(spark):
    as_of = T0 + dt.timedelta(hours=24)
    df = _tel(spark, [(0, '{"k":5}'), (60, '{"k":1}'), (120, '{"k":null}'), (180, '{"k":"85"}'),
                      (240, '{"k":true}'), (300, "{}"), (360, "[]"), (420, "bad{"), (480, None)])
    out = tel.aggregate_metrics(df, "k", "1 hour", as_of=F.lit(as_of), robot_id="r1").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.avg_value, r.min_value, r.max_value, r.data_points) == (43.0, 1.0, 85.0, 4)


def test_history_bounds_inclusive_newest_first(spark):
    df = _tel(spark, [(0, "{}"), (10, "{}"), (20, "{}"), (30, "{}")])
    out = tel.query_telemetry(df, T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=30), robot_id="r1").collect()
    assert [r.arrival_seq for r in out] == [3, 2, 1]
    typed = tel.query_telemetry(df, T0, T0 + dt.timedelta(seconds=30), robot_id="r1", data_type="").count()
    assert typed == 4


def _status(spark, rows):
    return spark.createDataFrame(
        [("r1", T0 + dt.timedelta(seconds=s), seq, d) for s, seq, d in rows],
        "robot_id string, time timestamp_ntz, arrival_seq long, data string",
    )


def test_status_upsert_whole_row_and_order(spark):
    rows = [(10, 1, '{"status":"online","battery_level":90,"active_mission":"m1","location":{"x":1}}'),
            (20, 2, '{"battery_level":null}'),
            (5, 3, '{"status":"error"}')]  # late, older message arrives last
    df = st.status_rows(_status(spark, rows))
    arrival = st.upsert_status(df).first()
    assert (arrival.status, arrival.battery_level, arrival.active_mission, arrival.location) == ("error", None, None, "{}")
    assert arrival.last_seen == T0 + dt.timedelta(seconds=5)
    event = st.upsert_status(df, order="event_time").first()
    assert (event.status, event.battery_level, event.last_seen) == ("unknown", None, T0 + dt.timedelta(seconds=20))


def test_status_upsert_with_previous_snapshot(spark):
    first = st.upsert_status(st.status_rows(_status(spark, [(10, 1, '{"status":"online"}')])))
    second = st.upsert_status(st.status_rows(_status(spark, [(20, 2, '{"status":"charging"}')])), previous=first)
    assert second.first().status == "charging"


def test_envelope_rejects_overlong_status(spark):
    raws = ['{"robot_id":"r1","data_type":"status","timestamp":"2025-01-01T00:00:00","data":{"status":"%s"}}' % ("x" * 21),
            '{"robot_id":"r1","data_type":"status","timestamp":"2025-01-01T00:00:00","data":{"status":"%s"}}' % ("x" * 20),
            '{"robot_id":"r1","data_type":"status","timestamp":"2025-01-01T00:00:00","data":{"battery_level":"abc"}}',
            '{"robot_id":"r1","data_type":"status","timestamp":"2025-01-01T00:00:00","data":[1]}',
            '{"robot_id":null,"data_type":"command","timestamp":"2025-01-01T00:00:00"}',
            '{"robot_id":"r1","timestamp":"2025-01-01T00:00:00","data":"abc","metadata":[1, 2]}']
    df = spark.createDataFrame([(r, i) for i, r in enumerate(raws)], "raw string, arrival_seq long")
    out = env.parse_envelope(df).orderBy("arrival_seq").collect()
    assert [r.reject_reason for r in out] == ["status_too_long", None, "bad_battery_level", "bad_status_payload", None, None]
    assert (out[5].data_type, out[5].sensor_id, out[5].data, out[5].metadata) == ("telemetry", "unknown", '"abc"', "[1, 2]")  # slices of the message


def _battery_model(ps):
    b, out = 100.0, []
    for p in ps:
        b = p * 100 if p > 0 else max(0, b - 0.01)
        out.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_battery_series_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    rows, expect = [], {}
    for robot, n in (("hot", 3000), ("a", 40), ("b", 1)):
        ps = [0.0 if rnd.random() < 0.8 else round(rnd.random(), 2) for _ in range(n)]
        if robot == "a":
            ps[0] = 0.0
        times = sorted(T0 + dt.timedelta(seconds=rnd.randint(0, 3 * 3600)) for _ in range(n))
        for i, (t, p) in enumerate(zip(times, ps)):
            rows.append((robot, t, i, p))
        expect[robot] = _battery_model(ps)
    df = spark.createDataFrame(rows, "robot_id string, time timestamp_ntz, arrival_seq long, percentage double")
    out = sens.battery_series(df, chunk="10 minutes").orderBy("robot_id", "time", "arrival_seq").collect()
    got = {}
    for r in out:
        got.setdefault(r.robot_id, []).append(r.battery)
    for robot, vals in expect.items():
        assert got[robot] == pytest.approx(vals, abs=1e-9)


def test_battery_floor_after_many_zeros(spark):
    rows = [("r", T0 + dt.timedelta(seconds=i), i, 0.0) for i in range(10_050)]
    df = spark.createDataFrame(rows, "robot_id string, time timestamp_ntz, arrival_seq long, percentage double")
    last = sens.battery_series(df).orderBy(F.desc("arrival_seq")).first()
    assert last.battery == 0.0


def test_running_scan_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = [(k, T0 + dt.timedelta(seconds=rnd.randint(0, 7200)), i, rnd.choice([None, rnd.random()]))
            for i in range(4000) for k in [rnd.choice(["hot"] * 8 + ["x", "y"])]]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, s long, v double")
    got = scan.running(df, "k", ("t", "s"), scan.chunk_of("t", "5 minutes"),
                       sums={"n": F.lit(1).cast("long")}, lasts={"f": F.col("v")})
    w = Window.partitionBy("k").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count(F.lit(1)).over(w), "f": F.last("v", ignorenulls=True).over(w)})
    a = sorted((r.s, r.n, r.f) for r in got.collect())
    b = sorted((r.s, r.n, r.f) for r in want.collect())
    assert a == b
    nxt = scan.next_value(df, "k", ("t", "s"), scan.chunk_of("t", "5 minutes"), "s", "ns")
    w2 = Window.partitionBy("k").orderBy("t", "s")
    want2 = df.withColumn("ns", F.lead("s").over(w2))
    assert sorted((r.s, r.ns) for r in nxt.collect()) == sorted((r.s, r.ns) for r in want2.collect())


def _edge_model(log):
    nodes, deps = {}, {}
    decisions = []
    for kind, node, seq, ts, status, cpu, mem, model in sorted(log, key=lambda r: r[2]):
        if kind == "register":
            nodes[node] = {"status": "active", "cpu": cpu, "mem": mem, "last_seen": ts, "models": []}
            decisions.append((seq, True))
        elif node not in nodes:
            decisions.append((seq, False))
        elif kind == "heartbeat":
            nodes[node].update(status=status, cpu=cpu, mem=mem, last_seen=ts)
            decisions.append((seq, True))
        else:
            did = f"{model}-{node}-{int(ts.replace(tzinfo=dt.timezone.utc).timestamp())}"
            deps[did] = (model, node, seq)
            nodes[node]["models"].append(model)
            decisions.append((seq, True))
    return nodes, deps, dict(decisions)


def test_edge_state_equals_sequential_model(spark):
    rnd = random.Random(3)
    log, t = [], T0
    for seq in range(1500):
        t += dt.timedelta(seconds=rnd.choice([0, 1, 2, 30, 400]))
        node = rnd.choice(["n-hot"] * 6 + ["n1", "n2", "n3"])
        kind = rnd.choice(["register"] + ["heartbeat"] * 4 + ["deploy"] * 3)
        log.append((kind, node, seq, t, rnd.choice(["active", "busy"]), float(rnd.randint(0, 100)),
                    float(rnd.randint(0, 64)), f"m{rnd.randint(0, 3)}"))
    df = spark.createDataFrame(log, "kind string, node_id string, seq long, ts timestamp_ntz, status string, "
                                    "cpu double, mem double, model_id string").withColumn("version", F.lit("1"))
    nodes, deps, decisions = _edge_model(log)
    decided = edge.requests_decided(df)
    assert {r.seq: r.accepted for r in decided.collect()} == decisions
    as_of = F.lit(T0 - dt.timedelta(days=1)).cast("timestamp_ntz")  # before everything: no offline override
    cur = {r.node_id: r for r in edge.current_nodes(df, as_of).collect()}
    assert set(cur) == set(nodes)
    for n, s in nodes.items():
        assert (cur[n].status, cur[n].cpu, cur[n].mem, cur[n].last_seen) == (s["status"], s["cpu"], s["mem"], s["last_seen"])
    models = {}
    for r in edge.deployed_models(decided).orderBy("node_id", "position").collect():
        models.setdefault(r.node_id, []).append(r.model_id)
    assert {n: s["models"] for n, s in nodes.items() if s["models"]} == models
    got_deps = {r.deployment_id: (r.model_id, r.node_id, r.seq) for r in edge.deployments(df, as_of).collect()}
    assert got_deps == deps


def test_liveness_boundaries(spark):
    gaps = [dt.timedelta(minutes=5), dt.timedelta(minutes=5, milliseconds=1), dt.timedelta(minutes=5) - dt.timedelta(milliseconds=1)]
    log, t = [("register", "n", 0, T0)], T0
    for i, g in enumerate(gaps, start=1):
        t = t + g
        log.append(("heartbeat", "n", i, t))
    df = spark.createDataFrame(log, "kind string, node_id string, seq long, ts timestamp_ntz").withColumns(
        {"status": F.lit("active"), "cpu": F.lit(1.0), "mem": F.lit(1.0), "model_id": F.lit("m"), "version": F.lit("1")})
    out = edge.offline_intervals(df).collect()
    assert len(out) == 1 and out[0].last_seen == T0 + gaps[0]
    nodes = edge.current_nodes(df, F.lit(t + dt.timedelta(minutes=5)).cast("timestamp_ntz"))
    h = edge.health(nodes, edge.deployments(df, F.lit(t)), F.lit(t + dt.timedelta(minutes=5)).cast("timestamp_ntz")).first()
    assert (h.nodes_total, h.nodes_active) == (1, 0)
    h2 = edge.health(nodes, edge.deployments(df, F.lit(t)),
                     F.lit(t + dt.timedelta(minutes=5) - dt.timedelta(milliseconds=1)).cast("timestamp_ntz")).first()
    assert h2.nodes_active == 1


def test_deployment_delay_exactly_five_seconds(spark):
    log = [("register", "n", 0, T0), ("deploy", "n", 1, T0 + dt.timedelta(seconds=1))]
    df = spark.createDataFrame(log, "kind string, node_id string, seq long, ts timestamp_ntz").withColumns(
        {"status": F.lit("active"), "cpu": F.lit(1.0), "mem": F.lit(1.0), "model_id": F.lit("m"), "version": F.lit("1")})
    at = lambda s: F.lit(T0 + dt.timedelta(seconds=s)).cast("timestamp_ntz")
    assert edge.deployments(df, at(6)).first().status == "deployed"
    assert edge.deployments(df, at(5.999)).first().status == "deploying"
    assert edge.deployment_status(edge.deployments(df, at(6)), "nope").count() == 0


def test_snapshot_ticks(spark):
    rows = [("r", T0 + dt.timedelta(seconds=1), 0, "battery", 50.0),
            ("r", T0 + dt.timedelta(seconds=2), 1, "temperature", 30.0),   # exactly on a tick
            ("r", T0 + dt.timedelta(seconds=7, milliseconds=5), 2, "battery", 40.0)]
    df = spark.createDataFrame(rows, "robot_id string, time timestamp_ntz, arrival_seq long, channel string, reading double")
    out = sens.snapshots(df, {"battery": 100.0, "temperature": 25.0, "laser": None}).orderBy("tick").collect()
    assert [(r.tick, r.battery, r.temperature, r.laser, r.readings) for r in out] == [
        (T0 + dt.timedelta(seconds=2), 50.0, 30.0, None, 2),
        (T0 + dt.timedelta(seconds=8), 40.0, 30.0, None, 1),
    ]


def test_online_setters(spark):
    df = spark.createDataFrame([("r", "charging", T0)], "robot_id string, status string, last_seen timestamp_ntz")
    later = F.lit(T0 + dt.timedelta(hours=1)).cast("timestamp_ntz")
    on = st.set_online(df, later).first()
    assert (on.status, on.last_seen) == ("online", T0 + dt.timedelta(hours=1))
    off = st.set_offline(st.set_online(df, later)).first()
    assert (off.status, off.last_seen) == ("offline", T0 + dt.timedelta(hours=1))
    assert [r.o for r in df.select(st.is_online("status").alias("o")).collect()] == [False]


def test_time_range_prunes_event_date_partitions(spark, tmpdir_path):
    from roverlake.sources import sinks

    rows = _tel(spark, [(d * 86400, "{}") for d in range(5)])
    sinks.write_timeseries(rows, f"{tmpdir_path}/ts")
    table = spark.read.parquet(f"{tmpdir_path}/ts")
    out = tel.time_range(table, T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2))
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_registration_cache_agrees_with_live_view(spark):
    log = [("register", "n1", 0, T0), ("register", "n1", 1, T0 + dt.timedelta(minutes=2)),
           ("register", "n2", 2, T0 + dt.timedelta(minutes=1)), ("heartbeat", "n2", 3, T0 + dt.timedelta(minutes=9))]
    df = spark.createDataFrame(log, "kind string, node_id string, seq long, ts timestamp_ntz")
    cache = edge.registration_cache(df).orderBy("seq").collect()
    assert [r.live_until for r in cache] == [T0 + dt.timedelta(minutes=2), T0 + dt.timedelta(minutes=7),
                                             T0 + dt.timedelta(minutes=6)]
    at = T0 + dt.timedelta(minutes=6, seconds=30)
    live = {r.node_id for r in edge.live_registrations(df, F.lit(at).cast("timestamp_ntz")).collect()}
    assert live == {r.node_id for r in cache if r.registered_at <= at < r.live_until} == {"n1"}


def test_hot_key_scan_uses_many_tasks(spark):
    """One key holding every row: the chunked scan still spreads it over tasks."""
    rows = [("hot", T0 + dt.timedelta(seconds=37 * i), i, 1.0) for i in range(4000)]  # ~41 hours
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, s long, v double")
    out = scan.running(df, "k", ("t", "s"), scan.chunk_of("t", "1 hour"), sums={"n": F.col("v")})
    parts = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    assert out.agg(F.max("n")).first()[0] == 4000.0


def test_history_and_rollup_prune_date_partitions(spark, tmpdir_path):
    from roverlake.sources import sinks

    rows = _tel(spark, [(d * 86400, '{"k":%d}' % d) for d in range(6)])
    sinks.write_timeseries(rows, f"{tmpdir_path}/ts")
    table = spark.read.parquet(f"{tmpdir_path}/ts")
    hist = tel.query_telemetry(table, T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=3), robot_id="r1")
    assert [r.arrival_seq for r in hist.collect()] == [3, 2]
    roll = tel.aggregate_metrics(table, "k", "1 day", as_of=F.lit(T0 + dt.timedelta(days=5, hours=1)).cast("timestamp_ntz"),
                                 horizon="48 hours", robot_id="r1")
    assert sorted(r.max_value for r in roll.collect()) == [4.0, 5.0]
    for df in (hist, roll):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan


def test_dashboard_counters_and_robot_list(spark):
    from roverlake.operators import dashboard as dash

    snap = spark.createDataFrame(
        [("r1", "online", 90.0, T0), ("r2", "ONLINE", 20.0, T0), ("r3", None, None, T0), ("r4", "charging", 20.01, T0)],
        "robot_id string, status string, battery_level double, last_seen timestamp_ntz")
    tel_rows = _tel(spark, [(-1, "{}"), (0, "{}"), (3600, "{}")])  # 11:59:59, 12:00, 13:00 on T0's day
    as_of = F.lit(T0 + dt.timedelta(hours=12)).cast("timestamp_ntz")  # 00:00 of the next day: nothing "today"
    s = dash.dashboard_stats(snap, tel_rows, as_of).first()
    assert (s.robots_total, s.robots_online, s.robots_offline, s.system_health) == (4, 1, 3, 0.25)
    assert (s.total_messages, s.today_messages) == (3, 0)
    robots = spark.createDataFrame([("r1", "a", "t"), ("r2", "b", "t"), ("r9", "c", "t")], "robot_id string, name string, type string")
    rl = {r.robot_id: (r.is_online, r.battery_ok) for r in dash.robot_list(robots, snap).collect()}
    assert rl == {"r1": (True, True), "r2": (False, False), "r9": (False, None)}


def test_whole_node_row_and_model_list(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = ("kind string, node_id string, seq long, ts timestamp_ntz, status string, cpu double, mem double, model_id string, version string, name string, ip string, "
              "cpu_cores int, memory_gb double, gpu_memory_gb double, disk_gb double, models array<string>, config string")
    reg = lambda seq, name, cores, gpu, models: ("register", "n", seq, at(seq), None, 1.0, 2.0, None, None, name, "10.0.0.1", cores, 8.0, gpu, 100.0, models, None)
    deploy = lambda seq, model, config: ("deploy", "n", seq, at(seq), None, None, None, model, "1", None, None, None, None, None, None, None, config)
    beat = ("heartbeat", "n", 6, at(6), "busy", 3.0, 4.0, None, None, None, None, 4, None, None, 90.0, None, None)
    rows = [deploy(0, "early", "{}"), reg(1, "old", 2, 12.0, ["x"]), deploy(2, "m1", '{"a": 1}'), reg(3, "new", 8, 24.0, ["b", "a", "b"]), deploy(4, "m2", None), deploy(5, "m2", '{"a": 2}'), beat]
    log = spark.createDataFrame(rows, schema)
    node = edge.current_nodes(log, F.lit(at(10)).cast("timestamp_ntz")).first()
    assert (node["name"], node.ip, node.status, node.cpu_cores, node.memory_gb, node.gpu_memory_gb, node.disk_gb, node.cpu, node.mem) == ("new", "10.0.0.1", "busy", 4, 0.0, 0.0, 90.0, 3.0, 4.0)
    models = edge.deployed_models(edge.requests_decided(log)).orderBy("position").collect()
    assert [(r.position, r.model_id, r.seq) for r in models] == [(1, "b", 3), (2, "a", 3), (3, "b", 3), (4, "m2", 4), (5, "m2", 5)]
    assert {(r.seq, r.config) for r in edge.deployments(log, F.lit(at(10)).cast("timestamp_ntz")).collect()} == {(2, '{"a": 1}'), (4, None), (5, '{"a": 2}')}
    bare = log.select("kind", "node_id", "seq", "ts", "status", "cpu", "mem", "model_id", "version")
    node = edge.current_nodes(bare, F.lit(at(10)).cast("timestamp_ntz")).first()
    assert (node["name"], node.ip, node.cpu_cores, node.disk_gb) == ("", "", 0, 0.0)
    assert [r.model_id for r in edge.deployed_models(edge.requests_decided(bare)).orderBy("position").collect()] == ["m2", "m2"]
