"""Property test: the chunked scans equal plain per-key windows for any data
and any chunk width (ties in time, nulls, empty chunks, one hot key)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from roverlake.operators import scan

T0 = dt.datetime(2024, 5, 1)

rows_strategy = st.lists(
    st.tuples(
        st.sampled_from(["hot", "hot", "hot", "a", "b"]),
        st.integers(min_value=0, max_value=6 * 3600),
        st.one_of(st.none(), st.floats(min_value=-5, max_value=5, allow_nan=False)),
    ),
    min_size=1, max_size=120,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, width=st.sampled_from(["1 minute", "17 minutes", "1 hour", "1 day"]))
def test_chunked_scan_equals_window(spark, rows, width):
    data = [(k, T0 + dt.timedelta(seconds=s), i, v) for i, (k, s, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, s long, v double")
    got = scan.running(df, "k", ("t", "s"), scan.chunk_of("t", width),
                       sums={"n": F.lit(1).cast("long"), "pos": F.when(F.col("v") > 0, 1).otherwise(0).cast("long")},
                       lasts={"f": F.col("v")})
    got = scan.next_value(got, "k", ("t", "s"), scan.chunk_of("t", width), "s", "nx")
    w = Window.partitionBy("k").orderBy("t", "s")
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({
        "n": F.count(F.lit(1)).over(cum),
        "pos": F.sum(F.when(F.col("v") > 0, 1).otherwise(0)).over(cum),
        "f": F.last("v", ignorenulls=True).over(cum),
        "nx": F.lead("s").over(w),
    })
    key = lambda r: (r.s, r.n, r.pos, r.f, r.nx)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def _battery_model(ps):
    b, out = 100.0, []
    for p in ps:
        b = p * 100 if p > 0 else max(0, b - 0.01)
        out.append(b)
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from(["hot", "hot", "x"]), st.integers(0, 4 * 3600),
                            st.sampled_from([0.0, 0.0, 0.0, -0.5, 0.25, 0.9])), min_size=1, max_size=150),
    width=st.sampled_from(["1 minute", "13 minutes", "1 day"]),
)
def test_battery_series_equals_sequential_model(spark, rows, width):
    from roverlake.operators import sensors

    data = [(k, T0 + dt.timedelta(seconds=s), i, p) for i, (k, s, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "robot_id string, time timestamp_ntz, arrival_seq long, percentage double")
    got = {(r.robot_id, r.arrival_seq): r.battery for r in sensors.battery_series(df, chunk=width).collect()}
    for robot in {k for k, _, _ in rows}:
        mine = sorted((t, i, p) for (k, t, i, p) in data if k == robot)
        want = _battery_model([p for _, _, p in mine])
        assert [round(got[(robot, i)], 9) for _, i, _ in mine] == [round(w, 9) for w in want]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(log=st.lists(st.tuples(st.sampled_from(["register", "heartbeat", "heartbeat", "deploy", "deploy"]),
                              st.sampled_from(["n-hot", "n-hot", "n1"]),
                              st.sampled_from([0, 0, 1, 400]),
                              st.sampled_from(["m0", "m1"]),
                              st.integers(0, 100)), min_size=1, max_size=80))
def test_edge_state_equals_sequential_model(spark, log):
    from test_operators import _edge_model

    from roverlake.operators import edge

    rows, t = [], T0
    for seq, (kind, node, gap, model, cpu) in enumerate(log):
        t = t + dt.timedelta(seconds=gap)
        rows.append((kind, node, seq, t, "busy", float(cpu), float(seq), model))
    df = spark.createDataFrame(rows, "kind string, node_id string, seq long, ts timestamp_ntz, status string, "
                                     "cpu double, mem double, model_id string").withColumn("version", F.lit("1"))
    nodes, deps, decisions = _edge_model(rows)
    assert {r.seq: r.accepted for r in edge.requests_decided(df).collect()} == decisions
    early = F.lit(T0 - dt.timedelta(days=1)).cast("timestamp_ntz")
    cur = {r.node_id: (r.status, r.cpu, r.mem, r.last_seen) for r in edge.current_nodes(df, early).collect()}
    assert cur == {n: (s["status"], s["cpu"], s["mem"], s["last_seen"]) for n, s in nodes.items()}
    models = {}
    for r in edge.deployed_models(edge.requests_decided(df)).orderBy("node_id", "position").collect():
        models.setdefault(r.node_id, []).append(r.model_id)
    assert models == {n: s["models"] for n, s in nodes.items() if s["models"]}
    assert {r.deployment_id: (r.model_id, r.node_id, r.seq) for r in edge.deployments(df, early).collect()} == deps
