"""Rows without a time, and clocks that step back, change no answer."""

import datetime as dt

from pyspark.sql import functions as F

from roverlake.operators import edge, scan, sensors

T0 = dt.datetime(2025, 1, 1, 2)


def _log(spark, rows):
    return spark.createDataFrame(rows, "kind string, node_id string, seq long, ts timestamp_ntz, model_id string, version string")


def test_requests_without_a_time_are_decided(spark):
    rows = [("heartbeat", "n", 1, None, None, None), ("register", "n", 2, None, None, None), ("heartbeat", "n", 3, T0, None, None)]
    got = {r.seq: r.accepted for r in edge.requests_decided(_log(spark, rows)).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_both_acceptance_forms_agree_when_the_clock_steps_back(spark):
    rows = [("register", "n", 5, T0, None, None), ("deploy", "n", 6, T0 - dt.timedelta(hours=2), "m", "1"),
            ("register", "n", 300_007, T0 - dt.timedelta(hours=5), None, None), ("deploy", "n", 300_008, None, "m", "1")]
    log = _log(spark, rows)
    got = {r.seq: r.accepted for r in edge.requests_decided(log).collect()}
    assert got == {r.seq: r.accepted for r in edge.accepted_requests(log).collect()} == {5: True, 6: True, 300_007: True, 300_008: True}
    models = edge.deployed_models(edge.requests_decided(log)).collect()
    assert [(r.position, r.seq) for r in models] == [(1, 300_008)]


def test_battery_readings_without_a_time_are_kept(spark):
    rows = [("r", None, 1, 0.5), ("r", T0, 2, 0.0), ("r", T0 + dt.timedelta(hours=3), 3, -1.0), ("r", None, 4, 0.0)]
    df = spark.createDataFrame(rows, "robot_id string, time timestamp_ntz, arrival_seq long, percentage double")
    got = {r.arrival_seq: round(r.battery, 6) for r in sensors.battery_series(df).collect()}
    assert got == {1: 50.0, 4: 49.99, 2: 49.98, 3: 49.97}


def test_scans_keep_rows_without_a_time(spark):
    rows = [("k", None, 1), ("k", T0, 2), ("k", None, 3), ("k", T0 + dt.timedelta(days=2), 4)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, s long")
    out = scan.running(df, "k", ("t", "s"), scan.chunk_of("t"), sums={"n": F.lit(1)})
    out = scan.next_value(out, "k", ("t", "s"), scan.chunk_of("t"), "s", "nx")
    assert {r.s: (r.n, r.nx) for r in out.collect()} == {1: (1, 3), 3: (2, 2), 2: (3, 4), 4: (4, None)}


def test_offline_intervals_keep_nodes_with_a_missing_time(spark):
    rows = [("register", "n", 1, T0, None, None), ("heartbeat", "n", 2, None, None, None), ("heartbeat", "n", 3, T0 + dt.timedelta(minutes=20), None, None)]
    got = edge.offline_intervals(_log(spark, rows)).collect()
    assert [(r.last_seen, r.offline_until) for r in got] == [(T0, T0 + dt.timedelta(minutes=20))]
