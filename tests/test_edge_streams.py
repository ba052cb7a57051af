"""Roll-up, acceptance, deployments and registration cache on streams: batch results over a restart."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from roverlake.operators import edge as batch
from roverlake.operators import telemetry as tel
from roverlake.sources import streams as srcs
from roverlake.streaming import edge, rollup

T0 = dt.datetime(2025, 1, 1)
LOG = "kind string, node_id string, seq long, ts timestamp_ntz, status string, cpu double, mem double, model_id string, version string"
TELEMETRY = "robot_id string, time timestamp_ntz, value string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, folder, make, parts, schema, restart_after=None):
    """The stream over one file and micro-batch for each part, stopped and started again."""
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        newest = max((f"{folder}/in/{f}" for f in os.listdir(f"{folder}/in") if f.startswith("part")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
        if n == restart_after or n == len(parts) - 1:
            rows = make(srcs.parquet_replay(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 1))
            rows.writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/o")


def log(seed, n=240):
    rng, out, now = random.Random(seed), [], 0
    for i in range(n):
        now += rng.choice([0, 0, 1, 3, 40, 400])
        out.append((rng.choice(["register", "heartbeat", "deploy", "deploy"]), f"n{rng.randrange(4)}", i, at(now), "active", 1.0, 1.0, f"m{rng.randrange(2)}", str(i)))
    return out


def quarters(rows, k=4):
    return [rows[i * len(rows) // k:(i + 1) * len(rows) // k] for i in range(k)]


def plain(df, *columns):
    stamps = [c for c, t in df.dtypes if t == "timestamp"]
    return sorted(tuple(map(str, r)) for r in df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}).select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_acceptance_in_arrival_order(spark, tmpdir_path, seed):
    rows = log(seed)
    random.Random(seed).shuffle(rows)  # event times go back and forth: arrival counts
    rows = [(r[0], r[1], i, *r[3:]) for i, r in enumerate(rows)]
    got = run(spark, tmpdir_path, edge.decided_stream, quarters(rows), LOG, restart_after=1)
    want = batch.requests_decided(spark.createDataFrame(rows, LOG))
    columns = ("kind", "node_id", "seq", "ts", "model_id", "epoch", "accepted")
    assert plain(got, *columns) == plain(want, *columns) and got.where("not accepted").count() > 0


@pytest.mark.parametrize("seed", [3, 4])
def test_deployments_go_from_deploying_to_deployed(spark, tmpdir_path, seed):
    rows = log(seed)
    changes = run(spark, tmpdir_path, lambda s: edge.deployment_stream(s, "0 seconds"), quarters(rows, 5), LOG, restart_after=2)
    columns = ("deployment_id", "model_id", "version", "node_id", "deployed_at", "seq", "status")
    want = batch.deployments(spark.createDataFrame(rows, LOG), max(r[3] for r in rows))
    assert plain(edge.deployments_now(changes), *columns) == plain(want, *columns)
    assert changes.where("status = 'deploying'").count() >= want.count()
    assert changes.groupBy("deployment_id").agg(F.count_if(F.col("status") == "deployed").alias("n")).where("n > 1").count() == 0


def test_a_later_request_of_the_same_second_replaces_a_deployment(spark, tmpdir_path):
    one = lambda kind, seq, s, version: (kind, "n", seq, at(s), "active", 1.0, 1.0, "m", version)
    parts = [[one("deploy", 0, 0, "refused"), one("register", 1, 0, "")], [one("deploy", 2, 1, "a")], [one("deploy", 3, 1.5, "b")], [one("register", 4, 20, "")], [one("register", 5, 30, "")]]
    changes = run(spark, tmpdir_path, lambda s: edge.deployment_stream(s, "0 seconds"), parts, LOG)
    assert sorted((r.seq, r.status, r.version) for r in changes.collect()) == [(2, "deploying", "a"), (3, "deployed", "b"), (3, "deploying", "b")]


@pytest.mark.parametrize("seed", [5, 6])
def test_registration_cache_entries(spark, tmpdir_path, seed):
    rows = log(seed)
    changes = run(spark, tmpdir_path, lambda s: edge.registration_stream(s, "0 seconds"), quarters(rows, 5), LOG, restart_after=1)
    columns = ("node_id", "seq", "registered_at", "expires_at", "live_until")
    want = batch.registration_cache(spark.createDataFrame(rows, LOG))
    assert plain(edge.cache_entries(changes), *columns) == plain(want, *columns)
    assert changes.where("live_until is null").count() == want.count()  # each entry was opened once


def test_roll_up_windows_closed_late_and_open(spark, tmpdir_path):
    parts = [[("r", at(10), '{"k":1}'), ("r", at(50), '{"k":null}'), ("q", at(20), '{"x":1}')], [("r", at(130), '{"k":3}')], [("r", at(30), '{"k":100}'), ("r", at(140), '{"k":5}')], [("r", at(200), '{"k":7}'), (None, at(200), '{"k":9}')]]
    sent = run(spark, tmpdir_path, lambda s: rollup.rollup_stream(s, "k", "1 minute", "0 seconds"), parts, TELEMETRY, restart_after=1)
    stored = spark.createDataFrame([r for p in parts for r in p], TELEMETRY)
    windows = rollup.settled(sent, stored, "k", "1 minute")
    got = sorted((r.bucket, str(r.robot_id), r.avg_value, r.data_points, r.state, r.late_rows) for r in windows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).collect())
    assert got == [(at(0), "r", 1.0, 2, "late", 1), (at(120), "r", 4.0, 2, "closed", 0), (at(180), "None", 9.0, 1, "open", 0), (at(180), "r", 7.0, 1, "open", 0)]
    assert [r.late_rows for r in rollup.late_counts(windows).collect()] == [1]
    with pytest.raises(ValueError):
        rollup.rollup_stream(stored, "k", "1 month", "0 seconds")


def test_roll_up_equals_batch_but_for_open_windows(spark, tmpdir_path):
    rng = random.Random(9)
    rows = sorted(((f"r{rng.randrange(3)}", at(rng.randrange(4000)), '{"k":%d}' % rng.randrange(50)) for _ in range(400)), key=lambda r: r[1])
    sent = run(spark, tmpdir_path, lambda s: rollup.rollup_stream(s, "k", "5 minutes", "0 seconds"), quarters(rows), TELEMETRY, restart_after=2)
    stored = spark.createDataFrame(rows, TELEMETRY)
    columns = ("robot_id", "bucket", "avg_value", "min_value", "max_value", "data_points")
    windows = rollup.settled(sent, stored, "k", "5 minutes")
    assert plain(windows, *columns) == plain(tel.metric_buckets(stored, "k", "5 minutes"), *columns)
    newest = rows[-1][1]
    assert {r.bucket for r in windows.where("state = 'open'").withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).collect()} == {at((newest - T0).seconds // 300 * 300)}
    assert windows.where("state = 'late'").count() == 0


def test_nodes_share_the_state_rows_of_the_registration_cache(spark, tmpdir_path):
    rng = random.Random(11)
    rows = sorted((("register", f"n{rng.randrange(150)}", i, at(rng.randrange(1500)), "active", 1.0, 1.0, "m", "1") for i in range(500)), key=lambda r: r[3])
    changes = run(spark, tmpdir_path, lambda s: edge.registration_stream(s, "0 seconds", buckets=3), quarters(rows, 5), LOG, restart_after=2)
    columns = ("node_id", "seq", "registered_at", "expires_at", "live_until")
    assert plain(edge.cache_entries(changes), *columns) == plain(batch.registration_cache(spark.createDataFrame(rows, LOG)), *columns)
    assert changes.where("live_until is not null").groupBy("node_id", "seq").count().where("count > 1").count() == 0  # each was closed once
    state = spark.read.format("statestore").load(f"{tmpdir_path}/c")
    assert 0 < state.count() <= 3
