"""Dense ticks: batch against a plain loop, stream against batch, late readings set aside."""

import datetime as dt
import math
import os
import random

from pyspark.sql import functions as F

from roverlake.operators import sensors as sens
from roverlake.sources import streams as srcs
from roverlake.streaming import dense

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "robot_id string, time timestamp_ntz, arrival_seq long, channel string, reading double"
CHANNELS = {"battery": 100.0, "laser": None}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def readings(seed, robots=4, n=300, span=600):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(robots)}", at(rng.choice([rng.randrange(span), rng.uniform(0, span)])), i, rng.choice(["battery", "laser", "other"]), rng.choice([rng.random(), math.nan])) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def brute(rows, low, high, step=2):
    out = []
    for robot in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == robot and r[1] is not None), key=lambda r: (r[1], r[2]))
        for s in range(-(-low // step) * step, high + 1, step):
            values = dict(CHANNELS)
            for r in own:
                if r[1] <= at(s) and r[3] in values and not math.isnan(r[4]):
                    values[r[3]] = r[4]
            out.append((robot, at(s), *values.values()))
    return sorted(out, key=str)


def batch(spark, rows, low, high, **more):
    wide = sens.by_channel(spark.createDataFrame(rows, SCHEMA), CHANNELS)
    return sens.dense_snapshots(wide, {c: F.lit(v).cast("double") for c, v in CHANNELS.items()}, F.lit(at(low)), F.lit(at(high)), **more)


def collected(df):
    return sorted((tuple(r) for r in df.withColumn("tick", F.col("tick").cast("timestamp_ntz")).select("robot_id", "tick", *CHANNELS).collect()), key=str)


def test_every_tick_equals_a_plain_loop(spark):
    rows = [*readings(1), (None, at(5), 9_000, "battery", 1.0), ("r9", None, 9_001, "battery", 1.0), ("late", at(599), 9_002, "laser", 5.0)]
    timed = [r for r in rows if r[1] is not None]
    for low, high, chunk in ((0, 600, "1 minute"), (101, 333, "10 seconds"), (-20, 20, "1 hour"), (700, 720, "1 minute")):
        assert collected(batch(spark, rows, low, high, chunk=chunk)) == brute(timed, low, high)
    assert batch(spark, rows, 3, 3).count() == 0 and batch(spark, [], 0, 100).count() == 0


def test_ticks_of_named_robots(spark):
    robots = spark.createDataFrame([("r0",), ("never heard of",), (None,)], "robot_id string")
    got = collected(batch(spark, readings(2), 0, 60, chunk="1 minute", robots=robots))
    assert {r[0] for r in got} == {"r0", "never heard of"} and all(r[2:] == (100.0, None) for r in got if r[0] != "r0") and len(got) == 62


def test_channels_of_any_type(spark):
    rows = spark.createDataFrame([("r", at(1), 0, (1.0, "a"), None), ("r", at(4), 1, None, [1, 2]), ("r", at(5), 2, (2.0, None), None)],
                                 "robot_id string, time timestamp_ntz, arrival_seq long, pose struct<x: double, n: string>, beams array<int>")
    channels = {"pose": F.lit(None).cast("struct<x: double, n: string>"), "beams": F.array().cast("array<int>")}
    got = [(r.pose and tuple(r.pose), r.beams) for r in sens.dense_snapshots(rows, channels, F.lit(at(0)), F.lit(at(6)), chunk="2 seconds").orderBy("tick").collect()]
    assert got == [(None, []), ((1.0, "a"), []), ((1.0, "a"), [1, 2]), ((2.0, None), [1, 2])]


def write(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    newest = max((os.path.join(f"{folder}/in", f) for f in os.listdir(f"{folder}/in") if f.startswith("part")), key=os.path.getmtime)
    os.utime(newest, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, low, high, watermark="0 seconds"):
    source = srcs.parquet_replay(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 1)
    rows = dense.dense_stream(source, CHANNELS, at(low), at(high), watermark)
    rows.writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/o")


def test_stream_equals_batch_over_a_restart(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(dense, "PIECE", 7)
    rows = readings(3)
    steps = [rows[i::1][:60] for i in range(0, 300, 60)]
    for n, part in enumerate(steps[:3]):
        write(spark, tmpdir_path, part, n)
    run(spark, tmpdir_path, 11, 560)
    for n, part in enumerate([*steps[3:], [("end", at(700), 10_000, "battery", 1.0)]]):
        write(spark, tmpdir_path, part, 10 + n)
    sent = run(spark, tmpdir_path, 11, 560)
    assert collected(dense.ticks(sent)) == collected(batch(spark, [*rows, ("end", at(700), 10_000, "battery", 1.0)], 11, 560, chunk="1 minute"))
    assert dense.late_readings(sent).count() == 0


def test_late_readings_go_to_a_side_table(spark, tmpdir_path):
    parts = [[("a", at(10), 0, "battery", 1.0)], [("a", at(30), 1, "battery", 2.0), ("a", at(12), 2, "laser", 3.0)], [("a", at(20), 3, "battery", 9.0)], [("b", at(100), 4, "battery", 4.0)]]
    for n, part in enumerate(parts):
        write(spark, tmpdir_path, part, n)
    sent = run(spark, tmpdir_path, 0, 50, "10 minutes")
    assert [tuple(r) for r in dense.late_readings(sent).withColumn("time", F.col("time").cast("timestamp_ntz")).collect()] == [("a", at(20), 3, "battery", 9.0)]
    kept = [r for part in parts for r in part if r[2] != 3]
    # the watermark has passed no tick yet: robot a is sent up to its newest reading, robot b from the start of the range
    want = [r for r in brute(kept, 0, 50) if r[0] == "b" or r[1] < at(30)]
    assert collected(dense.ticks(sent)) == want


def test_a_silent_robot_goes_on_reporting(spark, tmpdir_path):
    parts = [[("quiet", at(1), 0, "battery", 7.0)]] + [[("busy", at(s), s, "laser", 1.0)] for s in (20, 40, 60)]
    for n, part in enumerate(parts):
        write(spark, tmpdir_path, part, n)
    got = collected(dense.ticks(run(spark, tmpdir_path, 0, 50)))
    assert [r for r in got if r[0] == "quiet"] == sorted((("quiet", at(s), 100.0 if s == 0 else 7.0, None) for s in range(0, 51, 2)), key=str)


def test_ticks_are_made_after_the_last_shuffle_and_sort(spark):
    plan = batch(spark, readings(5), 0, 600, chunk="1 minute")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    ticks = next(n for n, line in enumerate(plan) if "explode(sequence(tick" in line)
    assert all(ticks < n for n, line in enumerate(plan) if any(word in line for word in ("Window", "Join", "Repartition", "Union", "Sort")))


def test_whole_values_are_aggregated_only_at_their_newest_times(spark):
    rows = [("r", at(s), s, "battery", float(s)) for s in range(50)] + [("r", at(49), 90, "battery", 7.0), ("r", at(20), 91, "laser", 3.0), ("q", at(5), 92, "other", 1.0)]
    wide = sens.by_channel(spark.createDataFrame(rows, SCHEMA), CHANNELS).withColumn("us", F.unix_micros(F.col("time").cast("timestamp")))
    newest = sens._newest(wide.select("robot_id", "us", "arrival_seq", *CHANNELS), list(CHANNELS))
    assert [tuple(r) for r in newest.collect()] == [("r", 7.0, 3.0)]
    plan = newest._jdf.queryExecution().sparkPlan().toString().splitlines()
    met = next(n for n, line in enumerate(plan) if "Join" in line)
    assert all(n < met for n, line in enumerate(plan) if "SortAggregate" in line) and any("HashAggregate" in line for line in plan[met:])
