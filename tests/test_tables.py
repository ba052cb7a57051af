"""Compaction under readers, retention, the file index and alert windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roverlake.operators import alerts
from roverlake.operators import telemetry as tel
from roverlake.sources import file_index, files, sinks
from roverlake.sources.append_table import AppendTable
from roverlake.streaming import ingest as ing

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "time timestamp_ntz, robot_id string, sensor_id string, data_type string, value string, metadata string, arrival_seq long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(spark, seed, n=40, days=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(at(rng.randrange(days * 86400)), f"r{rng.randrange(30)}", "s", "imu", "{}", "{}", seed * 1000 + i) for i in range(n)], SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.select("time", "robot_id", "arrival_seq").collect())


def test_readers_see_the_same_rows_while_files_are_merged(spark, tmpdir_path):
    table = AppendTable(f"{tmpdir_path}/ts", ("event_date",), ("robot_id", "time"), max_segments=2)
    assert table.compact(spark, idle=True) is None and table.vacuum(spark) == 0
    with pytest.raises(ValueError):
        table.read(spark)
    want = []
    for batch in range(7):
        sinks.write_timeseries(rows(spark, batch), table.path, batch)
        want = sorted(want + content(rows(spark, batch)))
        if batch in (1, 2, 4, 6):
            before = table.read(spark)  # planned before, read after
            old = table.version(spark)
            table.compact(spark, idle=True)
            assert content(before) == want == content(table.read(spark)) and content(table.read(spark, old)) == want
    assert table.live(spark).upto == 6 and len(table.live(spark).segments) == 2
    held = table.read(spark)
    assert table.vacuum(spark, keep=1) > 0 and content(held) == want == content(table.read(spark))
    assert not any(files.versions(spark, f"{table.path}/{d}", "batch") for d in files.names(spark, table.path) if d.startswith("event_date="))
    sinks.write_timeseries(rows(spark, 7), table.path, 7)
    assert content(table.read(spark)) == sorted(want + content(rows(spark, 7))) and table.compact(spark, idle=True) == table.compact(spark, idle=True)


def test_the_newest_batch_is_left_while_the_job_runs(spark, tmpdir_path):
    table = AppendTable(f"{tmpdir_path}/counts", order=("data_type",))
    one = spark.createDataFrame([("imu", 1)], "data_type string, processed long")
    one.write.parquet(f"{table.path}/batch=0")
    assert table.compact(spark) is None
    one.write.parquet(f"{table.path}/batch=1")
    assert table.compact(spark) == 1 and table.live(spark).upto == 0
    one.unionByName(one).write.mode("overwrite").parquet(f"{table.path}/batch=1")  # it was not finished
    assert table.read(spark).count() == 3


def test_a_repeated_batch_after_a_crash_of_the_compaction(spark, tmpdir_path, monkeypatch):
    table = AppendTable(f"{tmpdir_path}/ts", ("event_date",), ("robot_id", "time"))
    for batch in range(2):
        sinks.write_timeseries(rows(spark, batch), table.path, batch)
    want = content(table.read(spark))
    with monkeypatch.context() as m:
        m.setattr(AppendTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.compact(spark, idle=True)
    assert content(table.read(spark)) == want  # the segment has no manifest
    table.compact(spark, idle=True)
    sinks.write_timeseries(rows(spark, 1), table.path, 1)  # Spark repeats the last batch
    assert content(table.read(spark)) == want


def test_old_dates_go(spark, tmpdir_path):
    table = AppendTable(f"{tmpdir_path}/ts", ("event_date",), ("robot_id", "time"))
    sinks.write_timeseries(rows(spark, 0), table.path, 0)
    table.compact(spark, idle=True)
    sinks.write_timeseries(rows(spark, 1), table.path, 1)
    want = [r for r in content(table.read(spark)) if r[0] >= at(86400)]
    table.retain(spark, dt.date(2025, 1, 2))
    table.retain(spark, dt.date(2024, 1, 1))  # never back
    assert content(table.read(spark)) == want
    table.vacuum(spark, keep=1)
    assert content(table.read(spark)) == want and "event_date=2025-01-01" not in files.names(spark, table.path)
    with pytest.raises(ValueError):
        AppendTable(f"{tmpdir_path}/other").retain(spark, dt.date(2025, 1, 2))


def test_ingest_tables_are_compacted(spark, tmpdir_path):
    line = '{"robot_id":"r%d","data_type":"%s","timestamp":"2025-01-0%dT00:00:00","data":{}}'
    for batch in range(3):
        raw = [(line % (i, ("imu", "command")[i % 2], batch + 1), i) for i in range(6)] + [("{bad", 9)]
        ing.ingest_batch(spark.createDataFrame(raw, "raw string, arrival_seq long").withColumn("received_at", F.lit(at(0))), batch, tmpdir_path, file_summary=True)
    count = lambda: {n: t.read(spark).count() for n, t in ing.tables(tmpdir_path).items()} | {"sum": ing.read_counts(spark, tmpdir_path).agg(F.sum("processed")).first()[0]}
    before = count()
    assert before == {"timeseries": 9, "topics": 18, "rejects": 3, "counts": 6, "sum": 18}
    for table in ing.tables(tmpdir_path).values():
        table.compact(spark, idle=True)
        table.vacuum(spark, keep=1)
    assert count() == before and spark.read.parquet(f"{tmpdir_path}/timeseries_index").agg(F.sum("rows")).first()[0] == 9


def test_a_lookup_opens_only_files_that_can_match(spark, tmpdir_path):
    data = spark.range(0, 20_000).select(
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 20)).alias("time"), F.concat(F.lit("r"), F.col("id") % 97).alias("robot_id"),
        F.lit("s").alias("sensor_id"), F.lit("imu").alias("data_type"), F.lit("{}").alias("value"), F.lit("{}").alias("metadata"), F.col("id").alias("arrival_seq"))
    table, index = f"{tmpdir_path}/ts", f"{tmpdir_path}/index"
    sinks.write_timeseries(data, table)
    assert len(file_index.read_for(spark, table, index, "r5", F.lit(at(0)), F.lit(at(10))).inputFiles()) == len(spark.read.parquet(table).inputFiles())  # no index yet
    file_index.index_table(spark, table, index)
    low, high = F.lit(at(86400)).cast("timestamp_ntz"), F.lit(at(2 * 86400 - 1)).cast("timestamp_ntz")
    found = file_index.read_for(spark, table, index, "r5", low, high)
    want = tel.query_telemetry(spark.read.parquet(table), low, high, robot_id="r5")
    assert sorted(map(tuple, tel.query_telemetry(found, low, high, robot_id="r5").collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    holds = {r.f for r in spark.read.parquet(table).where((F.col("robot_id") == "r5") & F.col("time").between(low, high)).select(F.input_file_name().alias("f")).distinct().collect()}
    assert holds <= set(file_index.files_for(spark, index, "r5", low, high)) and len(found.inputFiles()) <= 2
    assert file_index.read_for(spark, table, index, "nobody", low, high).count() == 0


def test_alert_windows(spark):
    r = lambda robot, s, latency, bad: (robot, None if s is None else at(s), latency, bad)
    data = [r("a", 60 * k, 100.0, False) for k in range(5)] + [r("a", 300, 900.0, True), r("a", 660, 501.0, False), r("a", 1300, 500.0, None), r("b", 0, None, True), r("b", 900, None, True), r("c", None, 9e9, True)]
    data += [r("d", k, 1000.0 if k >= 95 else 1.0, k < 5) for k in range(100)]
    got = alerts.alert_windows(spark.createDataFrame(data, "robot_id string, time timestamp_ntz, latency_ms double, is_error boolean"))
    assert sorted((x.robot_id, x.rule, x.alert_from, x.alert_until, x.buckets, x.worst) for x in got.collect()) == [
        ("a", "error_rate", at(300), at(600), 1, 1.0), ("a", "p95_latency", at(300), at(900), 2, 900.0),
        ("b", "error_rate", at(0), at(300), 1, 1.0), ("b", "error_rate", at(900), at(1200), 1, 1.0)]  # d: 5 errors and 5 slow ones in 100 break nothing
    with pytest.raises(ValueError):
        alerts.alert_windows(got, "1 month")


def test_sketches_of_large_buckets_stay_near(spark):
    rng = random.Random(1)
    values = [rng.expovariate(1 / 300) for _ in range(30_000)]
    data = spark.createDataFrame([("a", T0, v, False) for v in values], "robot_id string, time timestamp_ntz, latency_ms double, is_error boolean").repartition(7)
    p95 = alerts.bucket_health(data, accuracy=500).first().p95_latency
    rank = sum(v <= p95 for v in values)
    assert abs(rank - 0.95 * len(values)) <= len(values) / 500 + 1
