"""The status table: a batch writes what it touches, repeats and crashes change nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roverlake.operators import status as st
from roverlake.sources import files

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "robot_id string, last_seen timestamp_ntz, status string, battery_level double, location string, active_mission string, arrival_seq long"


def rows(spark, pairs):
    return spark.createDataFrame([(r, T0 + dt.timedelta(seconds=seen), f"s{seq}", None if seq % 3 == 0 else float(seq), "{}", None, seq) for r, seen, seq in pairs], SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def random_batches(seed, n=9):
    rng, seq, out = random.Random(seed), 0, []
    for _ in range(n):
        out.append([])
        for _ in range(rng.choice([1, 5, 40])):
            out[-1].append((f"r{rng.randrange(25)}", rng.randrange(1000), seq))
            seq += 1
    return out


@pytest.mark.parametrize("order", ["arrival", "event_time"])
def test_batches_equal_one_fold(spark, tmpdir_path, order):
    table = st.status_table(f"{tmpdir_path}/t", order, buckets=4, compact_after=2)
    assert table.read(spark) is None and table.vacuum(spark) == 0
    batches, seen = random_batches(1), []
    for v, batch in enumerate(batches):
        table.merge(rows(spark, batch), v)
        seen += batch
        if v in (0, 4, 8):
            assert content(table.read(spark)) == content(st.upsert_status(rows(spark, seen), order=order))
    assert all(len(parts) <= 2 for parts in table.live(spark).values())  # compacted
    want = content(table.read(spark))
    assert table.vacuum(spark, keep=1) > 0 and content(table.read(spark)) == want
    assert content(table.read(spark, "r3")) == [r for r in want if r[0] == "r3"] and table.read(spark, "nobody").count() == 0
    assert files.versions(spark, f"{tmpdir_path}/t/manifest") == [8]


def test_a_batch_writes_only_what_it_touches(spark, tmpdir_path):
    table = st.status_table(f"{tmpdir_path}/t", buckets=16)
    table.merge(rows(spark, [(f"robot-{i}", i % 500, i) for i in range(20_000)]), 0)
    table.merge(rows(spark, [("robot-1", 1, 30_000), ("robot-1", 2, 30_001)]), 1)
    assert len(files.versions(spark, f"{tmpdir_path}/t/data/v=1/kind=delta", "bucket")) == 1
    assert files.size(spark, f"{tmpdir_path}/t/data/v=1") < 0.05 * files.size(spark, f"{tmpdir_path}/t/data/v=0")
    assert table.read(spark, "robot-1").first().arrival_seq == 30_001 and table.read(spark).count() == 20_000
    read = table.read(spark, "robot-1").inputFiles()
    assert len(read) == 2  # the bucket's base and its delta


def test_repeated_batches_change_nothing(spark, tmpdir_path):
    table = st.status_table(f"{tmpdir_path}/t", buckets=4)
    for v, batch in enumerate(random_batches(2, 3)):
        table.merge(rows(spark, batch), v)
    before, listed = content(table.read(spark)), files.versions(spark, f"{tmpdir_path}/t/manifest")
    table.merge(rows(spark, [("r1", 5, 10 ** 6)]), 2)
    assert content(table.read(spark)) == before and files.versions(spark, f"{tmpdir_path}/t/manifest") == listed


def test_a_crash_before_the_manifest_leaves_the_table(spark, tmpdir_path, monkeypatch):
    table = st.status_table(f"{tmpdir_path}/t", buckets=4, compact_after=1)
    table.merge(rows(spark, [("a", 1, 1), ("b", 1, 2)]), 0)
    before = content(table.read(spark))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(table), "_commit", crash)
        with pytest.raises(RuntimeError):
            table.merge(rows(spark, [("a", 2, 3), ("c", 1, 4)]), 1)
    assert files.versions(spark, f"{tmpdir_path}/t/data") == [0, 1] and content(table.read(spark)) == before
    assert table.vacuum(spark) == 0  # what a batch under way has written stays
    table.merge(rows(spark, [("a", 2, 3), ("c", 1, 4)]), 1)
    assert [(r[0], r[-1]) for r in content(table.read(spark))] == [("a", 3), ("b", 2), ("c", 4)]


def test_an_empty_batch(spark, tmpdir_path):
    table = st.status_table(f"{tmpdir_path}/t", buckets=4)
    table.merge(rows(spark, [("a", 1, 1)]), 0)
    table.merge(rows(spark, []), 1)
    assert [(r.robot_id, r.arrival_seq) for r in table.read(spark).select("robot_id", F.col("arrival_seq")).collect()] == [("a", 1)]
    assert table.version(spark) == 1
    bare = st.status_table(f"{tmpdir_path}/bare")
    bare.merge(rows(spark, []), 0)
    assert bare.read(spark).count() == 0 and bare.read(spark, "a").count() == 0
