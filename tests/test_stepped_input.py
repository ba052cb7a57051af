"""The events table as a stream: a step is one micro-batch, whatever the files of the table."""

import datetime as dt

import pytest

from roverlake.plans import queries as Q

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def batches(spark, folder, ids):
    rows = [(i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i), i % 3, "view", 1.0, '{"k": 1}') for i in ids]
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(f"{folder}/events.parquet")
    seen = []

    def look(df, _):
        seen.append((sorted(r.event_id for r in df.select("event_id").collect()), df.rdd.getNumPartitions()))

    Q._run_to_end(Q._stream_events(spark, folder).writeStream.foreachBatch(look).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
    return seen


def test_a_step_is_one_micro_batch_on_all_slots(spark, tmpdir_path):
    seen = batches(spark, tmpdir_path, range(1000))
    assert [ids for ids, _ in seen] == [list(range(k, k + 200)) for k in range(0, 1000, 200)]
    assert all(tasks >= spark.sparkContext.defaultParallelism for _, tasks in seen)


@pytest.mark.parametrize("ids, steps", [([0, 1, 2, 50, 51, 99, 100], [[0, 1, 2], [], [50, 51], [], [99, 100]]), ([7, 7], [[7, 7], [], [], [], []]), ([], [[]])])
def test_steps_of_few_rows(spark, tmpdir_path, ids, steps):
    assert [found for found, _ in batches(spark, tmpdir_path, ids)] == steps
