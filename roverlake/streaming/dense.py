"""Every 2-second tick of every robot on a stream (R2, dense form of J4).

Keyed state per robot: the newest value of each channel and the next tick to
send. A tick is sent when a later reading of its robot arrives, or when the
watermark passes it: the timer is set to the next tick, fires, sends what is
due and sets itself again, so a silent robot goes on reporting. A robot's
series starts at the first tick of the range, before its first reading, as
soon as it is heard of.

The ticks equal ``operators.sensors.dense_snapshots`` for input that is in
order per robot. A reading older than the newest one applied to its robot may
belong to ticks already sent: it changes nothing and comes out as a late row
instead (``late_readings``), for a side table. Rows older than the watermark
are dropped by Spark before that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ticks in one piece of output: a long silence is sent in several
PIECE = 50_000
LATE = ("late_time", "late_seq", "late_channel", "late_reading")


def micros(t: dt.datetime) -> int:
    return int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def _make(channels: dict[str, float | None], low: int, high: int, step: int):
    names = list(channels)
    k = len(names)

    def sent(robot: str, ticks: np.ndarray, values: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(ticks), PIECE):
            part = slice(at, at + PIECE)
            out = {"robot_id": robot, "tick": pd.to_datetime(ticks[part], unit="us")}
            for c, v in zip(names, values, strict=True):
                v = np.asarray(v[part], "float64")
                out[c] = v if channels[c] is None else np.where(np.isnan(v), channels[c], v)
            n = len(ticks[part])
            out |= {"late_time": pd.Series([pd.NaT] * n, dtype="datetime64[ns]"), "late_seq": pd.Series([None] * n, dtype="Int64"), "late_channel": pd.Series([None] * n, dtype="object"), "late_reading": np.full(n, np.nan)}
            yield pd.DataFrame(out)

    def late(robot: str, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        out = {"robot_id": [robot] * n, "tick": pd.Series([pd.NaT] * n, dtype="datetime64[ns]"), **{c: np.full(n, np.nan) for c in names}}
        out |= {"late_time": rows["time"].to_numpy(), "late_seq": rows["arrival_seq"].to_numpy(), "late_channel": rows["channel"].to_numpy(), "late_reading": rows["reading"].to_numpy()}
        return pd.DataFrame(out)

    def arm(state: GroupState, due: int) -> None:
        if due <= high:
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))

    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        robot = key[0]
        due, newest, *held = state.get if state.exists else (low, None, *[None] * k)
        seed = [np.nan if v is None else float(v) for v in held]
        if state.hasTimedOut:
            passed = min(high, state.getCurrentWatermarkMs() * 1000 - 1)
            ticks = np.arange(due, passed + 1, step, dtype="int64")
            due += len(ticks) * step
            state.update((due, newest, *held))
            arm(state, due)
            yield from sent(robot, ticks, [np.full(len(ticks), v) for v in seed])
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows["us"] = rows["time"].astype("datetime64[us]").astype("int64")
        rows = rows.sort_values(["us", "arrival_seq"], kind="stable")
        if newest is not None and (old := rows["us"] < newest).any():
            yield late(robot, rows[old])
            rows = rows[~old]
        us, channel, reading = rows["us"].to_numpy(), rows["channel"].to_numpy(), rows["reading"].to_numpy(dtype="float64")
        if len(us):
            # newest value of each channel after each reading; place 0 is before the first
            after = []
            for c, v in zip(names, seed, strict=True):
                mine = np.where((channel == c) & ~np.isnan(reading), np.arange(1, len(us) + 1), 0)
                after.append(np.concatenate([[v], reading])[np.maximum.accumulate(np.concatenate([[0], mine]))])
            newest = int(us[-1])
            ticks = np.arange(due, min(high, newest - 1) + 1, step, dtype="int64")
            place = np.searchsorted(us, ticks, side="right")
            due += len(ticks) * step
            state.update((due, newest, *(None if np.isnan(v[-1]) else float(v[-1]) for v in after)))
            arm(state, due)
            yield from sent(robot, ticks, [v[place] for v in after])
        else:
            state.update((due, newest, *held))
            arm(state, due)  # the call has cleared the timer

    return fn


def dense_stream(readings: DataFrame, channels: dict[str, float | None], start: dt.datetime, end: dt.datetime, watermark: str, tick_seconds: int = 2) -> DataFrame:
    """Ticks of the closed range and late rows, from channel readings
    (``robot_id, time, arrival_seq, channel, reading``)."""
    step = tick_seconds * 1_000_000
    low, high = -(-micros(start) // step) * step, micros(end)
    values = ", ".join(f"{c} double" for c in channels)
    out = f"robot_id string, tick timestamp, {values}, late_time timestamp, late_seq long, late_channel string, late_reading double"
    src = readings.where("robot_id is not null and time is not null").select(
        "robot_id", F.col("time").cast("timestamp").alias("time"), "arrival_seq", "channel", F.col("reading").cast("double").alias("reading"))
    return (
        src.withWatermark("time", watermark)
        .groupBy("robot_id")
        .applyInPandasWithState(_make(channels, low, high, step), out, f"due long, newest long, {values}", "append", GroupStateTimeout.EventTimeTimeout)
    )


def ticks(sent: DataFrame) -> DataFrame:
    """The ticks among the rows that the stream has written."""
    return sent.where("tick is not null").drop(*LATE)


def late_readings(sent: DataFrame) -> DataFrame:
    """The side table: readings that came too late, as they came."""
    renamed = dict(zip(LATE, ("time", "arrival_seq", "channel", "reading"), strict=True))
    return sent.where("late_time is not null").select("robot_id", *[F.col(c).alias(n) for c, n in renamed.items()])
