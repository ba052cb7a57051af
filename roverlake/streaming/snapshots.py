"""2-second robot snapshots on a stream (R2).

Keyed state per robot: the newest value of every channel, plus the tick
still open (its values and reading count). Rows of a micro-batch are sorted
per robot, channel values are carried forward, and every tick older than
the newest one is emitted; the newest tick stays open until a later reading
or the watermark passing it (event-time timeout) closes it. The emitted rows
equal the batch operator ``operators.sensors.snapshots`` for input that is in
order per robot; the watermark says how far the robots' clocks may differ
(rows older than it are dropped by Spark, so it has no default). Readings older
than the newest one applied to their own robot come too late for their tick,
which may be out already: they are counted in ``late`` of the robot's next row.
A NaN is no reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _schemas(channels: dict) -> tuple[str, str]:
    vals = ", ".join(f"{c} double" for c in channels)
    out = f"robot_id string, tick timestamp, {vals}, readings long, late long"
    state = f"tick_us long, readings long, {', '.join(f'{c} double' for c in channels)}, last_us long, late long"
    return out, state


def _make(channels: dict, tick_seconds: int):
    names = list(channels)
    step = tick_seconds * 1_000_000

    def emit(robot, ticks_us, counts, values: dict, late: int) -> pd.DataFrame:
        out = {"robot_id": robot, "tick": pd.to_datetime(np.asarray(ticks_us, dtype="int64"), unit="us")}
        for c in names:
            v = np.asarray(values[c], dtype="float64")
            if channels[c] is not None:
                v = np.where(np.isnan(v), channels[c], v)
            out[c] = v
        out["readings"] = np.asarray(counts, dtype="int64")
        out["late"] = np.where(np.arange(len(ticks_us)) == 0, late, 0).astype("int64")
        return pd.DataFrame(out)

    def fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        robot = key[0]
        k = len(names)
        if state.hasTimedOut:
            st = state.get
            # close the open tick but keep the channel values for later readings
            state.update(tuple([None, 0] + list(st[2:2 + k]) + [st[2 + k], 0]))
            yield emit(robot, [st[0]], [st[1]], {c: [np.nan if v is None else v] for c, v in zip(names, st[2:2 + k])}, st[3 + k])
            return
        rows = pd.concat(list(batches), ignore_index=True)
        us = rows["time"].astype("datetime64[us]").astype("int64").to_numpy()
        order = np.lexsort((rows["arrival_seq"].to_numpy(), us))
        us = us[order]
        channel = rows["channel"].to_numpy()[order]
        reading = rows["reading"].to_numpy(dtype="float64")[order]
        if state.exists:
            st = state.get
            open_tick, open_count = st[0], st[1]
            seed = [np.nan if v is None else float(v) for v in st[2:2 + k]]
            keep = us >= st[2 + k]
            late = int(st[3 + k]) + int((~keep).sum())
            us, channel, reading = us[keep], channel[keep], reading[keep]
            if len(us) == 0:
                state.update(tuple([*st[:3 + k], late]))
                if open_tick is not None:  # the call has cleared the timer
                    state.setTimeoutTimestamp(max(open_tick // 1000, state.getCurrentWatermarkMs() + 1))
                return
        else:
            open_tick, open_count, seed, late = None, 0, [np.nan] * len(names), 0

        # carry each channel's newest value forward (seeded from the state)
        idx = np.arange(len(us))
        filled = {}
        for c, start in zip(names, seed):
            pos = np.where((channel == c) & ~np.isnan(reading), idx, -1)
            np.maximum.accumulate(pos, out=pos)
            filled[c] = np.where(pos >= 0, reading[np.maximum(pos, 0)], start)

        # one row per tick: the last reading of each run of equal ticks
        ticks = -((-us) // step) * step
        ends = np.flatnonzero(np.r_[ticks[1:] != ticks[:-1], True])
        counts = np.diff(np.r_[-1, ends])
        tick_list = ticks[ends]
        last = {c: filled[c][ends] for c in names}
        if open_tick is not None:
            if tick_list[0] == open_tick:
                counts[0] += int(open_count)
            else:
                # the open tick got no more readings: it is complete
                yield emit(robot, [open_tick], [open_count], {c: [v] for c, v in zip(names, seed)}, late)
                late = 0
        done = len(tick_list) - 1
        if done:
            yield emit(robot, tick_list[:done], counts[:done], {c: last[c][:done] for c in names}, late)
            late = 0
        newest = int(tick_list[-1])
        state.update(tuple([newest, int(counts[-1])] + [
            None if np.isnan(last[c][-1]) else float(last[c][-1]) for c in names
        ] + [int(us[-1]), late]))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs() + 1))

    return fn


def snapshot_stream(readings: DataFrame, channels: dict, watermark: str, tick_seconds: int = 2) -> DataFrame:
    """Streaming snapshots from channel readings
    (``robot_id, time, arrival_seq, channel, reading``)."""
    out_schema, state_schema = _schemas(channels)
    src = readings.select(
        "robot_id", F.col("time").cast("timestamp").alias("time"), "arrival_seq", "channel",
        F.col("reading").cast("double").alias("reading"),
    )
    return (
        src.withWatermark("time", watermark)
        .groupBy("robot_id")
        .applyInPandasWithState(_make(channels, tick_seconds), out_schema, state_schema, "append",
                                GroupStateTimeout.EventTimeTimeout)
    )
