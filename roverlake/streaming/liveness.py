"""Node liveness monitor on a stream.

Keyed state per node (``applyInPandasWithState``): whether the node has
registered, and when it was last seen. Within a micro-batch each node's rows
are sorted and every gap longer than 5 minutes between signals becomes a
closed offline interval; the tail is left to an event-time timer at
``last_seen + 5 min`` which emits an open interval (``offline_until`` NULL)
when the watermark passes it. Heartbeats from nodes that have not
registered are ignored, as in the controller.

State and per-batch work are per node; the batch size bounds a node's
pandas frame (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``). The watermark
is the caller's statement of how far clocks may differ: rows older than it are
dropped by Spark, so it has no default. Within it, a signal older than a node's
``last_seen`` cannot move ``last_seen`` back.

The rows are a change log: an open interval may be followed by the same interval
with its end. ``settled`` keeps the newest form of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roverlake.operators.edge import LIVENESS_SECONDS

OUTPUT_SCHEMA = "node_id string, last_seen timestamp, offline_from timestamp, offline_until timestamp"
STATE_SCHEMA = "last_seen_us long, registered boolean, reported boolean"
_GAP_US = LIVENESS_SECONDS * 1_000_000


def _to_us(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy()


def _from_us(a) -> pd.Series:
    return pd.to_datetime(pd.Series(a, dtype="int64"), unit="us")


def _arm(state: GroupState, last_us: int) -> None:
    """Timer at ``last_seen + 5 min``, or as soon as possible if that has passed.
    Spark clears the timer on every call, so each call that keeps state sets it."""
    state.setTimeoutTimestamp(max((last_us + _GAP_US) // 1000, state.getCurrentWatermarkMs() + 1))


def _monitor(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    node_id = key[0]
    if state.hasTimedOut:
        last_us, registered, _ = state.get
        state.update((last_us, registered, True))  # no new timer until the next signal
        yield pd.DataFrame({
            "node_id": [node_id], "last_seen": _from_us([last_us]),
            "offline_from": _from_us([last_us + _GAP_US]), "offline_until": pd.Series([pd.NaT], dtype="datetime64[us]"),
        })
        return
    rows = pd.concat(list(batches), ignore_index=True)
    all_us = _to_us(rows["ts"])
    order = np.lexsort((rows["seq"].to_numpy(), all_us))
    kind = rows["kind"].to_numpy()[order]
    last_us, registered, reported = state.get if state.exists else (None, False, False)
    is_reg = kind == "register"
    known = np.maximum.accumulate(is_reg | registered)
    ts = all_us[order][is_reg | ((kind == "heartbeat") & known)]
    registered = bool(known[-1]) if len(known) else registered
    if last_us is not None:
        ts = ts[ts >= last_us]
    if ts.size == 0:  # no news of the node: the timer that was running goes on
        state.update((last_us, registered, reported))
        if last_us is not None and not reported:
            _arm(state, last_us)
        return
    prev = np.concatenate([[last_us], ts[:-1]]) if last_us is not None else ts[:-1]
    nxt = ts if last_us is not None else ts[1:]
    gaps = (nxt - prev) > _GAP_US
    out = pd.DataFrame({
        "node_id": node_id,
        "last_seen": _from_us(prev[gaps]),
        "offline_from": _from_us(prev[gaps] + _GAP_US),
        "offline_until": _from_us(nxt[gaps]),
    })
    state.update((int(ts[-1]), registered, False))
    _arm(state, int(ts[-1]))
    if len(out):
        yield out


def offline_stream(edge_log: DataFrame, watermark: str) -> DataFrame:
    """Streaming offline intervals from an edge request log stream
    (columns ``kind, node_id, seq, ts``)."""
    src = edge_log.select("kind", "node_id", "seq", F.col("ts").cast("timestamp").alias("ts"))
    return (
        src.withWatermark("ts", watermark)
        .groupBy("node_id")
        .applyInPandasWithState(_monitor, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    )


def settled(rows: DataFrame) -> DataFrame:
    """The newest form of each interval of the stream's output: its end once it has
    one, NULL while the node is still offline."""
    return rows.groupBy("node_id", "last_seen", "offline_from").agg(F.max("offline_until").alias("offline_until"))
