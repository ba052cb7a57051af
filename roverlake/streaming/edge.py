"""Edge-node requests on a stream: acceptance, deployments, the registration cache.

Keyed state per node, or per bucket of nodes (``applyInPandasWithState``); rows of a micro-batch
are put in order before they are applied, and a key's frame is bounded by the batch
(``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``).

* ``decided_stream`` (J1, J2): a request is accepted if its node has registered before it,
  in arrival order over all micro-batches; no timer, so no request is ever too late.
* ``deployment_stream`` (R4): ``deploying`` on request and ``deployed`` 5 s later. A node's
  pending deployments are kept with their due times and the timer stands at the next.
* ``registration_stream`` (S7): cache entries that expire after 5 minutes unless the node
  registers again, which restarts the expiry.

The last two use event time: rows older than the watermark are dropped by Spark, so it has
no default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roverlake.operators.edge import LIVENESS_SECONDS, deployment_id

_DELAY_US = 5_000_000
_TTL_US = LIVENESS_SECONDS * 1_000_000
#: groups of nodes that share a call and a state row: a call of its own for each node costs more than its rows
BUCKETS = 128
REQUEST = ("kind", "node_id", "seq", "ts", "model_id", "version")
DECIDED = "kind string, node_id string, seq long, ts timestamp, model_id string, version string, epoch long, accepted boolean"
DEPLOYMENT = "deployment_id string, model_id string, version string, node_id string, deployed_at timestamp, seq long, status string"
PENDING = "epoch long, ids array<string>, models array<string>, versions array<string>, times array<long>, seqs array<long>"
LIVE = "nodes array<string>, seqs array<long>, times array<long>"
CACHED = "node_id string, seq long, registered_at timestamp, expires_at timestamp, live_until timestamp"


def _us(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _times(us) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us")


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
    epoch = (state.get[0] if state.exists else 0) + (rows["kind"] == "register").cumsum()
    rows["epoch"] = epoch.astype("int64")
    rows["accepted"] = (rows["kind"] == "register") | (rows["epoch"] > 0)
    state.update((int(rows["epoch"].iloc[-1]),))
    yield rows[[*REQUEST, "epoch", "accepted"]]


def decided_stream(edge_log: DataFrame) -> DataFrame:
    """Every request with ``epoch`` and ``accepted``; refused ones stay rows, for a side table."""
    src = edge_log.where("node_id is not null").select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in REQUEST])
    return src.groupBy("node_id").applyInPandasWithState(_decide, DECIDED, "epoch long", "append", GroupStateTimeout.NoTimeout)


def _deploy(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    node = key[0]
    epoch, *held = state.get if state.exists else (0, [], [], [], [], [])
    # pending deployments by id: model, version, time, seq
    pending = {i: tuple(rest) for i, *rest in zip(*(list(h) for h in held), strict=True)}
    changes: list[tuple] = []
    if not state.hasTimedOut:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        known = epoch + (rows["kind"] == "register").cumsum().to_numpy()
        epoch = int(known[-1])
        asked = rows[(rows["kind"] == "deploy").to_numpy() & (known > 0)]
        for i, model, version, at, seq in zip(asked["deployment_id"], asked["model_id"], asked["version"], _us(asked["ts"]).tolist(), asked["seq"].tolist(), strict=True):
            pending[i] = (model, version, at, seq)  # a request of the same second replaces the one before
            changes.append((i, model, version, at, seq, "deploying"))
    watermark = state.getCurrentWatermarkMs()
    due = [i for i, (_, _, at, _) in pending.items() if at + _DELAY_US <= watermark * 1000]
    changes += [(i, *pending.pop(i), "deployed") for i in sorted(due, key=lambda i: pending[i][2:])]
    columns = [list(c) for c in zip(*((i, *p) for i, p in pending.items()), strict=True)] or [[], [], [], [], []]
    state.update((epoch, *columns))
    if pending:
        state.setTimeoutTimestamp(max(min(columns[3]) // 1000 + _DELAY_US // 1000, watermark + 1))
    if changes:
        ids, models, versions, times, seqs, status = zip(*changes, strict=True)
        yield pd.DataFrame({"deployment_id": ids, "model_id": models, "version": versions, "node_id": node, "deployed_at": _times(times), "seq": seqs, "status": status})


def deployment_stream(edge_log: DataFrame, watermark: str) -> DataFrame:
    """Change log of accepted deployments: a row when one is requested and one when it is deployed."""
    src = edge_log.where("node_id is not null and kind in ('register', 'deploy')").withColumn("deployment_id", deployment_id())
    src = src.select("kind", "node_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "model_id", "version", "deployment_id")
    return src.withWatermark("ts", watermark).groupBy("node_id").applyInPandasWithState(_deploy, DEPLOYMENT, PENDING, "append", GroupStateTimeout.EventTimeTimeout)


def deployments_now(changes: DataFrame) -> DataFrame:
    """The newest change of each deployment: its last request, deployed or not yet."""
    row = F.struct(*[F.col(c) for c in ("model_id", "version", "node_id", "deployed_at", "seq", "status")])
    newest = F.max_by(row, F.struct("seq", (F.col("status") == "deployed").alias("done")))
    return changes.groupBy("deployment_id").agg(newest.alias("d")).select("deployment_id", "d.*")


def _cache(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    nodes, seq, us = (np.array(list(h), dtype=t) for h, t in zip(state.get if state.exists else ([], [], []), ("object", "int64", "int64"), strict=True))
    opened = 0
    if not state.hasTimedOut:
        rows = pd.concat(list(batches), ignore_index=True)
        opened = len(rows)
        nodes, seq, us = np.concatenate([rows["node_id"].to_numpy("object"), nodes]), np.concatenate([rows["seq"].to_numpy("int64"), seq]), np.concatenate([_us(rows["ts"]), us])
    sent = [(nodes[:opened], seq[:opened], us[:opened], np.full(opened, np.iinfo("int64").min))]  # NaT: the entry is open
    code = pd.factorize(nodes)[0]
    order = np.lexsort((seq, us, code))
    nodes, seq, us, code = nodes[order], seq[order], us[order], code[order]
    # an entry ends with the node's next one; one older than the live entry does not end it, but is itself closed at once
    followed = np.append(code[1:] == code[:-1], [False]) if len(code) else np.zeros(0, "bool")
    sent.append((nodes[followed], seq[followed], us[followed], np.minimum(np.roll(us, -1), us + _TTL_US)[followed]))
    due = ~followed & (us + _TTL_US <= state.getCurrentWatermarkMs() * 1000)
    sent.append((nodes[due], seq[due], us[due], us[due] + _TTL_US))
    live = ~followed & ~due
    if live.any():
        state.update((nodes[live].tolist(), seq[live].tolist(), us[live].tolist()))
        state.setTimeoutTimestamp(max((int(us[live].min()) + _TTL_US) // 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    nodes, seq, starts, ends = (np.concatenate(c) for c in zip(*sent, strict=True))
    if len(seq):
        yield pd.DataFrame({"node_id": nodes, "seq": seq, "registered_at": _times(starts), "expires_at": _times(starts + _TTL_US), "live_until": pd.Series(ends.view("datetime64[us]")).astype("datetime64[ns]")})


def registration_stream(edge_log: DataFrame, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """Change log of cache entries: opened (``live_until`` NULL), then closed by expiry or by
    the node's next registration. A call serves a bucket of nodes; its state is their live
    entries, and its timer stands at the next expiry."""
    src = edge_log.where("node_id is not null and ts is not null and kind = 'register'").select("node_id", "seq", F.col("ts").cast("timestamp").alias("ts"))
    src = src.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets))).withWatermark("ts", watermark)
    return src.groupBy("bucket").applyInPandasWithState(_cache, CACHED, LIVE, "append", GroupStateTimeout.EventTimeTimeout)


def cache_entries(changes: DataFrame) -> DataFrame:
    """Each entry with its end: the one it had, or its expiry while it is open."""
    return changes.groupBy("node_id", "seq", "registered_at", "expires_at").agg(F.coalesce(F.min("live_until"), F.col("expires_at")).alias("live_until"))
