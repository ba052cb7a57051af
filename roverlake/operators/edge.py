"""Edge-node controller as queries over its request log (J1, J2, W4-W6,
A6-A8, S7, R4, F19, P12, P13).

The reference keeps nodes and deployments in in-memory maps mutated by
requests. Here the requests are an append-only log
(``kind in register|heartbeat|deploy, node_id, seq, ts, status, cpu, mem,
model_id, version``, and where the requests carry them ``name, ip, cpu_cores,
memory_gb, gpu_memory_gb, disk_gb, models, config``) and every read is an
``as_of`` query on it.

Order matters: a heartbeat or deployment for a node that has not registered
*yet* is refused, and a new registration replaces the whole node row
(including its deployed-model list). Both reduce to comparisons with the
node's first and last registration sequence numbers (``registrations``, a
per-node partial aggregate joined back), so node state, deployments and
health need no ordered scan. Where a per-request running value is part of
the answer -- the registration **epoch** of each request (J1, J2) and the
position in the deployed-model list (W5) -- the chunked scan of
``operators.scan`` computes it, in chunks of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roverlake.functions.time import rfc3339, unix_seconds
from roverlake.operators.scan import CHUNK_ROWS, DEFAULT_CHUNK, chunk_of, chunk_of_seq, next_value, running

# ---------------------------------------------------------------------------
# Fixed values of the controller.
#   liveness window 5 minutes (node active when now - last_seen < 5 min;
#   monitor marks offline when now - last_seen > 5 min)
#   registration cache expiry 5 minutes
#   deployment: "deploying", then "deployed" 5 seconds later
#   registered node status "active"; monitor status "offline"
#   deployment id: model_id-node_id-unix seconds
# ---------------------------------------------------------------------------
LIVENESS = "INTERVAL 5 MINUTES"
LIVENESS_SECONDS = 300
CACHE_TTL = "INTERVAL 5 MINUTES"
DEPLOY_DELAY = "INTERVAL 5 SECONDS"
REGISTERED_STATUS = "active"
OFFLINE_STATUS = "offline"

#   a register or heartbeat without a resource reports it as 0, one without a name
#   or address as empty
ORDER = ("seq",)
# parts of requests that a log may lack; cpu and mem are the usage figures
IDENTITY = {"name": "string", "ip": "string"}
RESOURCES = {"cpu_cores": "int", "memory_gb": "double", "gpu_memory_gb": "double", "disk_gb": "double"}
OPTIONAL = {**IDENTITY, **RESOURCES, "models": "array<string>", "config": "string"}


def whole(log: DataFrame) -> DataFrame:
    """The log with every optional part (NULL where it has none)."""
    return log.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in log.columns})


def with_epoch(log: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``epoch`` = registrations of the node up to and including this
    request, and the scan's chunk ``_chunk`` (kept so later per-node scans reuse
    the same partitioning). Chunks are cut on ``seq``, which is also the order,
    so a clock that steps back or a missing ``ts`` changes nothing."""
    is_reg = (F.col("kind") == "register").cast("long")
    is_dep = (F.col("kind") == "deploy").cast("long")
    staged = log.withColumn("_chunk", chunk_of_seq("seq", chunk_rows))
    return running(staged, "node_id", ORDER, "_chunk", sums={"epoch": is_reg, "_deploys": is_dep})


def requests_decided(log: DataFrame) -> DataFrame:
    """Every request with ``accepted`` (J1, J2): registers always; heartbeats and
    deployments only for a node registered earlier (D11: unknown-node
    heartbeats are refused, not silently acknowledged)."""
    e = with_epoch(log)
    return e.withColumn("accepted", (F.col("kind") == "register") | (F.col("epoch") > 0))


def registrations(log: DataFrame) -> DataFrame:
    """Per-node registration summary: first and last registration, their
    count (the node's current epoch) and the time of the last one. A partial
    aggregate of the log."""
    regs = log.where(F.col("kind") == "register")
    return regs.groupBy("node_id").agg(
        F.min("seq").alias("first_reg_seq"),
        F.max("seq").alias("last_reg_seq"),
        F.count(F.lit(1)).alias("epoch"),
        F.max_by(F.col("ts"), F.col("seq")).alias("registered_at"),
        *[F.max_by(F.coalesce(c, F.lit("")), F.col("seq")).alias(f"registered_{c}") for c in IDENTITY if c in log.columns],
    )


def accepted_requests(log: DataFrame) -> DataFrame:
    """Requests of registered nodes with ``accepted`` (registered earlier) and
    ``current`` (at or after the node's last registration). Order-dependent
    acceptance reduces to a comparison with per-node registration sequence
    numbers, so no ordered scan of the log is needed; the per-node table is
    joined back (broadcast by AQE when small, otherwise a sort-merge join with
    skew splitting)."""
    return log.join(registrations(log), "node_id").withColumns({
        "accepted": (F.col("kind") == "register") | (F.col("seq") > F.col("first_reg_seq")),
        "current": F.col("seq") >= F.col("last_reg_seq"),
    })


def _signals(acc: DataFrame) -> DataFrame:
    """Requests that set ``last_seen``: registrations and accepted heartbeats."""
    return acc.where(F.col("accepted") & F.col("kind").isin("register", "heartbeat"))


def current_nodes(log: DataFrame, as_of) -> DataFrame:
    """Current node rows (W4, P12, A8), one per registered node.

    A registration forces status 'active'; a heartbeat replaces status and
    all resources, also with zeros for those it does not name; both set
    ``last_seen``. Name and address come from the last registration. The monitor overrides the status with 'offline' once
    ``as_of - last_seen`` exceeds 5 minutes. One partial aggregate per node.
    """
    sig = _signals(accepted_requests(whole(log)))
    latest = F.max_by(F.struct("kind", "status", "cpu", "mem", "ts", *RESOURCES), F.col("seq"))
    nodes = sig.groupBy("node_id").agg(
        latest.alias("l"), F.first("registered_at").alias("registered_at"), F.first("epoch").alias("epoch"),
        *[F.first(f"registered_{c}").alias(c) for c in IDENTITY],
    )
    reported = F.when(F.col("l.kind") == "register", F.lit(REGISTERED_STATUS)).otherwise(F.col("l.status"))
    offline = (F.col("l.ts").cast("timestamp") < as_of_col(as_of).cast("timestamp") - F.expr(LIVENESS))
    return nodes.select(
        "node_id",
        F.when(offline, F.lit(OFFLINE_STATUS)).otherwise(reported).alias("status"),
        F.col("l.cpu").alias("cpu"), F.col("l.mem").alias("mem"),
        F.col("l.ts").alias("last_seen"),
        "registered_at",
        "epoch",
        *IDENTITY,
        *[F.coalesce(F.col("l")[c], F.lit(0).cast(t)).alias(c) for c, t in RESOURCES.items()],
    )


def as_of_col(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else F.lit(as_of)


def deployed_models(decided: DataFrame) -> DataFrame:
    """Deployed-model list of each node (W5) as rows ``(node_id, position,
    model_id, seq)``: the models its last registration names, then accepted
    deployments after it, in request order, duplicates kept. A registration
    resets the list.

    Kept as rows rather than one array per node so no task ever holds a
    node's whole list. A deployment's ``position`` comes from the running deploy
    count of the epoch scan minus the deploys before the node's last
    registration (a per-node aggregate), so the log is scanned in order only once.
    """
    decided = whole(decided)
    kind = F.col("kind")
    named = F.coalesce("models", F.array().cast("array<string>"))
    regs = decided.where(kind == "register").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("_last"), F.max("seq").alias("_last_reg"), F.max_by(named, F.col("seq")).alias("_named")
    )
    before = (
        decided.where(kind == "deploy").select("node_id", "seq")
        .join(regs.select("node_id", "_last_reg"), "node_id")
        .where(F.col("seq") < F.col("_last_reg"))
        .groupBy("node_id").agg(F.count(F.lit(1)).alias("_base"))
    )
    cur = (
        decided.where((kind == "deploy") & F.col("accepted"))
        .join(regs.select("node_id", "_last", F.size("_named").alias("_size")), "node_id")
        .where(F.col("epoch") == F.col("_last"))
        .join(before, "node_id", "left")
    )
    position = (F.col("_size") + F.col("_deploys") - F.coalesce(F.col("_base"), F.lit(0))).cast("long")
    first = regs.select("node_id", F.posexplode("_named").alias("at", "model_id"), F.col("_last_reg").alias("seq"))
    first = first.select("node_id", (F.col("at") + 1).cast("long").alias("position"), "model_id", "seq")
    return first.unionByName(cur.select("node_id", position.alias("position"), "model_id", "seq"))


def deployment_id(model: str = "model_id", node: str = "node_id", ts: str = "ts") -> Column:
    """``model-node-unixseconds``."""
    return F.concat_ws("-", F.col(model), F.col(node), unix_seconds(ts).cast("string"))


def deployments(log: DataFrame, as_of) -> DataFrame:
    """Deployment table as of ``as_of`` (R4, P13): accepted deployments keyed by
    id, a later request with the same id (same second) replacing the earlier
    (D10); 'deployed' once 5 seconds have passed, else 'deploying'."""
    deps = accepted_requests(whole(log).where(F.col("kind").isin("register", "deploy"))).where(
        (F.col("kind") == "deploy") & F.col("accepted"))
    row = F.struct("model_id", "version", "node_id", F.col("ts").alias("deployed_at"), "seq", "config")
    t = deps.withColumn("deployment_id", deployment_id()).groupBy("deployment_id").agg(
        F.max_by(row, F.col("seq")).alias("d")
    ).select("deployment_id", "d.*")
    done = as_of_col(as_of).cast("timestamp") >= F.col("deployed_at").cast("timestamp") + F.expr(DEPLOY_DELAY)
    return t.withColumn("status", F.when(done, F.lit("deployed")).otherwise(F.lit("deploying")))


def deployment_status(deps: DataFrame, deployment: str | Column) -> DataFrame:
    """Lookup of one deployment (P13); a miss is an empty result."""
    return deps.where(F.col("deployment_id") == (deployment if isinstance(deployment, Column) else F.lit(deployment)))


def health(nodes: DataFrame, deps: DataFrame, as_of) -> DataFrame:
    """Health counts (A6, A7): nodes total, nodes active (``as_of - last_seen <
    5 min``, strict, on ``last_seen`` not status), deployments."""
    active = F.col("last_seen").cast("timestamp") > as_of_col(as_of).cast("timestamp") - F.expr(LIVENESS)
    n_deps = deps.agg(F.count(F.lit(1))).scalar()
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes_total"),
        F.count_if(active).alias("nodes_active"),
    ).select("*", n_deps.alias("deployments"), rfc3339(as_of_col(as_of).cast("timestamp")).alias("timestamp"))


def live_registrations(log: DataFrame, as_of) -> DataFrame:
    """Registration cache with a 5-minute expiry (S7): each node's last
    registration still younger than 5 minutes at ``as_of``. Heartbeats do
    not refresh it."""
    regs = log.where(F.col("kind") == "register")
    last = regs.groupBy("node_id").agg(F.max_by(F.col("ts"), F.col("seq")).alias("registered_at"))
    fresh = F.col("registered_at").cast("timestamp") > as_of_col(as_of).cast("timestamp") - F.expr(CACHE_TTL)
    return last.where(fresh)


def registration_cache(log: DataFrame) -> DataFrame:
    """History form of the registration cache (S7): each registration's
    entry lives from its time until it expires 5 minutes later or the node
    registers again (which rewrites the entry and restarts the expiry).
    ``live_registrations(as_of)`` equals the entries with
    ``registered_at <= as_of < live_until`` (up to equal timestamps)."""
    regs = log.where(F.col("kind") == "register").select("node_id", "seq", "ts")
    nxt = next_value(regs, "node_id", ("ts", "seq"), chunk_of("ts"), "ts", "next_register")
    expires = F.col("ts") + F.expr(CACHE_TTL)
    return nxt.select(
        "node_id", "seq", F.col("ts").alias("registered_at"), expires.alias("expires_at"),
        F.when(F.col("next_register").isNotNull() & (F.col("next_register") < expires), F.col("next_register"))
        .otherwise(expires).alias("live_until"),
    )


def offline_intervals(log: DataFrame, as_of=None, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Offline periods from gaps in a node's signals (W6, batch form of R3).

    After a signal at ``t`` with no further signal for more than 5 minutes the
    node is offline from ``t + 5 min`` until the next signal (or open, NULL,
    when none has arrived by ``as_of``). The 30 s monitor tick is ignored.

    Signals are registrations and heartbeats after the node's first
    registration (the same rows as accepted heartbeats). They are found with a
    per-node aggregate rather than the epoch scan, so the log is shuffled once,
    by the lead scan below.
    """
    kind = F.col("kind")
    first_reg = log.where(kind == "register").groupBy("node_id").agg(F.min("seq").alias("_first_reg"))
    sig = (
        log.where(kind.isin("register", "heartbeat"))
        .select("node_id", "seq", "ts")
        .join(first_reg, "node_id")
        .where(F.col("seq") >= F.col("_first_reg"))
        .drop("_first_reg")
    )
    nxt = next_value(sig, "node_id", ("ts", "seq"), chunk_of("ts", chunk), "ts", "next_ts")
    gap_s = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    closed = F.col("next_ts").isNotNull() & (gap_s > LIVENESS_SECONDS * 1_000_000)
    cond = closed
    if as_of is not None:
        tail_gap = F.unix_micros(as_of_col(as_of).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
        cond = closed | (F.col("next_ts").isNull() & (tail_gap > LIVENESS_SECONDS * 1_000_000))
    return nxt.where(cond).select(
        "node_id",
        F.col("ts").alias("last_seen"),
        (F.col("ts") + F.expr(LIVENESS)).alias("offline_from"),
        F.col("next_ts").alias("offline_until"),
    )
