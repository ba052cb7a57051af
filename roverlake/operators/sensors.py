"""Bridge-side state over sensor streams (W3, A11, J4/R2 batch form).

Order-dependent state (battery decay, newest value per channel) is computed
with the chunked scans of ``operators.scan`` so that one busy robot does not
serialize the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roverlake.functions import sensors as SF
from roverlake.functions.time import parse_width
from roverlake.operators.scan import DEFAULT_CHUNK, chunk_of, running

ORDER = ("time", "arrival_seq")


def battery_series(readings: DataFrame, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Battery value after each reading.

    Sequential rule: a positive percentage sets ``p * 100``; a zero or
    negative one decays the previous value by 0.01, floored at 0; the start
    value is 100. Closed form: ``greatest(0, base - 0.01 * n)`` with ``base``
    the last positive reading (or the start value) and ``n`` the number of
    non-positive readings since it.

    Plan (one shuffle of the readings): rows are hash-partitioned by
    ``(robot, time chunk)`` and scanned with windows inside each chunk; what a
    chunk inherits from earlier chunks (last base, decay steps since it) is
    built from per-chunk aggregates of the input -- tiny, and joined back on
    ``(robot, chunk)`` without moving the big side again.
    """
    p = F.col("percentage")
    pos = p > 0
    o = F.struct(*[F.col(c) for c in ORDER])
    staged = readings.withColumns({
        "_chunk": chunk_of("time", chunk),
        "_np": F.when(pos, 0).otherwise(1).cast("long"),
        "_b": F.when(pos, SF.percent(p)),
    })
    keys = ["robot_id", "_chunk"]

    # 1. inside each chunk
    w = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumns({
        "_lnp": F.sum("_np").over(w),
        "_lbase": F.last("_b", ignorenulls=True).over(w),
    }).withColumn("_lnp_at_base", F.last(F.when(pos, F.col("_lnp")), ignorenulls=True).over(w))

    # 2. per-chunk summaries from the input (partial aggregates)
    per_chunk = staged.groupBy(*keys).agg(
        F.sum("_np").alias("tot_np"),
        F.max_by("_b", F.when(pos, o)).alias("last_base"),
        F.max(F.when(pos, o)).alias("last_pos"),
    )
    after = (
        staged.join(per_chunk.select(*keys, "last_pos"), keys)
        .where(o > F.col("last_pos"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("np_after"))
    )
    summary = per_chunk.join(after, keys, "left").withColumn("np_after", F.coalesce("np_after", F.lit(0)))
    wc = Window.partitionBy("robot_id").orderBy("_chunk")
    prev = wc.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("cum_before", F.coalesce(F.sum("tot_np").over(prev), F.lit(0)))
    at_base = F.when(F.col("last_pos").isNotNull(), F.col("cum_before") + F.col("tot_np") - F.col("np_after"))
    carry = summary.select(
        *keys,
        F.last("last_base", ignorenulls=True).over(prev).alias("base_in"),
        (F.col("cum_before") - F.coalesce(F.last(at_base, ignorenulls=True).over(prev), F.lit(0))).alias("n_in"),
    )

    # 3. combine
    joined = local.join(carry, keys, "left")
    in_chunk = F.col("_lbase").isNotNull()
    base = F.when(in_chunk, F.col("_lbase")).otherwise(F.coalesce("base_in", F.lit(SF.BATTERY_START)))
    n = F.when(in_chunk, F.col("_lnp") - F.col("_lnp_at_base")).otherwise(F.col("n_in") + F.col("_lnp"))
    return joined.withColumn("battery", F.greatest(F.lit(0.0), base - F.lit(SF.BATTERY_DECAY) * n)).drop(
        "_chunk", "_np", "_b", "_lnp", "_lbase", "_lnp_at_base", "base_in", "n_in"
    )


def diagnostics_rollup(diag: DataFrame) -> DataFrame:
    """Diagnostics fold (A11): name map (last entry wins; with the values of entries that
    have them) and overall status."""
    return diag.select(
        "robot_id", "time", "arrival_seq",
        SF.diagnostics_map("status", _has_values(diag)).alias("diagnostics"),
        SF.diagnostics_status("status").alias("status"),
    )


def _has_values(diag: DataFrame) -> bool:
    return "values" in diag.schema["status"].dataType.elementType.fieldNames()


def tick_of(time_col: str, seconds: int) -> Column:
    """First tick at or after the reading: a reading exactly on a tick is in it."""
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    step = seconds * 1_000_000
    return F.timestamp_micros(F.floor((us + (step - 1)) / step) * step).cast("timestamp_ntz")


def snapshots(
    readings: DataFrame,
    channels: dict[str, float | None],
    tick_seconds: int = 2,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Newest value of every channel at each snapshot tick (J4, R2 batch form).

    Input rows: ``robot_id, time, arrival_seq, channel, reading``.
    ``channels``: channel name -> value before its first reading.

    A tick is emitted for every (robot, tick) that received at least one
    reading (a NaN is none, though it counts); between such ticks the state is unchanged, so the dense 2-second
    series is these rows carried forward (ticks without news would repeat
    the previous row). That keeps the output proportional to the input
    instead of to robots x elapsed time.
    """
    wide = readings.withColumn("tick", tick_of("time", tick_seconds)).withColumns({
        f"_ch_{c}": F.when((F.col("channel") == c) & ~F.isnan(F.col("reading").cast("double")), F.col("reading")) for c in channels
    })
    # Chunks are cut on the tick (which grows with the time), so no tick spans
    # two chunks: grouping by (robot, chunk, tick) is satisfied by the scan's
    # (robot, chunk) partitioning and adds no shuffle.
    wide = wide.withColumn("_chunk", chunk_of("tick", chunk))
    filled = running(
        wide, "robot_id", ORDER, "_chunk",
        lasts={f"_f_{c}": F.col(f"_ch_{c}") for c in channels},
    )
    state = F.struct(*[F.col(f"_f_{c}").alias(c) for c in channels])
    per_tick = (
        filled.groupBy("robot_id", "_chunk", "tick")
        .agg(F.max_by(state, F.struct(*ORDER)).alias("s"), F.count(F.lit(1)).alias("readings"))
    )
    values = [
        (F.coalesce(F.col(f"s.{c}"), F.lit(d)) if d is not None else F.col(f"s.{c}")).alias(c)
        for c, d in channels.items()
    ]
    return per_tick.select("robot_id", "tick", *values, "readings", SF.snapshot_metadata().alias("metadata"))


def by_channel(readings: DataFrame, channels) -> DataFrame:
    """Readings in long form (``channel, reading``) with one column for each channel;
    a NaN is no reading."""
    value = F.col("reading").cast("double")
    return readings.select(
        "robot_id", "time", "arrival_seq",
        *[F.when((F.col("channel") == c) & ~F.isnan(value), value).alias(c) for c in channels])


def dense_snapshots(
    messages: DataFrame,
    channels: dict[str, Column],
    start: Column,
    end: Column,
    tick_seconds: int = 2,
    chunk: str = DEFAULT_CHUNK,
    robots: DataFrame | None = None,
) -> DataFrame:
    """Newest value of every channel at every tick of the closed range (J4, dense).

    ``messages``: ``robot_id, time, arrival_seq`` and a column for each channel of any
    type (NULL: this message says nothing of it). ``channels``: name -> value before
    the first reading. ``robots`` (column ``robot_id``) are those with a series; by
    default all of ``messages``. Each has every tick, before its first reading too; a
    reading exactly on a tick is in it. Messages without a robot or a time are left out.

    Values run through chunks of messages with a carry-in, like ``snapshots``. Each
    (robot, chunk) has one opening row, so a long series is many tasks' work, and each row
    stands for the ticks up to the next one: ticks are made last, neither shuffled nor
    sorted. What lies before the range is folded to one row for each robot.
    """
    width = parse_width(chunk)[0] * 1_000_000
    step = tick_seconds * 1_000_000
    if width % step:
        raise ValueError("a chunk must hold whole ticks")
    low, high = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    first, last = low + F.pmod(-low, F.lit(step)), high - F.pmod(high, F.lit(step))
    known = messages.where("robot_id is not null and time is not null")
    us = F.unix_micros(F.col("time").cast("timestamp"))
    names = list(channels)
    known = known.select("robot_id", us.alias("us"), "arrival_seq", *names)

    opening = _newest(known.where(F.col("us") < low), names).select("robot_id", first.alias("tick"), F.lit(0).alias("part"), *names)
    inside = known.where(F.col("us").between(low, high)).withColumn("tick", F.col("us") + F.pmod(-F.col("us"), F.lit(step))).where(F.col("tick") <= last)
    inside = inside.select("robot_id", "tick", F.lit(2).alias("part"), "us", "arrival_seq", *names)
    who = (robots if robots is not None else known).select("robot_id").where("robot_id is not null").distinct()
    spans = who.where(first <= last).withColumn("chunk", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))))
    begun = spans.select("robot_id", F.greatest(first, F.col("chunk") * width).alias("tick"), F.lit(1).alias("part"))

    rows = inside.unionByName(opening, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    rows = rows.withColumn("_chunk", F.floor(F.col("tick") / width).cast("long"))
    # as many tasks as the session has: the rows are few, what they stand for is not
    rows = rows.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "robot_id", "_chunk")
    order = ("tick", "part", "us", "arrival_seq")
    w = Window.partitionBy("robot_id", "_chunk").orderBy(*order)
    stop = F.coalesce(F.lead("tick").over(w), F.least(last + step, (F.col("_chunk") + 1) * width))
    # a chunk without an opening row is of a robot that was not asked for
    rows = rows.withColumn("_stop", F.when(F.max(F.col("part") == 1).over(w), stop))
    filled = running(rows, "robot_id", order, "_chunk", lasts={f"_f_{c}": F.col(c) for c in names}).where("_stop > tick")
    values = [F.coalesce(F.col(f"_f_{c}"), default).alias(c) for c, default in channels.items()]
    made = filled.select("robot_id", F.explode(F.sequence("tick", F.col("_stop") - step, F.lit(step).cast("long"))).alias("us"), *values)
    return made.select("robot_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("tick"), *names)


def _newest(messages: DataFrame, names: list[str]) -> DataFrame:
    """One row for each robot: the newest value of each channel by (us, arrival_seq).

    The newest time of each channel is found first, by aggregates of numbers, which hash;
    only rows at those times reach the aggregate of whole values, which sorts its rows.
    """
    times = messages.groupBy("robot_id").agg(*[F.max(F.when(F.col(c).isNotNull(), F.col("us"))).alias(f"_at_{c}") for c in names])
    points = times.select("robot_id", F.explode(F.array_distinct(F.array(*[f"_at_{c}" for c in names]))).alias("us"))
    met = messages.join(points, ["robot_id", "us"], "left_semi")
    order = F.struct("us", "arrival_seq")
    return met.groupBy("robot_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in names])


def bridge_messages(odometry: DataFrame, scans: DataFrame, imu: DataFrame, battery: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """The bridge's callbacks as messages for ``dense_snapshots`` or ``bridge_record``: what
    each sensor message sets in the robot's cache (F13-F16, A11). Inputs share
    ``robot_id, time, arrival_seq``; see the column names below for the rest."""
    at = ["robot_id", "time", "arrival_seq"]
    odom = odometry.select(*at, SF.odometry_state("px", "py", "pz", "ox", "oy", "oz", "ow", "vx", "vy", "wz").alias("o"), F.col("time").alias("last_update"))
    odom = odom.select(*at, "o.position", "o.orientation", "o.velocity", "last_update")
    laser = scans.select(
        *at, SF.laser_downsample("ranges").alias("laser_ranges"),
        SF.laser_info("ranges", "angle_min", "angle_max", "angle_increment", "range_min", "range_max").alias("laser_info"))
    inertia = imu.select(*at, SF.imu_state("ax", "ay", "az", "gx", "gy", "gz", "ox", "oy", "oz", "ow").alias("imu"))
    power = battery_series(battery).select(*at, "battery")
    health = diagnostics.select(*at, SF.diagnostics_map("status", _has_values(diagnostics)).alias("diagnostics"), SF.diagnostics_status("status").alias("status"))
    out = odom
    for other in (laser, inertia, power, health):
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def bridge_defaults(messages: DataFrame) -> dict[str, Column]:
    """The cache before the first message, by channel (``last_update``, set when the
    bridge starts, and what has no start value are NULL)."""
    def start(name: str, value: Column) -> Column:
        return value.cast(messages.schema[name].dataType.simpleString())  # every part may be NULL

    def zeros(*names: str, **others: float) -> Column:
        return F.struct(*[F.lit(0.0).alias(n) for n in names], *[F.lit(v).alias(n) for n, v in others.items()])

    nothing = F.lit(None)
    return {
        "battery": F.lit(SF.BATTERY_START),
        "position": start("position", zeros("x", "y", "z")),
        "orientation": start("orientation", zeros("x", "y", "z", w=1.0)),
        "velocity": start("velocity", zeros("linear", "angular")),
        "laser_ranges": start("laser_ranges", F.array()),
        "laser_info": start("laser_info", nothing),
        "imu": start("imu", F.struct(zeros("x", "y", "z").alias("linear_accel"), zeros("x", "y", "z").alias("angular_vel"), nothing.cast("struct<x: double, y: double, z: double, w: double>").alias("orientation"))),
        "diagnostics": start("diagnostics", nothing),
        "status": F.lit(SF.STATUS_START),
        "last_update": start("last_update", nothing),
    }


def bridge_record(messages: DataFrame, start: Column, end: Column, tick_seconds: int = 2, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """The whole cache of each robot at every tick of the range, as the bridge sends it
    (J4, F22): one row a tick with ``data`` fields and the constant metadata."""
    dense = dense_snapshots(messages, bridge_defaults(messages), start, end, tick_seconds, chunk)
    return dense.withColumns({"temperature": F.lit(SF.TEMPERATURE_START), "metadata": SF.snapshot_metadata()})
