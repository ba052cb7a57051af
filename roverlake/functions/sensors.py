"""Column-level sensor reductions of the robot bridge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roverlake.functions.util import as_col

# ---------------------------------------------------------------------------
# Fixed values of the bridge.
# Laser down-sampling: keep every (n div 36)-th beam when n > 36, else all
#   ("one point every 10 degrees").
# Battery: percentage > 0 -> percentage * 100; otherwise previous - 0.01,
#   never below 0; start value 100.
# Start state: battery 100.0, position (0, 0, 0), orientation (0, 0, 0, 1),
#   velocity linear 0.0 angular 0.0, laser ranges empty, imu zeros,
#   status "active", temperature 25.0.
# Snapshot metadata: source "gazebo_simulation", robot_type "turtlebot3",
#   bridge_version "1.0.0".
# Diagnostics: any level > 1 -> "warning"; else any level > 0 -> "degraded";
#   else "active".
# ---------------------------------------------------------------------------
LASER_SECTORS = 36
BATTERY_DECAY = 0.01
BATTERY_START = 100.0
TEMPERATURE_START = 25.0
STATUS_START = "active"
SNAPSHOT_METADATA = {"source": "gazebo_simulation", "robot_type": "turtlebot3", "bridge_version": "1.0.0"}


def planar_speed(vx, vy) -> Column:
    """Linear speed from the twist (F13): sqrt(x^2 + y^2), z ignored."""
    vx, vy = as_col(vx), as_col(vy)
    return F.sqrt(vx * vx + vy * vy)


def odometry_state(px, py, pz, ox, oy, oz, ow, vx, vy, wz) -> Column:
    """Odometry reshaped to the bridge's position / orientation / velocity struct."""
    return F.struct(
        F.struct(as_col(px).alias("x"), as_col(py).alias("y"), as_col(pz).alias("z")).alias("position"),
        F.struct(as_col(ox).alias("x"), as_col(oy).alias("y"), as_col(oz).alias("z"), as_col(ow).alias("w"))
        .alias("orientation"),
        F.struct(planar_speed(vx, vy).alias("linear"), as_col(wz).alias("angular")).alias("velocity"),
    )


def laser_step(ranges) -> Column:
    """Sampling step (F14): n div 36 when n > 36, else 1."""
    n = F.size(as_col(ranges))
    return F.when(n > LASER_SECTORS, F.floor(n / LASER_SECTORS)).otherwise(F.lit(1)).cast("int")


def laser_downsample(ranges) -> Column:
    """Every step-th beam starting at the first, like ``ranges[::step]``."""
    r = as_col(ranges)
    step = laser_step(r)
    return F.filter(r, lambda x, i: i % step == 0)


def laser_info(ranges, angle_min, angle_max, angle_increment, range_min, range_max) -> Column:
    r = as_col(ranges)
    return F.struct(
        as_col(angle_min).alias("angle_min"),
        as_col(angle_max).alias("angle_max"),
        (as_col(angle_increment) * laser_step(r)).alias("angle_increment"),
        as_col(range_min).alias("range_min"),
        as_col(range_max).alias("range_max"),
        F.size(r).alias("total_points"),
        F.size(laser_downsample(r)).alias("sampled_points"),
    )


def imu_state(ax, ay, az, gx, gy, gz, ox, oy, oz, ow) -> Column:
    """IMU message reshaped."""
    def xyz(a, b, c):
        return F.struct(as_col(a).alias("x"), as_col(b).alias("y"), as_col(c).alias("z"))

    return F.struct(
        xyz(ax, ay, az).alias("linear_accel"),
        xyz(gx, gy, gz).alias("angular_vel"),
        F.struct(as_col(ox).alias("x"), as_col(oy).alias("y"), as_col(oz).alias("z"), as_col(ow).alias("w"))
        .alias("orientation"),
    )


def percent(p) -> Column:
    """Battery percentage as percent (F16)."""
    return as_col(p) * 100


def diagnostics_status(entries) -> Column:
    """Overall robot status from all diagnostic entries."""
    levels = F.transform(as_col(entries), lambda e: e["level"])
    top = F.array_max(levels)
    return (
        F.when(F.coalesce(top, F.lit(0)) > 1, F.lit("warning"))
        .when(F.coalesce(top, F.lit(0)) > 0, F.lit("degraded"))
        .otherwise(F.lit("active"))
    )


def diagnostics_map(entries, values: bool = False) -> Column:
    """name -> (level, message) map; a repeated name keeps the last entry. With ``values``
    also the map of an entry's ``values`` (``key, value``), of which a repeated key
    keeps the last.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by ``configure``).
    """
    return F.map_from_entries(
        F.transform(
            as_col(entries),
            lambda e: F.struct(e["name"].alias("key"), F.struct(
                e["level"].alias("level"), e["message"].alias("message"), *([F.map_from_entries(e["values"]).alias("values")] if values else []),
            ).alias("value")),
        )
    )


def snapshot_metadata() -> Column:
    """Constant metadata attached to every snapshot."""
    return F.struct(*[F.lit(v).alias(k) for k, v in SNAPSHOT_METADATA.items()])
