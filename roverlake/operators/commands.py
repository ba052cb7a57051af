"""Cloud command normaliser.

The bridge turns a command object into a velocity twist or a navigation
goal and publishes it to the robot. Publishing is outside this library; the
operator produces the normalised command rows that a publisher would send,
and rejects unknown command types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roverlake.functions import json as J

# ---------------------------------------------------------------------------
# Fixed values of the bridge's command handling.
#   move: twist linear.x = linear (default 0.0), angular.z = angular (default 0.0)
#   goto: goal in frame "map", position x, y (default 0.0), orientation w = 1.0
#   stop: all-zero twist
#   anything else: unknown command (rejected)
# ---------------------------------------------------------------------------
GOAL_FRAME = "map"
GOAL_ORIENTATION_W = 1.0


def _number(c, key: str):
    """``float(command.get(key, 0.0))``: absent -> 0.0; a number, a numeric
    string or a boolean converts; anything else (null, text, object) is NULL,
    i.e. the command fails."""
    v = F.try_variant_get(J.variant(c), f"$['{key}']", "variant")
    t = F.schema_of_variant(v)
    as_num = (
        F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(t == "STRING", J.to_double(F.trim(F.try_variant_get(v, "$", "string"))))
        .when(t != "VOID", F.try_variant_get(v, "$", "double"))
    )
    return F.when(J.has_key(c, key), as_num).otherwise(F.lit(0.0))


def normalise_commands(df: DataFrame, command_col: str = "command") -> DataFrame:
    """Command rows -> twist / goal rows; ``accepted`` is false for unknown
    types and for values the bridge cannot convert."""
    c = F.col(command_col)
    ctype = J.field_text(c, "type")
    is_move, is_goto, is_stop = ctype == "move", ctype == "goto", ctype == "stop"
    lin, ang, gx, gy = _number(c, "linear"), _number(c, "angular"), _number(c, "x"), _number(c, "y")
    staged = df.withColumns({"_lin": lin, "_ang": ang, "_gx": gx, "_gy": gy, "_type": ctype})
    t = F.col("_type")
    is_move, is_goto, is_stop = t == "move", t == "goto", t == "stop"
    values_ok = (
        F.when(is_move, F.col("_lin").isNotNull() & F.col("_ang").isNotNull())
        .when(is_goto, F.col("_gx").isNotNull() & F.col("_gy").isNotNull())
        .otherwise(F.lit(True))
    )
    twist = is_move | is_stop
    return staged.select(
        *[x for x in df.columns if x != command_col],
        t.alias("type"),
        F.when(twist, F.lit("twist")).when(is_goto, F.lit("goal")).alias("action"),
        F.when(is_move, F.col("_lin")).when(is_stop, F.lit(0.0)).alias("linear_x"),
        F.when(is_move, F.col("_ang")).when(is_stop, F.lit(0.0)).alias("angular_z"),
        F.when(is_goto, F.col("_gx")).alias("goal_x"),
        F.when(is_goto, F.col("_gy")).alias("goal_y"),
        F.when(is_goto, F.lit(GOAL_ORIENTATION_W)).alias("goal_w"),
        F.when(is_goto, F.lit(GOAL_FRAME)).alias("frame_id"),
        F.coalesce((twist | is_goto) & values_ok, F.lit(False)).alias("accepted"),
    )
