"""Alert rules over request logs (error rate above 5 %, P95 latency above 500 ms), as intervals.

Each bucket of a key is one mergeable summary: counts, and a quantile sketch
(``approx_percentile``), so partial aggregates meet in the shuffle and a busy key costs
no more than others. The sketch is exact for buckets of fewer rows than its
accuracy, and within ``rows / accuracy`` ranks beyond. Neighbouring breached buckets
of a key are joined to intervals by a window over the breached buckets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roverlake.functions.time import parse_width, time_bucket

# Fixed values of the documented alert rules.
#   error rate > 0.05 ; P95 latency > 500 ms
ERROR_RATE, P95_LATENCY_MS = 0.05, 500.0
ACCURACY = 10_000


def bucket_health(requests: DataFrame, interval: str = "5 minutes", key: str = "robot_id", accuracy: int = ACCURACY) -> DataFrame:
    """(key, bucket, requests, error_rate, p95_latency): requests of ``time, latency_ms,
    is_error``. A request without latency counts for the error rate alone, one without
    ``is_error`` is no error; rows without a time are left out."""
    return requests.where("time is not null").groupBy(key, time_bucket("time", interval).alias("bucket")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.coalesce(F.col("is_error"), F.lit(False)).cast("int")).alias("error_rate"),
        F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_latency"),
    )


def breached(health: DataFrame, error_rate: float = ERROR_RATE, p95_latency: float = P95_LATENCY_MS, key: str = "robot_id") -> DataFrame:
    """(key, bucket, rule, value) of each rule a bucket breaks (strictly above)."""
    rules = F.array(
        F.when(F.col("error_rate") > error_rate, F.struct(F.lit("error_rate").alias("rule"), F.col("error_rate").alias("value"))),
        F.when(F.col("p95_latency") > p95_latency, F.struct(F.lit("p95_latency").alias("rule"), F.col("p95_latency").cast("double").alias("value"))),
    )
    return health.select(key, "bucket", F.inline(F.array_compact(rules)))


def alert_windows(requests: DataFrame, interval: str = "5 minutes", key: str = "robot_id", error_rate: float = ERROR_RATE, p95_latency: float = P95_LATENCY_MS, accuracy: int = ACCURACY) -> DataFrame:
    """(key, rule, alert_from, alert_until, buckets, worst): maximal runs of neighbouring
    buckets that break a rule. A bucket without requests ends a run."""
    seconds, unit = parse_width(interval)
    if unit != "seconds":
        raise ValueError(f"bucket width {interval!r} has no fixed length")
    width = F.make_dt_interval(secs=F.lit(seconds))
    rows = breached(bucket_health(requests, interval, key, accuracy), error_rate, p95_latency, key)
    order = Window.partitionBy(key, "rule").orderBy("bucket")
    first = F.coalesce(F.lag("bucket").over(order) + width != F.col("bucket"), F.lit(True))
    runs = rows.withColumn("first", first.cast("int")).withColumn("run", F.sum("first").over(order))
    return runs.groupBy(key, "rule", "run").agg(
        F.min("bucket").alias("alert_from"), (F.max("bucket") + width).alias("alert_until"),
        F.count(F.lit(1)).alias("buckets"), F.max("value").alias("worst"),
    ).drop("run")
