"""Session settings the operators rely on.

Only runtime-settable SQL options are touched here, so ``configure`` can be
applied to a session that someone else built (the driver, a notebook, a
cluster job).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Options every operator assumes.
#  - UTC session zone: the test tables hold TIMESTAMP_NTZ, watermarks need
#    TIMESTAMP, and bucket origins are defined in UTC.
#  - LAST_WIN map keys: diagnostics with a repeated name keep the last entry.
#  - AQE with skew-join splitting and partition coalescing.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Without it a cluster job
    stops here; only a local session (tests) gets a private folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="roverlake-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def get_session(master: str | None = None, app: str = "roverlake", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the benchmark; cluster jobs pass their own."""
    master = master or os.environ.get("ROVERLAKE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ROVERLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
