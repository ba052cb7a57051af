"""A summary of stored files by robot and time, read before a scan (S9 index, P4).

For each file of the time-series table: smallest and greatest robot and time, and which of
256 hashes its robots have. A lookup of one robot in a time range reads the summary, keeps the
files that can hold a match and scans only those. Files are ranged by robot when they are
written, so a lookup opens few of them; the hashes rule out files whose range merely spans the
robot. The summary is one row a file; what reaches the driver is the list of files to open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

HASHES = 256


def _hash(robot: Column) -> Column:
    return F.pmod(F.xxhash64(robot), F.lit(HASHES)).cast("int")


def summary(stored: DataFrame) -> DataFrame:
    """One row for each file of a table that was read from files."""
    return stored.groupBy(F.input_file_name().alias("file")).agg(
        F.min("robot_id").alias("first_robot"), F.max("robot_id").alias("last_robot"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        F.count(F.lit(1)).alias("rows"), F.collect_set(_hash(F.col("robot_id"))).alias("hashes"))


def index_table(spark: SparkSession, table: str, index: str, batch: int | None = None) -> None:
    """Summarise a table's files into ``index``: all of them, or those of one batch
    (partition ``batch``), which a repeated batch replaces."""
    try:
        stored = spark.read.parquet(table) if batch is None else spark.read.option("basePath", table).parquet(f"{table}/*/batch={batch}")
    except AnalysisException:  # the batch has no such rows
        return
    target = index if batch is None else f"{index}/batch={batch}"
    summary(stored).coalesce(1).write.mode("overwrite").parquet(target)


def files_for(spark: SparkSession, index: str, robot_id: str, start: Column, end: Column) -> list[str]:
    """Files that can hold rows of the robot in the closed time range."""
    rows = spark.read.parquet(index)
    robot = F.lit(robot_id)
    can = (
        F.lit(robot_id).between(F.col("first_robot"), F.col("last_robot"))
        & (F.col("first_time") <= end) & (F.col("last_time") >= start)
        & F.array_contains("hashes", _hash(robot))
    )
    return sorted(r["file"] for r in rows.where(can).select("file").collect())


def read_for(spark: SparkSession, table: str, index: str, robot_id: str, start: Column, end: Column) -> DataFrame:
    """The table as far as it can matter to the lookup; without an index, the whole table."""
    try:
        found = files_for(spark, index, robot_id, start, end)
    except AnalysisException:
        return spark.read.parquet(table)
    whole = spark.read.parquet(table)
    return spark.read.option("basePath", table).parquet(*found) if found else whole.limit(0)
