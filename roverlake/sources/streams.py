"""Message sources (S1, S2): Kafka topic, landing folders, parquet replay.

Every source yields the raw-message shape of ``schemas.RAW_MESSAGE``:
``raw`` (JSON text), ``arrival_seq`` and ``received_at``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Input topic "robot-telemetry", read from the latest offset.
# ---------------------------------------------------------------------------
TELEMETRY_TOPIC = "robot-telemetry"
STARTING_OFFSETS = "latest"


def kafka_messages(spark: SparkSession, brokers: str, topic: str = TELEMETRY_TOPIC,
                   starting_offsets: str = STARTING_OFFSETS, max_offsets_per_trigger: int | None = None,
                   min_partitions: int | None = None) -> DataFrame:
    """Telemetry topic as a stream (S1). Needs the Spark Kafka connector on the
    classpath. Arrival order across partitions is ``(timestamp, partition,
    offset)``, a sortable struct.

    ``minPartitions`` (default: the cluster's task slots) splits each batch's
    offset ranges into that many tasks without a shuffle, so JSON parsing
    uses the whole cluster even when the topic has few partitions.
    """
    slots = min_partitions or spark.sparkContext.defaultParallelism
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("minPartitions", str(slots))
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    df = reader.load()
    seq = kafka_arrival_seq("timestamp", "partition", "offset")
    return df.select(
        F.col("value").cast("string").alias("raw"),
        seq.alias("arrival_seq"),
        F.col("timestamp").alias("received_at"),
    )


def kafka_arrival_seq(ts: str, partition: str, offset: str):
    """Arrival order (broker time, partition, offset), as a struct: it compares field
    by field, so no partition number, offset or date can overflow into another."""
    return F.struct(F.col(ts).alias("at"), F.col(partition).cast("int").alias("partition"), F.col(offset).cast("long").alias("offset"))


def landing_messages(spark: SparkSession, path: str, streaming: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines landing folder, one message per line (stream or batch).

    A stream yields ``raw``, ``received_at`` (the file's modification time) and
    the ``landed`` place (file, block); the ingest job makes the arrival order
    from them per micro-batch, since row numbers are not available on a stream.
    The batch form carries ``(file modification time, file, block, row)``.
    """
    if streaming:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        df = reader.load(path)
        return df.select(F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("received_at"), landed())
    df = spark.read.text(path)
    return df.select(
        F.col("value").alias("raw"),
        landing_arrival().alias("arrival_seq"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def landed():
    """Where a landed line comes from: file time, file, and block of the file."""
    m = F.col("_metadata")
    return F.struct(m["file_modification_time"].alias("at"), m["file_path"].alias("file"), m["file_block_start"].alias("block")).alias("landed")


def landing_arrival(place=None):
    """Arrival order of a landed line: (file time, file, block, row). The row number
    only compares lines of one block, which one task reads in order."""
    place = landed() if place is None else place
    return F.struct(place["at"].alias("at"), place["file"].alias("file"), place["block"].alias("block"), F.monotonically_increasing_id().alias("row"))


def http_landing(spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Gateway POST bodies landed as ``<path>/<robot_id>/<file>.jsonl`` (S2):
    the robot id comes from the folder name, as it came from the URL. The
    batch form carries ``arrival_seq``; a stream gets it in ``foreachBatch``."""
    reader = (spark.readStream if streaming else spark.read).format("text").option("recursiveFileLookup", "true")
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(path)
    cols = [
        F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("robot_id"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    ]
    cols.append(landed() if streaming else landing_arrival().alias("arrival_seq"))
    return df.select(*cols)


def parquet_replay(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Replay a parquet table (file or folder) as a stream; a trailing ``*``
    turns a single file into a glob the file source accepts."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    target = path if not path.endswith(".parquet") else path + "*"
    return reader.parquet(target)
