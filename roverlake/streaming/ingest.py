"""Continuous ingest (R1, R5): one streaming query, one ``foreachBatch``.

Each micro-batch is parsed once, persisted, and written to every sink; all
sink paths carry the batch id and are written with overwrite, so a batch
that Spark repeats after a failure rewrites the same files (exactly-once
output over several sinks without a transactional table format).

A batch's number is ``run * 2^40 + Spark's batch id``. A run belongs to one
checkpoint (the stream id in its metadata) and is noted under ``runs``; a
checkpoint that ``out`` does not know would count its batches from 0 again, over
data that is stored, so it is refused unless ``new_run`` allows the next run, whose
numbers follow all earlier ones.

Layout under ``out``::

    timeseries/event_date=<d>/batch=<id>/   time-series rows (S3), dynamic partition overwrite
    objects/batch=<id>/bucket=<b>/          object writes (S4; readers keep the last write per key)
    objects_current/slot=<0|1>/             compacted objects with the last batch folded in
    topics/batch=<id>/topic=<t>/            forwarded records (S5)
    rejects/batch=<id>/                     dead letters with reason
    status/                                 status table: deltas by bucket, and manifests (S6, W2)
    runs/                                   run number of each stream id
    counts/batch=<id>/                      processed counter per type (A2)
    <table>_segments/, <table>_manifest/    compacted time series, topics, rejects and counts
    timeseries_index/batch=<id>/            file summaries, if asked for
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roverlake.operators import envelope as env
from roverlake.operators import route as rt
from roverlake.operators import status as st
from roverlake.sources import file_index
from roverlake.sources import sinks as sk
from roverlake.sources.append_table import AppendTable
from roverlake.sources.streams import landing_arrival
from roverlake.sources.tables import spread


RUN_BATCHES = 1 << 40


def run_number(spark: SparkSession, out: str, checkpoint: str, new_run: bool = False) -> int:
    """Run of the checkpoint's stream in ``out``; noted if it is the first one, or if a
    new one is allowed."""
    stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    try:
        runs = {r["stream"]: r["run"] for r in spark.read.parquet(f"{out}/runs").collect()}  # a row for each start on a new checkpoint
    except AnalysisException:
        runs = {}
    if stream in runs:
        return runs[stream]
    if runs and not new_run:
        raise ValueError(f"{out} holds the output of another checkpoint; a new run must be asked for (new_run)")
    run = max(runs.values(), default=-1) + 1
    spark.createDataFrame([(stream, run)], "stream string, run long").write.mode("append").parquet(f"{out}/runs")
    return run


def _arrived(batch: DataFrame, batch_id: int) -> DataFrame:
    """Adds the arrival order of sources without one: the batch, then the place of the
    line in the landed files (or the row, if there is no place)."""
    if "arrival_seq" in batch.columns:
        return batch
    number = F.lit(batch_id).cast("long").alias("batch")
    if "landed" in batch.columns:
        return batch.withColumn("arrival_seq", F.struct(number, landing_arrival(F.col("landed")).alias("line"))).drop("landed")
    return batch.withColumn("arrival_seq", F.struct(number, F.monotonically_increasing_id().alias("row")))


def ingest_batch(batch: DataFrame, batch_id: int, out: str, status_order: str = "arrival",
                 brokers: str | None = None, spread_rows: bool = False, file_summary: bool = False) -> None:
    """Store one micro-batch of raw messages, or of HTTP bodies (column ``body``, with
    the robot id from the path). With ``brokers`` accepted messages are forwarded to
    Kafka topics, else to files. ``spread_rows`` deals rows of few input splits to all
    task slots before parsing (one more shuffle of the raw messages). ``file_summary`` adds the
    batch's files to the index that robot lookups read (``sources.file_index``)."""
    spark = batch.sparkSession
    batch = _arrived(batch, batch_id)
    batch = spread(batch) if spread_rows else batch
    parsed = env.http_envelope(batch).withColumnRenamed("body", "raw") if "body" in batch.columns else env.parse_envelope(batch)
    parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        acc = env.accepted(parsed)
        sk.write_timeseries(rt.timeseries_rows(acc), f"{out}/timeseries", batch_id)
        if file_summary:
            file_index.index_table(spark, f"{out}/timeseries", f"{out}/timeseries_index", batch_id)
        sk.write_objects(rt.blob_rows(acc), f"{out}/objects", batch_id)
        if brokers:
            sk.write_topics_kafka(rt.topic_rows(acc), brokers)
        else:
            sk.write_topics_files(rt.topic_rows(acc), f"{out}/topics", batch_id)
        sk.write_rejects(env.rejected(parsed).select("raw", "arrival_seq", "received_at", "reject_reason"),
                         f"{out}/rejects", batch_id)
        rt.processed_by_type(acc).write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")
        rows = st.status_rows(acc.where(F.col("data_type") == "status")
                              .withColumn("time", F.col("ts").cast("timestamp_ntz")))
        st.status_table(f"{out}/status", status_order).merge(rows, batch_id)
    finally:
        parsed.unpersist()


def start_ingest(messages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, status_order: str = "arrival",
                 new_run: bool = False, brokers: str | None = None, spread_rows: bool = False, file_summary: bool = False):
    """Start the ingest query on a raw-message or HTTP-body stream; returns the
    StreamingQuery. It fails before the first write if ``out`` belongs to another
    checkpoint and ``new_run`` is not set."""
    run: list[int] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        if not run:
            run.append(run_number(batch.sparkSession, out, checkpoint, new_run))
        ingest_batch(batch, run[0] * RUN_BATCHES + batch_id, out, status_order, brokers, spread_rows, file_summary)

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tables(out: str) -> dict[str, AppendTable]:
    """The tables that batches append to; each can be compacted, trimmed and vacuumed."""
    return {
        "timeseries": AppendTable(f"{out}/timeseries", ("event_date",), ("robot_id", "time")),
        "topics": AppendTable(f"{out}/topics", ("topic",)),
        "rejects": AppendTable(f"{out}/rejects", order=("reject_reason", "received_at")),
        "counts": AppendTable(f"{out}/counts", order=("data_type",)),
    }


def read_timeseries(spark: SparkSession, out: str) -> DataFrame:
    return tables(out)["timeseries"].read(spark)


OBJECT_COLUMNS = ("bucket", "object_name", "payload", "length", "metadata", "arrival_seq")


def _current_objects(spark: SparkSession, out: str) -> tuple[DataFrame | None, int, int]:
    """Newest compacted object table, its version (last batch folded in) and slot."""
    try:
        cur = spark.read.parquet(f"{out}/objects_current")
    except AnalysisException:
        return None, -1, -1
    version, slot = cur.agg(F.max(F.struct("version", "slot")).alias("m")).select("m.*").first()
    if version is None:
        return None, -1, -1
    return cur.where((F.col("slot") == slot) & (F.col("version") == version)).select(*OBJECT_COLUMNS), version, slot


def read_objects(spark: SparkSession, out: str) -> DataFrame:
    """Current objects: the last write per (bucket, object_name). Reads the
    compacted table plus only the batch folders written after it."""
    writes = spark.read.parquet(f"{out}/objects")
    cur, version, _ = _current_objects(spark, out)
    newer = writes.where(F.col("batch") > version).select(*OBJECT_COLUMNS)
    return rt.object_view(newer if cur is None else cur.unionByName(newer))


def compact_objects(spark: SparkSession, out: str) -> int:
    """Fold every object write so far into ``objects_current`` (S4 compaction).

    The result goes to the slot the readers are not using, tagged with the last
    batch it includes; a failed run leaves the previous slot in place. Run it
    periodically (not per batch): it rewrites every current object once.
    Returns the version written.
    """
    writes = spark.read.parquet(f"{out}/objects")
    upto = writes.agg(F.max("batch")).first()[0]
    _, version, slot = _current_objects(spark, out)
    if upto is None or upto <= version:
        return version
    view = read_objects(spark, out).withColumn("version", F.lit(upto).cast("long"))
    target = 0 if slot == 1 else 1
    view.write.mode("overwrite").parquet(f"{out}/objects_current/slot={target}")
    return int(upto)


def read_status(spark: SparkSession, out: str, order: str = "arrival", robot_id: str | None = None) -> DataFrame:
    """Status rows of the newest committed batch, or that of one robot (its bucket is
    read alone). ``order`` is that of the ingest job."""
    rows = st.status_table(f"{out}/status", order).read(spark, robot_id)
    if rows is None:
        raise ValueError(f"{out} has no status table")
    return rows


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """Cumulative processed counter per type."""
    return tables(out)["counts"].read(spark).groupBy("data_type").agg(F.sum("processed").alias("processed"))


def main(argv: list[str] | None = None) -> None:
    """Run the ingest job (R1) on a cluster::

        spark-submit --py-files roverlake.zip roverlake/streaming/ingest.py \\
            --source kafka --brokers host:9092 --out s3a://bucket/fleet

    The checkpoint goes under ``spark.checkpoint.dir`` unless ``--checkpoint``
    is given. ``--trigger`` is a processing-time interval, or ``available-now``.
    """
    import argparse

    from roverlake.session import checkpoint_dir, configure
    from roverlake.sources import streams

    p = argparse.ArgumentParser(prog="roverlake.streaming.ingest")
    p.add_argument("--source", choices=("kafka", "landing", "http-landing"), required=True)
    p.add_argument("--brokers")
    p.add_argument("--topic", default=streams.TELEMETRY_TOPIC)
    p.add_argument("--landing")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint")
    p.add_argument("--trigger", default="10 seconds")
    p.add_argument("--max-per-trigger", type=int)
    p.add_argument("--topics", choices=("kafka", "files"), default="files", help="where accepted messages are forwarded to (kafka: --brokers)")
    p.add_argument("--new-run", action="store_true", help="go on in --out with a checkpoint it does not know")
    p.add_argument("--spread", action="store_true", help="deal the rows of few input splits to all task slots")
    p.add_argument("--status-order", choices=("arrival", "event_time"), default="arrival")
    args = p.parse_args(argv)

    spark = configure(SparkSession.builder.appName("roverlake-ingest").getOrCreate())
    if args.source == "kafka":
        if not args.brokers:
            p.error("--brokers is required for --source kafka")
        messages = streams.kafka_messages(spark, args.brokers, args.topic, max_offsets_per_trigger=args.max_per_trigger)
    else:
        if not args.landing:
            p.error("--landing is required for landed sources")
        if args.source == "landing":
            messages = streams.landing_messages(spark, args.landing, max_files_per_trigger=args.max_per_trigger)
        else:
            messages = streams.http_landing(spark, args.landing, streaming=True, max_files_per_trigger=args.max_per_trigger)
    if args.topics == "kafka" and not args.brokers:
        p.error("--brokers is required for --topics kafka")
    ckpt = args.checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/roverlake-ingest"
    trigger = {"availableNow": True} if args.trigger == "available-now" else {"processingTime": args.trigger}
    brokers = args.brokers if args.topics == "kafka" else None
    start_ingest(messages, args.out, ckpt, trigger, args.status_order, args.new_run, brokers, args.spread).awaitTermination()


if __name__ == "__main__":
    main()
