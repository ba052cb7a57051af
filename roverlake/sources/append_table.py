"""Compaction and retention of tables that micro-batches append to.

A batch adds its own small files (partition ``batch``, overwritten by a repeat). ``compact``
folds finished batches into a segment of well-filled, sorted files and writes a manifest, last
and as one small file: the segments that count, the last batch they hold, and the oldest date
kept. Readers follow the newest manifest and add the batches after it, so they see the same rows
before, during and after; one that holds an older version goes on reading its files until
``vacuum`` removes what the newest versions do not use. One compaction at a time.

Layout beside the table's folder::

    <path>/…batch=<id>/…      what batches write
    <path>_segments/v=<n>/    compacted rows, by the table's partition columns
    <path>_manifest/v=<n>/    segment, upto, since
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from roverlake.sources import files


@dataclass(frozen=True)
class Live:
    """What a manifest names."""

    segments: tuple[int, ...] = ()
    upto: int = -1
    since: dt.date | None = None


@dataclass(frozen=True)
class AppendTable:
    path: str
    partitions: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    max_segments: int = 8

    # -- reading -------------------------------------------------------------

    def version(self, spark: SparkSession) -> int | None:
        for v in reversed(files.versions(spark, f"{self.path}_manifest")):
            if any(n.startswith("part-") for n in files.names(spark, f"{self.path}_manifest/v={v}")):
                return v
        return None

    def live(self, spark: SparkSession, version: int | None = None) -> Live:
        version = self.version(spark) if version is None else version
        if version is None:
            return Live()
        rows = spark.read.parquet(f"{self.path}_manifest/v={version}").collect()  # a row for each segment
        return Live(tuple(sorted(r["segment"] for r in rows if r["segment"] is not None)), rows[0]["upto"], rows[0]["since"])

    def _batches(self, spark: SparkSession, after: int, upto: int | None = None) -> DataFrame | None:
        try:
            rows = spark.read.parquet(self.path)
        except AnalysisException:  # no batch has written a row, or all are folded and removed
            return None
        rows = rows.where(F.col("batch") > after)
        return (rows if upto is None else rows.where(F.col("batch") <= upto)).drop("batch")

    def _segments(self, spark: SparkSession, segments: tuple[int, ...]) -> list[DataFrame]:
        return [spark.read.parquet(f"{self.path}_segments/v={v}") for v in segments]

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All rows (of a version: those it held, and the batches after it)."""
        live = self.live(spark, version)
        parts = self._segments(spark, live.segments)
        tail = self._batches(spark, live.upto)
        if tail is not None:
            parts.append(tail)
        if not parts:
            raise ValueError(f"{self.path} has no rows")
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        return rows if live.since is None else rows.where(F.col("event_date") >= F.lit(live.since))

    # -- maintenance ---------------------------------------------------------

    def compact(self, spark: SparkSession, idle: bool = False) -> int | None:
        """Fold the finished batches since the last compaction into a segment; with many
        segments, all of them into one. The newest batch may still be written or repeated and
        is left, unless the job is ``idle``. Returns the newest version."""
        version, live = self.version(spark), self.live(spark)
        try:
            found = spark.read.parquet(self.path).select("batch").distinct().orderBy(F.desc("batch")).limit(2).collect()
        except AnalysisException:
            found = []
        upto = next((r["batch"] for r in found[0 if idle else 1:]), None)
        if upto is None or upto <= live.upto:
            return version
        new = (version or 0) + 1
        parts, kept = [self._batches(spark, live.upto, upto)], live.segments
        if len(kept) >= self.max_segments:
            parts, kept = [*self._segments(spark, kept), *parts], ()
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if live.since is not None:
            rows = rows.where(F.col("event_date") >= F.lit(live.since))
        keys = [*self.partitions, *self.order] or rows.columns[:1]
        # ranges are joined to the advised partition size at run time, so files are well filled
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows.write.mode("overwrite").partitionBy(*self.partitions).parquet(f"{self.path}_segments/v={new}")
        self._commit(spark, new, Live((*kept, new), upto, live.since))
        return new

    def retain(self, spark: SparkSession, since: dt.date) -> int:
        """From now on rows before ``since`` (``event_date``) are gone for readers; whole
        segments and batches of older dates are removed by ``vacuum``."""
        if "event_date" not in self.partitions:
            raise ValueError(f"{self.path} has no dates")
        live, new = self.live(spark), (self.version(spark) or 0) + 1
        self._commit(spark, new, Live(live.segments, live.upto, max(since, live.since or since)))
        return new

    def _commit(self, spark: SparkSession, version: int, live: Live) -> None:
        rows = [(s, live.upto, live.since) for s in live.segments or (None,)]
        manifest = spark.createDataFrame(rows, "segment long, upto long, since date")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}_manifest/v={version}")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Remove what the newest ``keep`` versions do not use. Returns the folders removed."""
        newest = self.version(spark)
        if newest is None:
            return 0
        manifests = [v for v in files.versions(spark, f"{self.path}_manifest") if v <= newest]
        kept = [self.live(spark, v) for v in manifests[-keep:]]
        used, folded = {s for live in kept for s in live.segments}, min(live.upto for live in kept)
        gone = [f"{self.path}_manifest/v={v}" for v in manifests[:-keep]]
        gone += [f"{self.path}_segments/v={v}" for v in files.versions(spark, f"{self.path}_segments") if v <= newest and v not in used]
        dated = [n for n in files.names(spark, self.path) if n.startswith("event_date=")]
        for folder in [f"{self.path}/{n}" for n in dated] or [self.path]:
            gone += [f"{folder}/batch={b}" for b in files.versions(spark, folder, "batch") if b <= folded]
        since = None if any(live.since is None for live in kept) else min(live.since for live in kept)
        if since is not None:
            for at in [self.path, *[f"{self.path}_segments/v={v}" for v in used]]:
                gone += [f"{at}/{n}" for n in files.names(spark, at) if n.startswith("event_date=") and n[len("event_date="):] < since.isoformat()]
        for path in gone:
            files.remove(spark, path)
        return len(gone)
