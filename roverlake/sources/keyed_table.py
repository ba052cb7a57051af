"""A keyed latest-row table that micro-batches update in place of rewriting.

Keys are hashed to a fixed number of buckets. A batch folds its rows to one for each
key and writes only those, as a delta of the buckets it touches; a bucket with
many deltas is compacted, alone, to a base. The manifest of a version names the live
files of every bucket and is written last, as one small file: readers follow the
newest manifest, so files without one (a crash in between) do not count, and the
repeated batch writes them again. A batch that has its manifest changes nothing.

Layout under the table's path::

    data/v=<batch>/kind=<delta|base>/bucket=<b>/   rows
    manifest/v=<batch>/                            bucket, version, kind of live files
    schema/                                        no row, the columns

What reaches the driver is the manifest: at most ``buckets * (compact_after + 1)`` rows.
One writer at a time, as with any streaming query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roverlake.sources import files

DELTA, BASE = "delta", "base"


@dataclass(frozen=True)
class KeyedTable:
    """Newest row of each key: that of the greatest ``order`` (columns, compared in turn)."""

    path: str
    key: str
    columns: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64
    compact_after: int = 8

    # -- reading -------------------------------------------------------------

    def version(self, spark: SparkSession) -> int | None:
        """Newest version with a manifest."""
        for v in reversed(files.versions(spark, f"{self.path}/manifest")):
            if any(n.startswith("part-") for n in files.names(spark, f"{self.path}/manifest/v={v}")):
                return v
        return None

    def live(self, spark: SparkSession, version: int | None = None) -> dict[int, list[tuple[int, str]]]:
        """(version, kind) of the live files of each bucket."""
        version = self.version(spark) if version is None else version
        found: dict[int, list[tuple[int, str]]] = {}
        if version is not None:
            for r in spark.read.parquet(f"{self.path}/manifest/v={version}").collect():
                found.setdefault(r["bucket"], []).append((r["version"], r["kind"]))
        return found

    def _rows(self, spark: SparkSession, live: dict[int, list[tuple[int, str]]]) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/kind={kind}/bucket={b}" for b, parts in live.items() for v, kind in parts]
        return spark.read.parquet(*(sorted(paths) or [f"{self.path}/schema"])).select(*self.columns)

    def read(self, spark: SparkSession, key=None) -> DataFrame | None:
        """One row for each key, or the row of one ``key`` from its bucket alone; None
        before the first batch."""
        version = self.version(spark)
        if version is None:
            return None
        live = self.live(spark, version)
        if key is None:
            return self._folded(self._rows(spark, live))
        bucket = spark.range(1).select(self._bucket(F.lit(key))).first()[0]
        own = {b: parts for b, parts in live.items() if b == bucket}
        return self._folded(self._rows(spark, own).where(F.col(self.key) == key))

    def _folded(self, rows: DataFrame) -> DataFrame:
        own = [c for c in self.columns if c != self.key]
        newest = F.max_by(F.struct(*own), F.struct(*self.order))
        return rows.select(*self.columns).groupBy(self.key).agg(newest.alias("newest")).select(self.key, *[F.col("newest")[c].alias(c) for c in own]).select(*self.columns)

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # -- writing -------------------------------------------------------------

    def merge(self, rows: DataFrame, version: int) -> None:
        """Apply a batch. Versions grow; one that is not above the newest is a repeat."""
        spark = rows.sparkSession
        before = self.version(spark)
        if before is not None and version <= before:
            return
        live = self.live(spark, before) if before is not None else {}
        at = f"{self.path}/data/v={version}"
        rows.select(*self.columns).limit(0).write.mode("ignore").parquet(f"{self.path}/schema")
        delta = self._folded(rows).withColumn("bucket", self._bucket(F.col(self.key)))
        # rows of a bucket lie together, so a touched bucket is one file
        delta.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/kind={DELTA}")
        for b in files.versions(spark, f"{at}/kind={DELTA}", "bucket"):
            live.setdefault(b, []).append((version, DELTA))
        full = {b: parts for b, parts in live.items() if len(parts) > self.compact_after}
        if full:
            base = self._folded(self._rows(spark, full)).withColumn("bucket", self._bucket(F.col(self.key)))
            base.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/kind={BASE}")
            live |= {b: [(version, BASE)] for b in full}
        self._commit(spark, version, live)

    def _commit(self, spark: SparkSession, version: int, live: dict[int, list[tuple[int, str]]]) -> None:
        entries = [(b, v, kind) for b, parts in sorted(live.items()) for v, kind in parts]
        manifest = spark.createDataFrame(entries, "bucket int, version long, kind string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> int:
        """Remove what the newest ``keep`` versions do not use: their manifests and the
        files only they name. Returns the number of removed folders."""
        manifests = files.versions(spark, f"{self.path}/manifest")
        newest = self.version(spark)
        if newest is None:
            return 0
        kept = [v for v in manifests if v <= newest][-keep:]
        used = {(v, kind, b) for k in kept for b, parts in self.live(spark, k).items() for v, kind in parts}
        gone = [f"{self.path}/manifest/v={v}" for v in manifests if v < kept[0]]
        for v in files.versions(spark, f"{self.path}/data"):
            if v > newest:
                continue  # a batch under way
            for kind in (DELTA, BASE):
                at = f"{self.path}/data/v={v}/kind={kind}"
                gone += [f"{at}/bucket={b}" for b in files.versions(spark, at, "bucket") if (v, kind, b) not in used]
        for path in gone:
            files.remove(spark, path)
        return len(gone)
