"""Keyed state tables for streams: hash buckets, of which a batch rewrites only those it touches, and a log that points to them.

path/data/<version>-<id>/bucket=<b>/ holds rows; path/log/ holds one small file per version, with (version, bucket, folder) for the buckets of
that version. Of every bucket the folder of the greatest version counts. A version exists as soon as its log file does, which the
committer puts in place by one rename, so a crash between any two steps leaves the version before it readable; what a failed attempt
wrote is never pointed to. A batch that is repeated after its version was logged changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmament.session import cut_lineage

LOG = "version long, bucket int, folder string"


@dataclass(frozen=True)
class StateTable:
    """A table at `path` keyed by `key`. More buckets make a batch of few keys write less; fewer make fewer files."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def version(self) -> int | None:
        """The last version, or None before the first."""
        return self._log().agg(F.max("version")).first()[0]

    def folders(self, buckets: list[int] | None = None) -> dict[int, str]:
        """The current folder of every bucket (of at most `self.buckets`)."""
        log = self._log() if buckets is None else self._log().where(F.col("bucket").isin(buckets))
        return {r.bucket: r.folder for r in log.groupBy("bucket").agg(F.max_by("folder", "version").alias("folder")).collect()}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The current rows (of some buckets); None before the first version."""
        paths = sorted(f"{folder}/bucket={b}" for b, folder in self.folders(buckets).items())
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, batch: DataFrame, version: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Write version `version`: merge(old rows or None, batch rows) of the buckets that the batch touches. Returns these."""
        done = self.version()
        if done is not None and version <= done:
            return []
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most `buckets` numbers
        if not touched:
            return []
        rows = merge(self.read(touched), batch).withColumn("bucket", bucket)
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        self._point(version, {b: folder for b in touched})
        return touched

    def replace(self, rows: DataFrame) -> int:
        """Write all rows anew as the next version; readers see the old ones until the log points to the new."""
        done = self.version()
        version = 0 if done is None else done + 1
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        placed = cut_lineage(rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")))
        filled = {r[0] for r in placed.select("bucket").distinct().collect()}  # at most `buckets` numbers
        placed.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        gone = set(self.folders()) - filled
        if gone or not filled:  # buckets without rows point to an empty folder
            gone = gone or {0}
            for b in gone:
                placed.drop("bucket").limit(0).write.parquet(f"{folder}/bucket={b}")
        self._point(version, {b: folder for b in filled | gone})
        return version

    def _point(self, version: int, folders: dict[int, str]) -> None:
        log = self.spark.createDataFrame([(version, b, f) for b, f in folders.items()], LOG)
        log.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data folders that no bucket has pointed to for the last `keep` versions; returns them. Readers of older versions must be done.

        The log itself is left: it has one row a touched bucket and version.
        """
        last = self.version()
        if last is None:
            return []
        log = self._log()
        at = log.where(F.col("version") <= last - keep + 1).groupBy("bucket").agg(F.max("version").alias("version"))
        needed = log.join(at, ["bucket", "version"]).select("folder").union(log.where(F.col("version") > last - keep + 1).select("folder")).distinct()
        stale = [r.folder for r in log.select("folder").distinct().join(needed, "folder", "left_anti").collect()]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in stale:
            hadoop(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(folder), True)
        return stale
