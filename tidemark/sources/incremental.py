"""Syncs that go on where the last one stopped: what a source has new, and how far it was read, are written in one commit.

Each sync reads the source's raw events after the mark of the syncs before, turns them into points and writes a batch: its points, its mark
(the latest time read) and the hashes of the lines at that very time, in one job. A batch counts once its success mark is there; a sync that dies leaves
nothing, and the next one reads the same events again. Events at the time of the mark that were not there before are read by the next sync, those that were are known by their hashes.

A source whose points are sums of events (`additive`) has each event once in one batch, and a day that two syncs split adds up. Of other sources
(a record for a day that may be corrected) the mark's time is read again, and the newest batch of a point counts.

Limits: events that come with a time before the mark are not seen. One sync of a table at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch, staged
from tidemark.sources.imports import SOURCES, source

BATCH = "source string, metric string, ts timestamp_ntz, value double, hash long, kind string, batch long"


@dataclass(frozen=True)
class SyncTable:
    """Batches of points and marks under `base`."""

    spark: SparkSession
    base: str

    def batches(self) -> list[int]:
        """The numbers of the syncs that are whole, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path(self.base)):
            return []
        found = [x.getPath() for x in files.listStatus(path(self.base)) if x.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().removeprefix("batch=")) for p in found if files.exists(path(p, "_SUCCESS")))

    def _rows(self, kind: str) -> DataFrame:
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], BATCH)
        return self.spark.read.schema(BATCH).option("basePath", self.base).parquet(*[f"{self.base}/batch={n}" for n in numbers]).where(F.col("kind") == kind)

    def mark(self, name: str):
        """The time up to which a source was read, or None."""
        return self._rows("mark").where(F.col("source") == name).agg(F.max("ts")).first()[0]

    def sync(self, name: str, events: DataFrame) -> int:
        """Take what is new of a source's raw `events` (at, line, as `tidemark_raw` gives them); the number of events."""
        own, mark = source(name), self.mark(name)
        timed = events.where("at is not null").select("at", "line", F.xxhash64("line").alias("hash"))
        if mark is not None:
            timed = timed.where(F.col("at") >= F.lit(mark).cast("timestamp_ntz"))  # reaches the reader
            if own.additive:
                known = self._rows("edge").where((F.col("source") == name) & (F.col("ts") == F.lit(mark).cast("timestamp_ntz")))
                timed = timed.join(known.select("hash", F.col("ts").alias("at")).distinct(), ["hash", "at"], "left_anti")
        with scratch(self.spark):
            fresh = staged(timed, "fresh")  # a source that grows is read once
            found = fresh.agg(F.count("*").alias("n"), F.max("at").alias("latest")).first()
            if not found["n"]:
                return 0
            latest = F.lit(found["latest"]).cast("timestamp_ntz")
            none = {"metric": F.lit(None).cast("string"), "value": F.lit(None).cast("double"), "hash": F.lit(None).cast("long")}
            points = own.points(fresh, None).select("metric", "ts", "value", none["hash"].alias("hash"), F.lit("point").alias("kind"))
            edge = fresh.where(F.col("at") == latest).select(none["metric"].alias("metric"), F.col("at").alias("ts"), none["value"].alias("value"), "hash", F.lit("edge").alias("kind"))
            mark_row = self.spark.range(1).select(none["metric"].alias("metric"), latest.alias("ts"), none["value"].alias("value"), none["hash"].alias("hash"), F.lit("mark").alias("kind"))
            number = (self.batches() or [0])[-1] + 1
            rows = points.unionByName(edge).unionByName(mark_row).withColumn("source", F.lit(name))
            rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.base}/batch={number}")
        return found["n"]

    def points(self) -> DataFrame:
        """(source, metric, ts, value): sums over all syncs, or the newest value of sources that are not additive."""
        rows = self._rows("point")
        sums = [n for n, s in SOURCES.items() if s.additive]
        added = rows.where(F.col("source").isin(sums)).groupBy("source", "metric", "ts").agg(F.sum("value").alias("value"))
        newest = Window.partitionBy("source", "metric", "ts").orderBy(F.desc("batch"))
        last = rows.where(~F.col("source").isin(sums)).withColumn("_age", F.row_number().over(newest)).where("_age = 1")
        return added.unionByName(last.select("source", "metric", "ts", "value"))
