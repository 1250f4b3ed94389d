"""Tables that streams write: standing or run once, in append, update and complete mode, started again where they stopped.

Each micro-batch is written whole to a folder of its own number, which counts once its success mark is there; a batch that is run again after
a crash writes over its first try. So a row is in the table once, whenever the stream was stopped or killed. Reading picks the folders by mode: all of them
(append), the newest row of each key (update), the newest folder alone (complete; older ones are removed as newer ones are done).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import at_end, remove, shared_folder

Batch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class StreamTable:
    """What a stream writes under `base`. `batch` turns each micro-batch before it is written, `keys` are those of a row in update mode."""

    spark: SparkSession
    base: str
    schema: T.StructType
    mode: str = "append"
    keys: tuple[str, ...] = ()
    batch: Batch | None = None

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Run the stream into the table: with a trigger `every` so often until it is stopped, else over what is there now. It goes on where the last run stopped."""

        def write(rows: DataFrame, number: int) -> None:
            (self.batch(rows) if self.batch else rows).write.mode("overwrite").parquet(f"{self.base}/out/batch={number}")
            if self.mode == "complete":
                for old in self.batches():
                    if old < number:
                        remove(self.spark, f"{self.base}/out/batch={old}")

        writer = stream.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.base}/progress").foreachBatch(write)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def batches(self) -> list[int]:
        """The numbers of the batches that are whole, ascending."""
        out = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/out")
        files = out.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(out):
            return []
        found = [x.getPath() for x in files.listStatus(out) if x.isDirectory() and x.getPath().getName().startswith("batch=")]
        whole = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in whole)

    def rows(self) -> DataFrame:
        """What the stream has written so far; an empty table before its first batch."""
        numbers = self.batches()[-1:] if self.mode == "complete" else self.batches()
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{self.base}/out")
        rows = read.parquet(*[f"{self.base}/out/batch={n}" for n in numbers])
        if self.mode == "update":
            newest = Window.partitionBy(*self.keys).orderBy(F.desc("batch"))
            rows = rows.withColumn("_age", F.row_number().over(newest)).where("_age = 1").drop("_age")
        return rows.drop("batch")

    def compact(self) -> None:
        """In append mode: write all whole batches as the last of them and remove the others. Only while the stream does not run."""
        numbers = self.batches()
        if self.mode != "append" or len(numbers) < 2:
            return
        last = f"{self.base}/out/batch={numbers[-1]}"
        self.rows().write.mode("overwrite").parquet(f"{self.base}/compacted")
        self.spark.read.schema(self.schema).parquet(f"{self.base}/compacted").write.mode("overwrite").parquet(last)
        for n in numbers[:-1]:
            remove(self.spark, f"{self.base}/out/batch={n}")
        remove(self.spark, f"{self.base}/compacted")


def stream_table(stream: DataFrame, mode: str = "append", batch: Batch | None = None, name: str | None = None, keys: tuple[str, ...] = ()) -> StreamTable:
    """The table of a stream; with a name it stays in the shared folder, without one it is removed when the driver ends."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/tidemark-stream-{name or uuid.uuid4().hex}"
    if not name:
        at_end(base)
    shape = batch(spark.createDataFrame([], stream.schema)) if batch else stream
    return StreamTable(spark, base, shape.schema, mode, keys, batch)


def stop(query: StreamingQuery, patience: float = 60.0) -> None:
    """Stop a standing stream between two batches, or after `patience` seconds within one (which is then run again by the next start)."""
    until = time.monotonic() + patience
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()


def run_to_table(stream: DataFrame, mode: str = "append", batch: Batch | None = None, name: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that is there and return what its table holds then."""
    table = stream_table(stream, mode, batch, name, keys)
    table.start(stream).awaitTermination()
    return table.rows()
