"""Session construction for local work and helpers for shared folders."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.local.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tidemark.local.checkpoint.dir", folder)
    return folder


#: Spark's setting for removing a query's shuffle files when it ends; else they stay on executors' disks until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables staged so far, by open `scratch`, innermost last; each thread (and each task of asyncio) has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("tidemark_scopes", default=())
#: Tables staged outside of any `scratch`: a lazy result may read them as long as this process runs.
_open: list[str] = []


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` to a table in the shared folder and read it again: cuts lineage, survives lost executors.

    Inside `scratch` it is removed at its end; one that is to be kept, at the end of the scratch around it. Outside of any it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    (scopes[-1 - keep] if len(scopes) > keep else _open).append(path)
    with _cleaned(spark):  # nothing reads the shuffles of a written table again
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes tables staged inside, by this thread, when it ends: what leaves must be a kept table, or read none of the others."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def at_end(path: str) -> None:
    """Have a folder removed when the driver ends, or by `release`."""
    _open.append(path)


def release(spark: SparkSession) -> None:
    """Remove the tables staged outside of any `scratch`; lazy results that read them can no longer be used."""
    while _open:
        remove(spark, _open.pop())


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with suppress(Exception):  # the session may be stopped already
            release(spark)
