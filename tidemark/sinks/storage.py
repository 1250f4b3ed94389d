"""Stored points: tags as columns that scans can skip by, physical removal, compaction, and sketches of how many values there are.

A store is a folder of Parquet files by day, sorted by metric and time inside a file. Tags that are asked for often are columns of their own (`tag_<key>`) with
Bloom filters, so that an equality on one reaches the scan and row groups without the value are not read; the others stay in the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import TimeRange
from tidemark.session import remove, scratch, staged

#: Rows of a file, about.
ROWS_EACH = 5_000_000


def _writer(rows: DataFrame, tags: tuple[str, ...], mode: str, values: int):
    writer = rows.sortWithinPartitions("metric", "ts", "seq").write.mode(mode).partitionBy("day").option("partitionOverwriteMode", "dynamic")
    for key in tags:
        writer = writer.option(f"parquet.bloom.filter.enabled#tag_{key}", "true").option(f"parquet.bloom.filter.expected.ndv#tag_{key}", str(values))
    return writer


def store_points(points: DataFrame, path: str, tags: tuple[str, ...] = (), mode: str = "append", rows_each: int = ROWS_EACH, values: int = 100_000) -> None:
    """Write points (metric, ts, value, tags, seq) to a store; `tags` get columns with Bloom filters for about `values` different values."""
    days = points.withColumns({"day": F.to_date("ts"), **{f"tag_{k}": F.col("tags")[k] for k in tags}, "tags": F.map_filter("tags", lambda k, _: ~k.isin(*tags)) if tags else F.col("tags")})
    n, several = days.agg(F.count("*"), F.approx_count_distinct("day")).first()
    files = n // max(1, several) // rows_each + 1
    _writer(days.repartition("day", F.pmod(F.xxhash64("metric", "seq"), F.lit(files))), tags, mode, values).parquet(path)


def stored_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a store, with `day` and its tag columns."""
    return spark.read.parquet(path)


def tag_columns(stored: DataFrame) -> tuple[str, ...]:
    return tuple(c.removeprefix("tag_") for c in stored.columns if c.startswith("tag_"))


def stored_tag(stored: DataFrame, key: str) -> Column:
    """A tag of a store: its column if it has one, else its entry in the map."""
    return F.col(f"tag_{key}") if key in tag_columns(stored) else F.col("tags")[key]


def with_tag(stored: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Points whose tag is one of the values; for tags with a column, row groups without them are not read."""
    wanted = stored_tag(stored, key)
    return stored.where(wanted == values[0] if len(values) == 1 else wanted.isin(values))


def whole_points(stored: DataFrame) -> DataFrame:
    """(metric, ts, value, tags, seq) with all tags in the map again."""
    own = [F.create_map(F.lit(k), F.col(f"tag_{k}")) for k in tag_columns(stored)]
    every = F.map_filter(F.map_concat("tags", *own), lambda _, v: v.isNotNull()) if own else F.col("tags")
    return stored.select("metric", "ts", "value", every.alias("tags"), "seq")


def _rewrite(spark: SparkSession, path: str, kept: DataFrame, days: DataFrame, rows_each: int) -> list[str]:
    """Write `kept` over the `days` (day, n) of a store: each in files of about `rows_each` rows; days of which nothing is left are removed. Returns the days."""
    sizes = F.ceil(F.col("n") / rows_each).cast("int")
    with scratch(spark):
        fresh = staged(kept.join(days.select("day", sizes.alias("_files")), "day"), "kept")  # written before what it was read from is replaced
        touched, left = ({str(r["day"]) for r in x.select("day").distinct().collect()} for x in (days, fresh))  # a row for each day
        spread = fresh.repartition("day", F.pmod(F.xxhash64("metric", "seq"), F.col("_files"))).drop("_files")
        if left:
            _writer(spread, tag_columns(kept), "overwrite", 100_000).parquet(path)
    for day in sorted(touched - left):
        remove(spark, f"{path.rstrip('/')}/day={day}")
    return sorted(touched)


def remove_points(spark: SparkSession, path: str, gone: DataFrame, rows_each: int = ROWS_EACH) -> list[str]:
    """Remove the points of `gone` (seq, ts) from a store: only the days that hold some of them are written again. Returns those days."""
    stored = stored_points(spark, path)
    keys = gone.select("seq", F.to_date("ts").alias("day")).distinct()
    hit = stored.join(keys, ["seq", "day"], "left_semi").select("day").distinct()
    touched = stored.join(hit, "day", "left_semi")
    kept = touched.join(keys, ["seq", "day"], "left_anti").select(stored.columns)
    return _rewrite(spark, path, kept, touched.groupBy("day").agg(F.count("*").alias("n")), rows_each)


def compact(spark: SparkSession, path: str, rows_each: int = ROWS_EACH) -> list[str]:
    """Write days again that lie in more files than their rows need. Returns those days."""
    stored = stored_points(spark, path)
    days = stored.groupBy("day", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).groupBy("day").agg(F.count("*").alias("files"), F.sum("n").alias("n"))
    many = days.where(F.col("files") > F.ceil(F.col("n") / rows_each))
    return _rewrite(spark, path, stored.join(many.select("day"), "day", "left_semi").select(stored.columns), many, rows_each)


def value_sketches(points: DataFrame, accuracy: int = 12) -> DataFrame:
    """(day, metric, key, n, sketch): how many points have a tag, and a HyperLogLog sketch of its values; a row for each day, metric and key.

    The relative error of an estimate is about 0.83 / sqrt(2 ** accuracy): 1.3 % at 12, in about 4 KB.
    """
    each = points.select(F.to_date("ts").alias("day"), "metric", F.explode("tags").alias("key", "value"))
    return each.groupBy("day", "metric", "key").agg(F.count("*").alias("n"), F.hll_sketch_agg("value", accuracy).alias("sketch"))


def distinct_values(sketches: DataFrame, span: TimeRange, metrics: list[str] | None = None) -> DataFrame:
    """(key, points, distinct_values) of whole days in a range, from sketches alone: they merge over days and metrics."""
    first, last = C.moment(span.start).cast("date"), C.moment(span.end).cast("date")
    rows = sketches.where((F.col("day") >= first) & (F.col("day") < last))
    rows = rows if metrics is None else rows.where(F.col("metric").isin(metrics))
    merged = rows.groupBy("key").agg(F.sum("n").alias("points"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("key", "points", F.hll_sketch_estimate("sketch").alias("distinct_values"))
