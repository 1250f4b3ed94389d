"""Lookups by metric, category, tag and nearest time, and statistics of what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import TimeRange


def of_category(points: DataFrame, metrics: DataFrame, category: str) -> DataFrame:
    """Points whose metric is of the category; points of unknown metrics are of none."""
    return points.join(metrics.where(F.col("category") == category).select(F.col("name").alias("metric")), "metric", "left_semi")


def metric_rows(metrics: DataFrame, name: str | None = None, number: int | None = None, category: str | None = None) -> DataFrame:
    """(id, name, unit, category, aggregation, description, min_value, max_value) of the metrics asked for, all by default; kinds in lower case."""
    rows = metrics
    for column, wanted in (("name", name), ("id", number), ("category", category)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    return rows.select("id", "name", "unit", F.lower("category").alias("category"), F.lower("aggregation").alias("aggregation"), "description", "min_value", "max_value").orderBy("id")


def any_tag(points: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Points whose tag is one of the values."""
    return points.where(F.col("tags")[key].isin(values))


def all_tags(points: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Points that have all the tags."""
    return points.where(reduce(lambda a, b: a & b, [C.tag_is(k, "=", v) for k, v in tags.items()]))


def without(points: DataFrame, gone: DataFrame, key: str = "seq") -> DataFrame:
    """Points less those whose key is in `gone`."""
    return points.join(gone.select(key), key, "left_anti").select(points.columns)


def floor_points(points: DataFrame, at_ms: int) -> DataFrame:
    """For each metric its last point at or before the time; one aggregate, no sort."""
    return _nearest(points.where(F.col("ts") <= C.moment(at_ms)), F.max_by)


def ceiling_points(points: DataFrame, at_ms: int) -> DataFrame:
    """For each metric its first point at or after the time."""
    return _nearest(points.where(F.col("ts") >= C.moment(at_ms)), F.min_by)


def _nearest(points: DataFrame, pick) -> DataFrame:
    row, order = F.struct("ts", "value", "seq"), F.struct("ts", "seq")
    return points.groupBy("metric").agg(pick(row, order).alias("p")).select("metric", "p.ts", "p.value", "p.seq")


def tag_keys(points: DataFrame) -> DataFrame:
    """(key, points, distinct_values) of all tags."""
    each = points.select(F.explode("tags").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.sum("n").alias("points"), F.count("*").alias("distinct_values"))


def tag_values(points: DataFrame, key: str) -> DataFrame:
    """(value, n) of one tag."""
    return points.select(F.col("tags")[key].alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def metric_stats(points: DataFrame) -> DataFrame:
    """(metric, n, first_ts, last_ts, least, most, mean) of each metric."""
    return points.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean")
    )


def storage_stats(rows: DataFrame, by: str) -> DataFrame:
    """(metric, files, n) from rows read from files: the number of files that hold each metric, and of its points; `by` is the column of the metric."""
    each = rows.groupBy(F.col(by).alias("metric"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return each.groupBy("metric").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


def storage_size(rows: DataFrame) -> DataFrame:
    """(files, bytes, n) of rows read from files."""
    each = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("bytes"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def time_bounds(points: DataFrame) -> DataFrame:
    """(first_ts, last_ts, n, metrics) of all points."""
    return points.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.count_distinct("metric").alias("metrics"))


def overlapping(ranges: DataFrame, span: TimeRange) -> DataFrame:
    """Rows of (first_ts, last_ts, ...) that overlap the range."""
    return ranges.where((F.col("first_ts") < C.moment(span.end)) & (F.col("last_ts") >= C.moment(span.start)))
