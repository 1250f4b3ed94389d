"""Points and results in the formats that leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import TimeRange
from tidemark.session import scratch, staged


def export_rows(points: DataFrame, span: TimeRange, metrics: list[str] | str | None = None, ordered: bool = False) -> DataFrame:
    """(timestamp, metric, value, tags): milliseconds and tags as JSON with keys in order; unknown metrics select nothing.

    Metrics are a list, or names between commas. Ordered rows go by time, metric and sequence number, over all files that are written.
    """
    metrics = [m.strip() for m in metrics.split(",") if m.strip()] if isinstance(metrics, str) else metrics
    rows = points.where(C.in_range(span))
    rows = rows if metrics is None else rows.where(F.col("metric").isin(metrics))
    tags = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("tags"))))
    rows = rows.orderBy("ts", "metric", "seq") if ordered else rows
    return rows.select(C.millis("ts").alias("timestamp"), F.coalesce("metric", F.lit("unknown")).alias("metric"), "value", tags.alias("tags"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Export rows as CSV, quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    """Rows as a JSON object a line; missing cells are left out."""
    rows.write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array over all files: read one after the other in the order of their names, they are the array; each row has a line."""
    spark = rows.sparkSession
    with scratch(spark):
        lines = staged(rows.select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*rows.columns)).alias("value")), "lines")
        first = lines.agg(F.min("at")).first()[0]
        body = lines.select(F.concat(F.when(F.col("at") == F.lit(first), "").otherwise(","), "value").alias("value"), "at")
        sign = lambda x: spark.range(0, 1, 1, 1).select(F.lit(x).alias("value"))
        ordered = body.repartitionByRange("at").sortWithinPartitions("at").select("value")
        sign("[").union(ordered).union(sign("]")).write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str, mode: str = "append", rows_each: int = 5_000_000) -> None:
    """Points as Parquet by day, sorted by metric and time inside a file, so that days and row groups are skipped by later scans.

    A day has as many files as an average day has times `rows_each` points.
    """
    days = points.withColumn("day", F.to_date("ts"))
    n, several = days.agg(F.count("*"), F.approx_count_distinct("day")).first()
    files = n // max(1, several) // rows_each + 1
    days.repartition("day", F.pmod(F.xxhash64("metric", "seq"), F.lit(files))).sortWithinPartitions("metric", "ts", "seq").write.mode(mode).partitionBy("day").parquet(path)


def chart_rows(result: DataFrame) -> DataFrame:
    """(label, position, series, color, value): a wide result for a chart; missing cells are 0, colours take turns."""
    time, *names = result.columns
    # The colours of a chart's series.
    colors = ["#3b82f6", "#10b981", "#f59e0b", "#ef4444", "#8b5cf6"]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.lit(colors[i % 5]).alias("color"), F.coalesce(F.col(n), F.lit(0.0)).alias("value")) for i, n in enumerate(names)])).alias("c")
    return result.select(F.date_format(time, "MMM dd").alias("label"), F.col(time).alias("position"), cells).select("label", "position", "c.series", "c.color", "c.value")


def write_csv_numbers(result: DataFrame, path: str) -> None:
    """A wide result as CSV with two decimals."""
    time, *names = result.columns
    result.select(time, *[F.format_string("%.2f", F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in result.dtypes[1:]]).write.mode("overwrite").option("header", True).csv(path)


def json_rows(result: DataFrame) -> DataFrame:
    """(json): each row as an object; missing cells are left out."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("json"))


def text_rows(result: DataFrame) -> DataFrame:
    """Cells for a text table: one decimal, a dash where a value is missing."""
    time, *names = result.columns
    return result.select(F.date_format(time, "yyyy-MM-dd HH:mm").alias("time"), *[F.when(F.col(n).isNull(), "-").otherwise(F.format_string("%.1f", n)).alias(n) for n in names])
