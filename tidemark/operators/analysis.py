"""Daily correlations, trends, summaries and cards over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import TimeRange

#: Days that two metrics must share, and the least size of a correlation that is reported.
SHARED_DAYS, LEAST_R = 7, 0.3


def daily_means(points: DataFrame, span: TimeRange | None = None) -> DataFrame:
    """(metric, day, mean, n): a row for each metric and UTC day; everything below builds on this small table."""
    rows = points if span is None else points.where(C.in_range(span))
    return rows.groupBy("metric", C.bucket("day").alias("day")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def aligned_pairs(daily: DataFrame) -> DataFrame:
    """(metric_a, metric_b, day, a, b) for the days that two metrics share, metric_a < metric_b.

    A join on the day with an order on the names: its rows are pairs of metrics for each day, not of points.
    """
    a = daily.select("day", F.col("metric").alias("metric_a"), F.col("mean").alias("a"))
    b = daily.select("day", F.col("metric").alias("metric_b"), F.col("mean").alias("b"))
    return a.join(b, "day").where("metric_a < metric_b").select("metric_a", "metric_b", "day", "a", "b")


def correlations(daily: DataFrame, least_days: int = SHARED_DAYS, least_r: float = LEAST_R, metric: str | None = None) -> DataFrame:
    """(metric_a, metric_b, coefficient, strength, direction, sample_size), the strongest first.

    Gates use the exact coefficient; it is reported to two places. Zero variance counts as no correlation.
    """
    enough = daily.groupBy("metric").agg(F.count("*").alias("days")).where(F.col("days") >= least_days).select("metric")
    pairs = aligned_pairs(daily.join(enough, "metric", "left_semi"))
    if metric is not None:
        pairs = pairs.where((F.col("metric_a") == metric) | (F.col("metric_b") == metric))
    r = pairs.groupBy("metric_a", "metric_b").agg(C.pearson("a", "b").alias("r"), F.count("*").alias("sample_size"))
    r = r.where((F.col("sample_size") >= least_days) & (F.abs("r") > least_r) & ~F.isnan("r"))
    shown = r.select(
        "metric_a", "metric_b", C.rounded(F.col("r"), 2).alias("coefficient"), C.strength(F.col("r")).alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"), "sample_size",
    )
    return shown.orderBy(F.abs("coefficient").desc(), "metric_a", "metric_b")


def trends(daily: DataFrame) -> DataFrame:
    """(metric, average, trend, days): mean of daily means, and mean of the later half of days less that of the earlier (at least 4 days; the middle day is in the later half)."""
    own = Window.partitionBy("metric")
    half = F.floor(F.count("*").over(own) / 2)
    placed = daily.select("metric", "mean", (F.row_number().over(own.orderBy("day")) > half).alias("late"))
    made = placed.groupBy("metric").agg(
        F.avg("mean").alias("average"), (F.avg(F.when(F.col("late"), F.col("mean"))) - F.avg(F.when(~F.col("late"), F.col("mean")))).alias("change"), F.count("*").alias("days")
    )
    return made.select("metric", "average", F.when(F.col("days") >= 4, F.col("change")).alias("trend"), "days")


def daily_summary(daily: DataFrame) -> DataFrame:
    """(date, content, metrics, data_points): a line of text for each day, metrics in order of their names."""
    part = F.concat(F.col("metric"), F.lit(": "), F.format_string("%.1f", C.rounded(F.col("mean"), 1)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", part.alias("text")))), lambda x: x["text"]), ", ")
    return daily.groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(listed.alias("content"), F.count("*").alias("metrics"), F.sum("n").alias("data_points"))


def metric_cards(daily: DataFrame) -> DataFrame:
    """(metric, current, average, difference, percent, arrow, low, high): latest day against the mean, with a padded axis."""
    made = daily.groupBy("metric").agg(F.max_by("mean", "day").alias("current"), F.avg("mean").alias("average"), F.min("mean").alias("least"), F.max("mean").alias("most"))
    gap, pad = F.col("current") - F.col("average"), F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) * 0.1).otherwise(1.0)
    arrow = F.when(gap > 0.1, "up").when(gap < -0.1, "down").otherwise("flat")
    percent = F.when(F.col("average") != 0, gap / F.when(F.col("average") != 0, F.col("average")).otherwise(1.0) * 100)
    return made.select("metric", "current", "average", gap.alias("difference"), percent.alias("percent"), arrow.alias("arrow"), (F.col("least") - pad).alias("low"), (F.col("most") + pad).alias("high"))


def sparklines(daily: DataFrame, n: int = 7) -> DataFrame:
    """(metric, day, height): the last n days scaled to 20 to 100 percent, rounded down; an (almost) flat line has range 1."""
    latest = Window.partitionBy("metric").orderBy(F.col("day").desc())
    last = daily.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= n)
    own = Window.partitionBy("metric")
    least, spread = F.min("mean").over(own), F.max("mean").over(own) - F.min("mean").over(own)
    scaled = (F.col("mean") - least) / F.when(spread < 0.01, 1.0).otherwise(spread)
    return last.select("metric", "day", F.floor(20 + scaled * 80).alias("height"))


def resampled(points: DataFrame, metrics: DataFrame, interval: str) -> DataFrame:
    """(metric, bucket, value): each metric by its own default aggregation; unknown metrics by their last value."""
    cells = F.struct(*[C.cell(a).alias(a) for a in ("sum", "avg", "last", "max", "min", "count")])
    grouped = points.groupBy("metric", C.bucket(interval).alias("bucket")).agg(cells.alias("cells"))
    kind = F.coalesce("aggregation", F.lit("last"))
    value: Column = F.col("cells.last")
    for name, own in (("sum", "sum"), ("average", "avg"), ("max", "max"), ("min", "min"), ("count", "count")):
        value = F.when(kind == name, F.col(f"cells.{own}")).otherwise(value)
    return grouped.join(metrics.select(F.col("name").alias("metric"), "aggregation"), "metric", "left").select("metric", "bucket", value.alias("value"))
