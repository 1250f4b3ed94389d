"""Points as a stream: validated ingest, continuous buckets, first-only rows and routing to topics.

Every stream reads files as they come; `tables` writes them, once or standing. Late rows count until the
watermark has passed. Times of points have no zone and mean UTC; the watermark runs on the instant, whatever the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.validation import with_errors
from tidemark.sources.points import from_events

# Windows for each interval; weeks start on Monday, four days after the epoch's Thursday.
WINDOWS = {"hour": ("1 hour", "1 hour", "0 seconds"), "day": ("1 day", "1 day", "0 seconds"), "week": ("7 days", "7 days", "4 days")}


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Points from event files as they come; `path` is a folder or a pattern."""
    shape = spark.read.parquet(path).schema
    return from_events(spark.readStream.schema(shape).parquet(path))


def instant(ts: str = "ts") -> Column:
    """The instant of a time without zone, read as UTC."""
    return F.timestamp_micros(micros(ts))


def zone_free(at: Column) -> Column:
    """The time without zone, in UTC, of an instant; also where clocks are set forward in the session's zone."""
    days, micros = F.floor(F.unix_micros(at) / 86_400_000_000), F.pmod(F.unix_micros(at), F.lit(86_400_000_000))
    return F.date_from_unix_date(days.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))


def timed(points: DataFrame, delay: str = "1 day") -> DataFrame:
    """Points with a watermark on their instant, in the column at."""
    return points.withColumn("at", instant()).withWatermark("at", delay)


def bucketed(points: DataFrame, interval: str, delay: str = "1 day") -> DataFrame:
    """(bucket, metric, mean, n): continuous aggregation by hour, day or week, by UTC; a month needs update or complete mode."""
    rows = timed(points, delay)
    if interval == "month":
        grouped = rows.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("bucket"), "metric")
    else:
        grouped = rows.groupBy(F.window("at", *WINDOWS[interval])["start"].alias("bucket"), "metric")
    made = grouped.agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return made if interval == "month" else made.withColumn("bucket", zone_free(F.col("bucket")))


def first_only(points: DataFrame, delay: str = "1 day") -> DataFrame:
    """Points less repeats of a sequence number within the delay."""
    return timed(points, delay).dropDuplicatesWithinWatermark(["seq"]).drop("at")


def valid_topic(topic: str) -> bool:
    """metrics.<name>, category.<name>, metrics.*, category.*, insights or system."""
    head, _, rest = topic.partition(".")
    return topic in ("insights", "system") or head in ("metrics", "category") and bool(rest)


def routed(points: DataFrame, subscriptions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(subscriber, topic, ts, value, seq): each point once for each subscriber to its metric, its category or all of a kind.

    `subscriptions` (subscriber, topic) and `metrics` are tables; Spark broadcasts them where they are small enough.
    """
    categories = metrics.select(F.col("name").alias("metric"), "category")
    own = F.concat(F.lit("metrics."), F.col("metric"))
    topics = F.array(own, F.lit("metrics.*"), F.concat(F.lit("category."), F.coalesce("category", F.lit("custom"))), F.lit("category.*"))
    each = points.join(categories, "metric", "left").select("ts", "value", "seq", own.alias("published"), F.explode(topics).alias("topic"))
    found = each.join(subscriptions, "topic").groupBy("subscriber", "seq")
    return found.agg(F.first("published").alias("topic"), F.first("ts").alias("ts"), F.first("value").alias("value")).select("subscriber", "topic", "ts", "value", "seq")


def with_table(streamed: DataFrame, stored: DataFrame, key: str = "seq") -> DataFrame:
    """What a stream has written and what a table holds, as one table; a row that is in both counts once, as stored."""
    fresh = streamed.join(stored.select(key), key, "left_anti").select(stored.columns)
    return stored.unionByName(fresh)


def split_ingest(points: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their errors; works on streams and tables alike."""
    checked = with_errors(points, now_ms)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
