"""Points from the given tables: (metric STRING, ts TIMESTAMP_NTZ in UTC, value DOUBLE, tags MAP, seq LONG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import table

SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)

METRIC_SCHEMA = "id long, name string, unit string, category string, aggregation string, description string, min_value double, max_value double"

# The dimension rows for the kinds of events.
EVENT_METRICS = [
    (0, "click", "clicks", "productivity", "sum", "Clicks", 0.0, 1000.0),
    (1, "error", "errors", "health", "sum", "Errors", 0.0, 100.0),
    (2, "purchase", "units", "custom", "sum", "Purchases", 0.0, None),
    (3, "signup", "users", "custom", "count", "Sign-ups", 0.0, None),
    (4, "view", "views", "productivity", "average", "Views", 0.0, 1000.0),
]


def from_events(events: DataFrame) -> DataFrame:
    """Event kinds as metrics; the JSON properties and the user become tags."""
    tags = F.map_concat(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    return events.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", tags.alias("tags"), F.col("event_id").alias("seq"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as a metric for each priority, tagged with status and customer."""
    tags = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("customer"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_")).alias("metric"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("value"), tags.alias("tags"), F.col("o_orderkey").alias("seq"),
    )


def metric_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The dimension table of metrics: a handful of rows."""
    return spark.createDataFrame(EVENT_METRICS if rows is None else rows, METRIC_SCHEMA)


def register(metrics: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics with those of `new` whose name is not known yet; the first definition of a name stays."""
    fresh = new.join(metrics, "name", "left_anti").dropDuplicates(["name"])
    return metrics.unionByName(fresh)
