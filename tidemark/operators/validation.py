"""Checks of incoming points and metric definitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import moment
from tidemark.functions.times import DAY

# Limits in bytes, and the days before and after now that a time may lie.
NAME_BYTES, KEY_BYTES, VALUE_BYTES, PAST_DAYS, FUTURE_DAYS, BATCH = 100, 50, 200, 3650, 365, 10_000
CATEGORIES = ("health", "productivity", "mood", "habit", "custom")
AGGREGATIONS = ("sum", "average", "last", "max", "min", "count")


def with_errors(points: DataFrame, now_ms: int) -> DataFrame:
    """Points with a column `errors`: the names of the rules that a row breaks, none for a good row."""
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    rules = {
        "metric_empty": F.coalesce(F.col("metric") == "", F.lit(True)),
        "metric_long": F.octet_length("metric") > NAME_BYTES,
        "value_not_finite": F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(True)),
        "time_out_of_range": ~F.col("ts").between(moment(now_ms - PAST_DAYS * DAY), moment(now_ms + FUTURE_DAYS * DAY)),
        "tag_key": F.exists(F.map_keys(tags), lambda k: ~F.octet_length(k).between(1, KEY_BYTES)),
        "tag_value": F.exists(F.map_values(tags), lambda v: F.octet_length(v) > VALUE_BYTES),
    }
    return points.withColumn("errors", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))


def accepted(points: DataFrame, now_ms: int) -> DataFrame:
    """The good rows; a row without a time is taken as of now."""
    return with_errors(points.withColumn("ts", F.coalesce("ts", moment(now_ms))), now_ms).where(F.size("errors") == 0).drop("errors")


def rejected(points: DataFrame, now_ms: int) -> DataFrame:
    """The bad rows with their errors."""
    return with_errors(points, now_ms).where(F.size("errors") > 0)


def ingest_batches(items: DataFrame, now_ms: int, batch_col: str = "batch", item_col: str = "item", limit: int = BATCH) -> DataFrame:
    """(batch, accepted, rejected, errors): what becomes of each batch; errors name the item by its index and the rules it breaks, in order of items.

    A batch of more than `limit` items is turned away as a whole, with one error. So what is listed for a batch is bounded by the limit.
    """
    checked = with_errors(items.withColumn("ts", F.coalesce("ts", moment(now_ms))), now_ms)
    sizes = items.groupBy(batch_col).agg(F.count("*").alias("n"))
    bad = F.size("errors") > 0
    told = F.when(bad, F.struct(F.col(item_col).alias("item"), F.concat(F.lit("item "), F.col(item_col).cast("string"), F.lit(": "), F.array_join("errors", ", ")).alias("text")))
    good = checked.join(sizes.where(F.col("n") <= limit), batch_col).groupBy(batch_col).agg(
        F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.transform(F.array_sort(F.collect_list(told)), lambda x: x["text"]).alias("errors")
    )
    large = sizes.where(F.col("n") > limit).select(
        batch_col, F.lit(0).cast("long").alias("accepted"), F.col("n").alias("rejected"), F.array(F.format_string(f"%d items, {limit} at most", "n")).alias("errors")
    )
    return good.unionByName(large)


def out_of_bounds(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Points outside the inclusive bounds of their metric; a bound that is not given holds nothing back."""
    bounds = metrics.select(F.col("name").alias("metric"), "min_value", "max_value")
    low, high = F.coalesce(F.col("value") < F.col("min_value"), F.lit(False)), F.coalesce(F.col("value") > F.col("max_value"), F.lit(False))
    return points.join(bounds, "metric").where(low | high).select(points.columns)


def check_metric(name: str, unit: str, category: str, aggregation: str) -> None:
    """ValueError for a metric definition that is not allowed."""
    if not re.fullmatch(r"\w{1,100}", name, re.ASCII):
        raise ValueError("a name has 1 to 100 letters, digits and underscores")
    if len(unit.encode()) > 50:
        raise ValueError("a unit has at most 50 bytes")
    if category.lower() not in CATEGORIES or aggregation.lower() not in AGGREGATIONS:
        raise ValueError(f"categories: {', '.join(CATEGORIES)}; aggregations: {', '.join(AGGREGATIONS)}")


def checked_metrics(definitions: DataFrame) -> DataFrame:
    """Metric definitions (name, unit, category, aggregation, ...) with the errors of each; those of `check_metric`, for whole tables."""
    tests = {
        "name": F.col("name").rlike(r"^[A-Za-z0-9_]{1,100}$"),
        "unit": F.octet_length("unit") <= 50,
        "category": F.lower("category").isin(*map(str.lower, CATEGORIES)),
        "aggregation": F.lower("aggregation").isin(*map(str.lower, AGGREGATIONS)),
    }
    found = F.array(*[F.when(~F.coalesce(good, F.lit(False)), name) for name, good in tests.items()])
    return definitions.withColumn("errors", F.array_compact(found))
