"""Windows over points in order, at any size: a metric of any length is cut into stretches, and what reaches over a cut is carried.

A stretch is a run of consecutive rows of one key. Spark cuts the rows by range, at quantiles that it samples, and within equal times by whatever orders
them, so that no metric, day or instant is left to one task. Windows are over stretches; what they need of earlier ones (a last row, a sum, some rows) comes from a table
with a row for each stretch, which is scanned in order and joined back. Up to `rows_each` rows there is one stretch, and nothing to be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.session import staged

#: Rows of a stretch, about.
ROWS_EACH = 2_000_000


def stretched(rows: DataFrame, keys: list[str], order: list[str], rows_each: int = ROWS_EACH) -> tuple[DataFrame, bool]:
    """`rows` with `_stretch`, which ascends in the order of each key, and whether there is more than one.

    Rows that are equal in keys and order stand in any order, but in the same for all that reads the result.
    """
    n = rows.count()
    if n <= rows_each:
        return rows.withColumn("_stretch", F.lit(0)), False
    spread = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(-(-n // rows_each), *keys, *order, "_salt")
    return staged(spread.drop("_salt").withColumn("_stretch", F.spark_partition_id()), "stretches"), True


def earlier(summary: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """(keys, _stretch, name): `value`, an aggregate over the rows of `summary` (a row for each stretch) that stand before."""
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, "_stretch", value.over(before).alias(name))


def within(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "_stretch")


def deltas(points: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """(metric, seq, delta_ms, place): time since the metric's previous point, 0 for the first of a metric, and the point's number in its metric from 0."""
    key = ["metric"]
    rows, cut = stretched(points.select("metric", "seq", "ts"), key, ["ts", "seq"], rows_each)
    inside = within(key).orderBy("ts", "seq")
    last, place = F.lag("ts").over(inside), F.row_number().over(inside) - 1
    if cut:
        ends = rows.groupBy("metric", "_stretch").agg(F.max("ts").alias("_end"), F.count("*").alias("_n"))
        carried = earlier(ends, key, "_before", F.max("_end")).join(earlier(ends, key, "_ahead", F.sum("_n")), ["metric", "_stretch"])
        rows = rows.withColumns({"_last": last, "_place": place}).join(carried, ["metric", "_stretch"])
        last, place = F.coalesce("_last", "_before"), F.col("_place") + F.coalesce("_ahead", F.lit(0))
    found = rows.withColumns({"_last": last, "place": place.cast("long")})
    return found.select("metric", "seq", F.coalesce(C.millis("ts") - C.millis("_last"), F.lit(0)).alias("delta_ms"), "place")


def times_of(deltas: DataFrame, starts: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """(metric, seq, at_ms): times again from `deltas` (metric, seq, delta_ms, place) and starts (metric, start_ms): running sums in order of place."""
    key = ["metric"]
    rows, cut = stretched(deltas.select("metric", "seq", "delta_ms", "place"), key, ["place"], rows_each)
    at = F.sum("delta_ms").over(within(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    if cut:
        sums = rows.groupBy("metric", "_stretch").agg(F.sum("delta_ms").alias("_sum"))
        rows = rows.withColumn("_at", at).join(earlier(sums, key, "_before", F.sum("_sum")), ["metric", "_stretch"])
        at = F.col("_at") + F.coalesce("_before", F.lit(0))
    return rows.withColumn("_at", at).join(starts, "metric").select("metric", "seq", (F.col("start_ms") + F.col("_at")).alias("at_ms"))


def running(points: DataFrame, frame: int = 6, rows_each: int = ROWS_EACH) -> DataFrame:
    """(metric, seq, moving_avg): mean of each point and the `frame` points before it; the last points of earlier stretches, `frame` at most, are carried in."""
    key = ["metric"]
    rows, cut = stretched(points.select("metric", "seq", "ts", "value"), key, ["ts", "seq"], rows_each)
    rows = rows.withColumn("_guest", F.lit(False))
    if cut:
        back = F.row_number().over(within(key).orderBy(F.desc("ts"), F.desc("seq")))
        tails = rows.withColumn("_back", back).where(F.col("_back") <= frame).groupBy("metric", "_stretch").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("_tail"))
        few = Window.partitionBy("metric").orderBy("_stretch").rowsBetween(-frame, -1)  # each stretch has a point at least
        held = tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(few))).where(F.size("_all") > 0)
        last = F.slice("_all", F.greatest(F.size("_all") - frame + 1, F.lit(1)), F.lit(frame))
        guests = held.select("metric", "_stretch", F.explode(last).alias("_p")).select("metric", "_p.seq", "_p.ts", "_p.value", "_stretch", F.lit(True).alias("_guest"))
        rows = rows.unionByName(guests)
    mean = F.avg("value").over(within(key).orderBy(F.desc("_guest"), "ts", "seq").rowsBetween(-frame, 0))
    return rows.withColumn("moving_avg", mean).where("not _guest").select("metric", "seq", "moving_avg")


def as_of(probes: DataFrame, points: DataFrame, by: str, at: str = "ts", rows_each: int = ROWS_EACH) -> DataFrame:
    """Each probe (with columns `by` and `at`) with the value and time of the last point of its metric at or before it.

    Probes and points are put in one order; of equal times points come first, and of them the last in seq counts.
    """
    none = F.lit(None).cast("struct<ts:timestamp_ntz,value:double>")
    asked = probes.withColumns({"_probe": F.lit(1), "_seen": none, "_seq": F.lit(None).cast("long")})
    own = points.select(F.col("metric").alias(by), F.col("ts").alias(at), F.lit(0).alias("_probe"), F.struct("ts", "value").alias("_seen"), F.col("seq").alias("_seq"))
    order = [at, "_probe", "_seq"]
    both, cut = stretched(asked.unionByName(own, allowMissingColumns=True), [by], order, rows_each)
    seen = F.last("_seen", ignorenulls=True).over(within([by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if cut:
        last = both.groupBy(by, "_stretch").agg(F.max_by("_seen", F.when(F.col("_probe") == 0, F.struct(at, "_seq"))).alias("_last"))
        both = both.withColumn("_here", seen).where("_probe = 1").join(earlier(last, [by], "_before", F.last("_last", ignorenulls=True)), [by, "_stretch"])
        seen = F.coalesce("_here", "_before")
    found = both.withColumn("_found", seen).where("_probe = 1")
    return found.select(*probes.columns, F.col("_found.ts").alias("found_ts"), F.col("_found.value").alias("found_value"))
