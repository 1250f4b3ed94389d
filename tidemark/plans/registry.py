"""Registered queries over the given tables and their SQL twins."""

from __future__ import annotations

import base64
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import DAY, INTERVALS, TimeRange, to_ms
from tidemark.operators import analysis, insights, lookups, ordered, validation
from tidemark.plans.query import Item, Query, daily_average, series
from tidemark.sinks import export, storage
from tidemark.sources import imports, incremental, points, raw
from tidemark.session import at_end, shared_folder, staged, table
from tidemark.streaming import streams, subscriptions, tables

#: The moment that the registered queries take as now: the end of the events.
NOW = to_ms(datetime(2024, 1, 31))
MIDDLE = to_ms(datetime(2024, 1, 15, 12))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL twins share these: the events as points, and their daily means.
P = "WITH p AS (SELECT event_type AS metric, ts, value, event_id AS seq, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS u FROM events)"
D = P + ", d AS (SELECT metric, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS mean, count(*) AS n FROM p GROUP BY ALL)"


def add(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL twin where there is one."""

    def put(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return put


def on_points(query: Query, metrics: list[str] | None = None, places: int = 6, whole: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query object as a registered query; numbers are rounded so that the order of sums does not show. `whole` values are rounded down first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = points.event_points(spark, sf_dir)
        out = query.run(own.withColumn("value", F.floor("value").cast("double")) if whole else own, NOW, metrics or KINDS)
        return out.select(*[C.rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run


def near(x: str, places: int = 6) -> str:
    """SQL for the same rounding."""
    return f"(sign({x}) * floor(abs({x}) * 1e{places} + 0.5) / 1e{places})"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes with the driver."""
    path = f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    at_end(path)
    return path


KINDS = [r[1] for r in points.EVENT_METRICS]
JANUARY = TimeRange.month(2024, 1)
WEEK = TimeRange(to_ms(datetime(2024, 1, 5)), to_ms(datetime(2024, 1, 12)))
IN_JANUARY = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"
IN_WEEK = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"
TWO = "metric IN ('click', 'view')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["click_and_view_by_day"](spark, sf_dir)


def cell_sql(name: str, metric: str) -> str:
    where = f"FILTER (WHERE metric = '{metric}')"
    if name == "count":
        return f"CAST(nullif(count(value) {where}, 0) AS DOUBLE)"
    if name in ("first", "last"):
        return f"arg_{'min' if name == 'first' else 'max'}(value, row(ts, seq)) {where}"
    return f"{name}(value) {where}"


add(
    "click_and_view_by_day",
    f"{P} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, {near(cell_sql('avg', 'click'))} AS click_avg, {near(cell_sql('sum', 'view'))} AS view_sum FROM p WHERE {IN_JANUARY} AND {TWO} GROUP BY 1",
)(on_points(Query.select(Item("click", "avg", "click_avg"), Item("view", "sum", "view_sum")).time_range(JANUARY).group_by("day")))

for _interval in INTERVALS:
    for _name in C.AGGREGATES:
        add(
            f"{_name}_by_{_interval}",
            f"{P} SELECT date_trunc('{_interval}', ts)::TIMESTAMP AS bucket, {near(cell_sql(_name, 'click'))} AS click, {near(cell_sql(_name, 'view'))} AS view FROM p WHERE {IN_JANUARY} AND {TWO} GROUP BY 1",
        )(on_points(Query.select("click", "view").time_range(JANUARY).group_by(_interval).aggregate(_name)))

_ROWS = f"{P} SELECT ts, {{cells}} FROM p WHERE {{where}} GROUP BY ts"
_CLICK = "arg_min(value, seq) FILTER (WHERE metric = 'click') AS click"
_VIEW = "arg_min(value, seq) FILTER (WHERE metric = 'view') AS view"


def rows_sql(where: str, cells: str = _CLICK) -> str:
    return _ROWS.format(cells=cells, where=where)


add("scan_metric", rows_sql(f"{IN_WEEK} AND metric = 'click'"))(on_points(Query.select("click").time_range(WEEK)))
add("select_multi", rows_sql(f"{IN_WEEK} AND {TWO}", f"{_CLICK}, {_VIEW}"))(on_points(Query.select("click", "view").time_range(WEEK)))
add("limit_oldest", rows_sql(f"{IN_JANUARY} AND metric = 'click'") + " ORDER BY ts LIMIT 100")(on_points(Query.select("click").time_range(JANUARY).limit(100)))
add("limit_zero", rows_sql(f"{IN_JANUARY} AND metric = 'click'") + " LIMIT 0")(on_points(Query.select("click").time_range(JANUARY).limit(0)))
add("default_7d", rows_sql("ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' AND metric = 'click'"))(on_points(Query.select("click")))
add("last_hours", rows_sql("ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-31' AND metric = 'click'"))(on_points(Query.select("click").last_hours(48)))
add("global_aggregate", f"{P} SELECT {near('avg(value)')} AS click FROM p WHERE {IN_JANUARY} AND metric = 'click'")(on_points(Query.select("click").time_range(JANUARY).aggregate("avg")))
add("group_default_last", f"{P} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, {near(cell_sql('last', 'error'))} AS error FROM p WHERE {IN_JANUARY} AND metric = 'error' GROUP BY 1")(
    on_points(Query.select("error").time_range(JANUARY).group_by("day"))
)
add(
    "group_multi_metric_missing",
    f"{P} SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, " + ", ".join(f"{cell_sql('count', m)} AS {m}" for m in KINDS) + f" FROM p WHERE {IN_JANUARY} GROUP BY 1",
)(on_points(Query.select(*KINDS).time_range(JANUARY).group_by("hour").aggregate("count")))
add(
    "select_star_wide",
    f"{P} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, " + ", ".join(f"{near(cell_sql('max', m))} AS {m}" for m in KINDS) + f" FROM p WHERE {IN_JANUARY} GROUP BY 1",
)(on_points(Query.select("*").time_range(JANUARY).group_by("day").aggregate("max"), KINDS))
add(
    "request_weekly",
    f"{P} SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, {near(cell_sql('avg', 'click'))} AS click FROM p WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-31' AND metric = 'click' AND k <> '5' GROUP BY 1",
)(
    on_points(
        Query.from_request(
            {"select": ["click"], "time_range": {"start": "now-4w", "end": "now"}, "group_by": "w", "aggregation": "average", "filters": [{"tag": "k", "op": "!=", "value": 5}]}, NOW
        )
    )
)
for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _whole = rows_sql(f"{IN_JANUARY} AND metric = 'click' AND floor(value) {_sign} 50.0", _CLICK.replace("arg_min(value", "arg_min(floor(value)"))
    add(f"value_{_op}", _whole)(on_points(Query.select("click").time_range(JANUARY).where_value(_op, 50.0), whole=True))
    add(f"tag_{_op}", rows_sql(f"{IN_JANUARY} AND metric = 'click' AND k {_sign} '50'"))(on_points(Query.select("click").time_range(JANUARY).where_tag("k", _op, "50")))
add("tag_ne_missing", rows_sql(f"{IN_JANUARY} AND metric = 'click'"))(on_points(Query.select("click").time_range(JANUARY).where_tag("absent", "!=", "x")))
add("tag_eq_missing", rows_sql(f"{IN_JANUARY} AND metric = 'click' AND false"))(on_points(Query.select("click").time_range(JANUARY).where_tag("absent", "=", "x")))
add("tag_and_value", rows_sql(f"{IN_JANUARY} AND metric = 'click' AND k = '7' AND value >= 10"))(
    on_points(Query.select("click").time_range(JANUARY).where_tag("k", "=", "7").where_value(">=", 10))
)


@add("scan_range", f"{P} SELECT metric, ts, value, seq FROM p WHERE {IN_WEEK}")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.event_points(spark, sf_dir).where(C.in_range(WEEK)).select("metric", "ts", "value", "seq")


@add("to_series", f"{P} SELECT ts AS time, value FROM (SELECT ts, arg_min(value, seq) FILTER (WHERE metric = 'click') AS value FROM p WHERE {IN_WEEK} AND {TWO} GROUP BY ts) WHERE value IS NOT NULL")
def to_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(Query.select("click", "view").time_range(WEEK).run(points.event_points(spark, sf_dir), NOW, KINDS))


@add("daily_average_series", f"{P} SELECT date_trunc('day', ts)::TIMESTAMP AS time, {near('avg(value)')} AS value FROM p WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31' AND metric = 'signup' GROUP BY 1")
def daily_average_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series(daily_average("signup", 14).run(points.event_points(spark, sf_dir), NOW, KINDS))
    return found.select("time", C.rounded(F.col("value"), 6).alias("value"))


@add("category_filter", f"{P} SELECT metric, count(*) AS n, {near('sum(value)')} AS total FROM p WHERE metric IN ('click', 'view') GROUP BY metric")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.of_category(points.event_points(spark, sf_dir), points.metric_table(spark), "productivity")
    return found.groupBy("metric").agg(F.count("*").alias("n"), C.rounded(F.sum("value"), 6).alias("total"))


@add("export_points", f"""{P} SELECT epoch_us(ts) // 1000 AS timestamp, metric, value, '{{"k":"' || k || '","user":"' || u || '"}}' AS tags FROM p WHERE {IN_WEEK} AND metric IN ('click', 'error')""")
def export_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_rows(points.event_points(spark, sf_dir), WEEK, ["click", "error", "unknown"])


@add(
    "chart_series",
    f"{P}, c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS position, {cell_sql('avg', 'click')} AS click, {cell_sql('avg', 'absent')} AS absent FROM p WHERE {IN_JANUARY} GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT strftime(position, '%b %d') AS label, position, '{s}' AS series, '{c}' AS color, {near(f'coalesce({s}, 0.0)')} AS value FROM c" for s, c in (("click", "#3b82f6"), ("absent", "#10b981"))),
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points.event_points(spark, sf_dir)
    wide = Query.select("click", "absent").time_range(JANUARY).group_by("day").aggregate("avg").run(own, NOW, [*KINDS, "absent"])
    days = own.where(C.in_range(JANUARY)).select(C.bucket("day").alias("bucket")).distinct()  # days on which other metrics alone have points are on the axis too
    return export.chart_rows(days.join(wide, "bucket", "left")).withColumn("value", C.rounded(F.col("value"), 6))


@add("tags_any", f"{P} SELECT metric, ts, value, seq FROM p WHERE k IN ('3', '5', '8')")
def tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.any_tag(points.event_points(spark, sf_dir), "k", ["3", "5", "8"]).select("metric", "ts", "value", "seq")


@add("tags_all", f"{P} SELECT metric, ts, value, seq FROM p WHERE k = '3' AND u = '5'")
def tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.all_tags(points.event_points(spark, sf_dir), {"k": "3", "user": "5"}).select("metric", "ts", "value", "seq")


@add("tags_intersect", f"{P} SELECT seq FROM p WHERE k = '3' INTERSECT SELECT seq FROM p WHERE metric = 'view'")
def tags_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points.event_points(spark, sf_dir)
    return lookups.all_tags(own, {"k": "3"}).select("seq").intersect(own.where("metric = 'view'").select("seq"))


@add("remove_tagged", f"{P} SELECT metric, ts, value, seq FROM p WHERE k NOT IN ('1', '2')")
def remove_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points.event_points(spark, sf_dir)
    return lookups.without(own, lookups.any_tag(own, "k", ["1", "2"])).select("metric", "ts", "value", "seq")


@add("floor_lookup", f"{P} SELECT metric, max(ts) AS ts, arg_max(value, row(ts, seq)) AS value, arg_max(seq, row(ts, seq)) AS seq FROM p WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY metric")
def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.floor_points(points.event_points(spark, sf_dir), to_ms(datetime(2024, 1, 15, 12)))


@add("ceiling_lookup", f"{P} SELECT metric, min(ts) AS ts, arg_min(value, row(ts, seq)) AS value, arg_min(seq, row(ts, seq)) AS seq FROM p WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY metric")
def ceiling_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.ceiling_points(points.event_points(spark, sf_dir), to_ms(datetime(2024, 1, 15, 12)))


@add(
    "as_of_join",
    f"{P}, q AS (SELECT seq, ts, 'click' AS metric FROM p WHERE metric = 'purchase') SELECT q.seq, q.ts, c.ts AS found_ts, c.value AS found_value FROM q ASOF LEFT JOIN (SELECT * FROM p WHERE metric = 'click') c ON q.ts >= c.ts",
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points.event_points(spark, sf_dir)
    probes = own.where("metric = 'purchase'").select("seq", "ts", F.lit("click").alias("metric"))
    return ordered.as_of(probes, own.where("metric = 'click'"), "metric").select("seq", "ts", "found_ts", "found_value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.daily_means(points.event_points(spark, sf_dir))


def stored_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means as a table, for what reads them more than once."""
    return staged(daily(spark, sf_dir), "daily")


_PAIRS = f"{D}, x AS (SELECT a.metric AS metric_a, b.metric AS metric_b, a.day, a.mean AS a, b.mean AS b FROM d a JOIN d b ON a.day = b.day AND a.metric < b.metric)"
_R = (
    ", s AS (SELECT metric_a, metric_b, count(*) AS sample_size, count(*) * sum(a * b) - sum(a) * sum(b) AS top, (count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b)) AS spread FROM x GROUP BY ALL)"
    ", r AS (SELECT metric_a, metric_b, sample_size, CASE WHEN spread > 0 THEN top / sqrt(spread) ELSE 0 END AS r FROM s)"
)
_SHOWN = (
    f" SELECT metric_a, metric_b, {near('r', 2)} AS coefficient, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' WHEN abs(r) > 0.3 THEN 'weak' ELSE 'negligible' END AS strength,"
    " CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, sample_size FROM r"
)


@add("daily_correlation", _PAIRS + _R + _SHOWN + " WHERE abs(r) > 0.0")
def daily_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.correlations(stored_daily(spark, sf_dir), least_r=0.0)


@add("strong_correlation", _PAIRS + _R + _SHOWN + " WHERE sample_size >= 7 AND abs(r) > 0.3")
def strong_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.correlations(stored_daily(spark, sf_dir))


@add("correlation_for_metric", _PAIRS + _R + _SHOWN + " WHERE (metric_a = 'click' OR metric_b = 'click') AND abs(r) > 0.0")
def correlation_for_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.correlations(stored_daily(spark, sf_dir), least_r=0.0, metric="click")


@add("pair_alignment", f"{_PAIRS} SELECT metric_a, metric_b, day, {near('a')} AS a, {near('b')} AS b FROM x")
def pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.aligned_pairs(stored_daily(spark, sf_dir)).withColumns({c: C.rounded(F.col(c), 6) for c in ("a", "b")})


@add("zero_variance_corr", "WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) SELECT 0.0::DOUBLE AS r, count(*) AS days FROM d")
def zero_variance_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = points.event_points(spark, sf_dir).groupBy(C.bucket("day").alias("day")).agg(F.count("*").cast("double").alias("n"), F.lit(1.0).alias("one"))
    return days.agg(C.pearson("n", "one").alias("r"), F.count("*").alias("days"))


_TREND = (
    f"{D}, h AS (SELECT metric, mean, row_number() OVER (PARTITION BY metric ORDER BY day) > count(*) OVER (PARTITION BY metric) // 2 AS late FROM d)"
    f" SELECT metric, {near('avg(mean)', 5)} AS average, CASE WHEN count(*) >= 4 THEN {near('(avg(mean) FILTER (WHERE late) - avg(mean) FILTER (WHERE NOT late))', 5)} END AS trend, count(*) AS days FROM h GROUP BY metric"
)


@add("half_split_trend", _TREND)
def half_split_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.trends(daily(spark, sf_dir)).withColumns({c: C.rounded(F.col(c), 5) for c in ("average", "trend")})


@add("mean_of_daily_means", f"{D} SELECT metric, {near('avg(mean)')} AS average FROM d GROUP BY metric")
def mean_of_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).groupBy("metric").agg(C.rounded(F.avg("mean"), 6).alias("average"))


@add(
    "daily_summary",
    f"{D} SELECT strftime(day, '%Y-%m-%d') AS date, string_agg(metric || ': ' || printf('%.1f', {near('mean', 1)}), ', ' ORDER BY metric) AS content, count(*) AS metrics, CAST(sum(n) AS BIGINT) AS data_points FROM d GROUP BY 1",
)
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.daily_summary(daily(spark, sf_dir))


@add(
    "metric_card",
    f"{D}, m AS (SELECT metric, arg_max(mean, day) AS current, avg(mean) AS average, min(mean) AS least, max(mean) AS most FROM d GROUP BY metric)"
    f" SELECT metric, {near('current')} AS current, {near('average')} AS average, {near('(current - average)')} AS difference, {near('((current - average) / average * 100)')} AS percent,"
    f" CASE WHEN current - average > 0.1 THEN 'up' WHEN current - average < -0.1 THEN 'down' ELSE 'flat' END AS arrow,"
    f" {near('(least - CASE WHEN most > least THEN (most - least) * 0.1 ELSE 1.0 END)')} AS low, {near('(most + CASE WHEN most > least THEN (most - least) * 0.1 ELSE 1.0 END)')} AS high FROM m",
)
def metric_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = analysis.metric_cards(daily(spark, sf_dir))
    return cards.select(*[C.rounded(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in cards.dtypes])


@add(
    "sparkline7",
    f"{D}, l AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS back FROM d), w AS (SELECT metric, day, mean, min(mean) OVER (PARTITION BY metric) AS least, max(mean) OVER (PARTITION BY metric) - min(mean) OVER (PARTITION BY metric) AS spread FROM l WHERE back <= 7)"
    " SELECT metric, day, CAST(floor(20 + (mean - least) / CASE WHEN spread < 0.01 THEN 1.0 ELSE spread END * 80) AS BIGINT) AS height FROM w",
)
def sparkline7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.sparklines(daily(spark, sf_dir))


@add("recent5", f"{P} SELECT metric, ts, value, seq FROM p ORDER BY ts DESC, seq DESC LIMIT 5")
def recent5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.event_points(spark, sf_dir).select("metric", "ts", "value", "seq").orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(5)


@add("delta_encode", f"{P} SELECT metric, seq, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY metric ORDER BY ts, seq), 0) AS delta_ms FROM p")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.deltas(points.event_points(spark, sf_dir)).drop("place")


@add("moving_average", f"{P} SELECT metric, seq, {near('avg(value) OVER (PARTITION BY metric ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 5)} AS moving_avg FROM p")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.running(points.event_points(spark, sf_dir)).withColumn("moving_avg", C.rounded(F.col("moving_avg"), 5))


def one_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one metric on few instants: a metric, a day and a time that hold very many rows."""
    hour = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return points.event_points(spark, sf_dir).withColumns({"metric": F.lit("all"), "ts": F.when(F.col("ts") < C.moment(MIDDLE), C.moment(to_ms(datetime(2024, 1, 1)))).otherwise(hour)})


#: In few rows a stretch, so that the given tables have many.
FEW = 500
_ONE = P + ", o AS (SELECT 'all' AS metric, CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' THEN TIMESTAMP '2024-01-01' ELSE date_trunc('day', ts)::TIMESTAMP END AS ts, value, seq, metric AS kind FROM p)"


@add("delta_encode_hot", f"{_ONE} SELECT seq, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER w, 0) AS delta_ms, row_number() OVER w - 1 AS place FROM o WINDOW w AS (ORDER BY ts, seq)")
def delta_encode_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences where one metric and instant holds half of all rows."""
    return ordered.deltas(one_metric(spark, sf_dir), FEW).select("seq", "delta_ms", "place")


@add("delta_decode", f"{P} SELECT metric, seq, epoch_us(ts) // 1000 AS at_ms FROM p")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that come back from differences and each metric's first time."""
    own = points.event_points(spark, sf_dir)
    starts = own.groupBy("metric").agg(F.min(C.millis("ts")).alias("start_ms"))
    return ordered.times_of(ordered.deltas(own, FEW), starts, FEW)


@add("moving_average_hot", f"{_ONE} SELECT seq, {near('avg(value) OVER (ORDER BY ts, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 5)} AS moving_avg FROM o")
def moving_average_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.running(one_metric(spark, sf_dir), rows_each=FEW).select("seq", C.rounded(F.col("moving_avg"), 5).alias("moving_avg"))


@add(
    "as_of_hot",
    f"{_ONE}, c AS (SELECT ts, max(seq) AS last, arg_max(value, seq) AS value FROM o WHERE kind = 'click' GROUP BY ts), q AS (SELECT seq, ts FROM o WHERE kind = 'purchase')"
    " SELECT q.seq, q.ts, c.ts AS found_ts, c.value AS found_value FROM q ASOF LEFT JOIN c ON q.ts >= c.ts",
)
def as_of_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase, where half of both are at one instant."""
    kinds = points.event_points(spark, sf_dir).select("seq", F.col("metric").alias("kind"))
    own = one_metric(spark, sf_dir).join(kinds, "seq")
    probes = own.where("kind = 'purchase'").select("seq", "ts", "metric")
    return ordered.as_of(probes, own.where("kind = 'click'"), "metric", rows_each=FEW).select("seq", "ts", "found_ts", "found_value")


@add(
    "default_rollup",
    f"{P} SELECT metric, date_trunc('day', ts)::TIMESTAMP AS bucket, {near('''CASE metric WHEN 'signup' THEN CAST(count(value) AS DOUBLE) WHEN 'view' THEN avg(value) ELSE sum(value) END''')} AS value FROM p GROUP BY 1, 2",
)
def default_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.resampled(points.event_points(spark, sf_dir), points.metric_table(spark), "day")
    return found.withColumn("value", C.rounded(F.col("value"), 6))


@add(
    "order_totals_by_month",
    f"SELECT lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')) AS metric, date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS n, {near('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1, 2",
)
def order_totals_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points.order_points(spark, sf_dir)
    return own.groupBy("metric", C.bucket("month").alias("bucket")).agg(F.count("*").alias("n"), C.rounded(F.sum("value"), 2).alias("total"))


@add("tag_keys", f"{P}, t AS (SELECT 'k' AS key, k AS value FROM p UNION ALL SELECT 'user', u FROM p) SELECT key, count(*) AS points, count(DISTINCT value) AS distinct_values FROM t GROUP BY key")
def tag_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.tag_keys(points.event_points(spark, sf_dir))


@add("tag_values", f"{P} SELECT k AS value, count(*) AS n FROM p GROUP BY k")
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.tag_values(points.event_points(spark, sf_dir), "k")


@add("metric_stats", f"{P} SELECT metric, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS least, max(value) AS most, {near('avg(value)')} AS mean FROM p GROUP BY metric")
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.metric_stats(points.event_points(spark, sf_dir)).withColumn("mean", C.rounded(F.col("mean"), 6))


def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file for each day."""
    folder = shared_path(spark, "days")
    points.event_points(spark, sf_dir).select("metric", "seq", F.to_date("ts").alias("day")).repartition("day").write.partitionBy("day").parquet(folder)
    return spark.read.parquet(folder)


@add("storage_stats", "SELECT event_type AS metric, count(DISTINCT ts::DATE) AS files, count(*) AS n FROM events GROUP BY 1")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many files each metric lies, of a file for each day."""
    return lookups.storage_stats(by_day(spark, sf_dir), "metric")


@add("storage_size", "SELECT count(DISTINCT ts::DATE) AS files, true AS same_bytes, count(*) AS n FROM events")
def storage_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, rows, and whether the bytes are those that the file system tells."""
    rows = by_day(spark, sf_dir)
    folder = rows.select("_metadata.file_path").first()[0].rsplit("/day=", 1)[0]
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).agg(F.sum("length")).first()[0]
    return lookups.storage_size(rows).select("files", (F.col("bytes") == listed).alias("same_bytes"), "n")


@add("time_bounds", f"{P} SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, count(DISTINCT metric) AS metrics FROM p")
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.time_bounds(points.event_points(spark, sf_dir))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as they might come in: some kinds without a name, very large values infinite, very small ones no number, tags too long for some users."""
    own = points.event_points(spark, sf_dir)
    return own.select(
        F.when(F.col("metric") == "error", "").otherwise(F.col("metric")).alias("metric"), "ts",
        F.when(F.col("value") > 200, float("inf")).when(F.col("value") < 1, float("nan")).otherwise(F.col("value")).alias("value"),
        F.map_concat("tags", F.create_map(F.lit("note"), F.when(F.col("tags")["user"] == "7", F.repeat(F.lit("x"), 201)).otherwise("ok"))).alias("tags"), "seq",
    )


_GOOD = "metric <> 'error' AND value <= 200 AND value >= 1 AND u <> '7'"


@add("ingest_valid", f"{P} SELECT metric, ts, value, seq FROM p WHERE {_GOOD}")
def ingest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.accepted(incoming(spark, sf_dir), NOW).select("metric", "ts", "value", "seq")


@add(
    "ingest_rejects",
    f"{P} SELECT seq, concat_ws(',', CASE WHEN metric = 'error' THEN 'metric_empty' END, CASE WHEN value > 200 OR value < 1 THEN 'value_not_finite' END, CASE WHEN u = '7' THEN 'tag_value' END) AS errors FROM p WHERE NOT ({_GOOD})",
)
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rejected(incoming(spark, sf_dir), NOW).select("seq", F.array_join("errors", ",").alias("errors"))


@add("bounds_check", f"{P} SELECT metric, ts, value, seq FROM p WHERE metric = 'error' AND value > 100")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.out_of_bounds(points.event_points(spark, sf_dir), points.metric_table(spark)).select("metric", "ts", "value", "seq")


@add(
    "csv_melt",
    f"{P}, w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, " + ", ".join(f"count(*) FILTER (WHERE metric = '{m}' AND u = '3') AS {m}" for m in KINDS) + " FROM p GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, day + INTERVAL 12 HOUR AS ts, CAST({m} AS DOUBLE) AS value FROM w WHERE {m} > 0" for m in KINDS),
)
def csv_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of one user written as lines of a wide CSV and read again; counts of zero are empty cells."""
    own = points.event_points(spark, sf_dir)
    cells = [F.nullif(F.count_if((F.col("metric") == m) & (F.col("tags")["user"] == "3")), F.lit(0)).alias(m) for m in KINDS]
    wide = own.groupBy(F.date_format(C.bucket("day"), "yyyy-MM-dd").alias("Date")).agg(*cells)
    return imports.csv_points(wide.select(F.to_csv(F.struct(*wide.columns)).alias("line")), ",".join(wide.columns))


@add(
    "health_points",
    f"{P} SELECT CASE metric WHEN 'click' THEN 'steps' ELSE 'heart_rate' END AS metric, date_trunc('second', ts)::TIMESTAMP AS ts, value, CASE metric WHEN 'click' THEN 'count' ELSE '' END AS unit, 'user ' || u AS source FROM p WHERE metric IN ('click', 'view')",
)
def health_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as health records (those of errors without a number) and read again."""
    own = points.event_points(spark, sf_dir).where("metric in ('click', 'view', 'error')")
    kind = F.when(F.col("metric") == "click", "HKQuantityTypeIdentifierStepCount").otherwise("HKQuantityTypeIdentifierHeartRate")
    value = F.when(F.col("metric") == "error", "HKCategoryValueSleepAnalysisAsleep").otherwise(F.col("value").cast("string"))
    unit = F.when(F.col("metric") == "click", ' unit="count"').otherwise("")
    line = F.concat(
        F.lit('<Record type="'), kind, F.lit('" sourceName="user '), F.col("tags")["user"], F.lit('"'), unit,
        F.lit(' startDate="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(' +0000" value="'), value, F.lit('"/>'),
    )
    return imports.health_points(own.select(line.alias("line")))


@add(
    "repository_daily",
    f"{P}, g AS (SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOUR AS ts, CAST(2 * count(*) FILTER (WHERE metric = 'click') AS DOUBLE) AS commits, CAST(count(*) FILTER (WHERE metric = 'view' AND value > 50) AS DOUBLE) AS prs_merged,"
    " CAST(count(*) FILTER (WHERE metric = 'signup') AS DOUBLE) AS prs_opened, CAST(count(*) FILTER (WHERE metric = 'error') AS DOUBLE) AS code_reviews FROM p GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, ts, {m} AS value FROM g WHERE {m} > 0" for m in ("commits", "prs_merged", "prs_opened", "code_reviews")),
)
def repository_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as repository events in JSON and read again."""
    return imports.repository_points(repository_lines(spark, sf_dir))


def repository_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, ts): events as repository events in JSON."""
    metric, value = F.col("metric"), F.col("value")
    kind = F.when(metric == "click", "PushEvent").when(metric.isin("view", "signup"), "PullRequestEvent").when(metric == "error", "PullRequestReviewEvent").otherwise("WatchEvent")
    payload = F.struct(
        F.when(metric == "view", "closed").when(metric == "signup", "opened").alias("action"),
        F.when(metric == "click", F.array(F.struct(F.lit("a").alias("sha")), F.struct(F.lit("b").alias("sha")))).alias("commits"),
        F.struct((value > 50).alias("merged")).alias("pull_request"),
    )
    line = F.to_json(F.struct(kind.alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), payload.alias("payload")))
    return points.event_points(spark, sf_dir).select(line.alias("line"), "ts")


@add(
    "activity_points",
    f"{P}, g AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, CAST(count(*) FILTER (WHERE metric = 'click') AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE metric = 'view') AS DOUBLE) AS v, CAST(count(*) FILTER (WHERE metric = 'error' AND u = '3') AS DOUBLE) AS e FROM p GROUP BY 1)"
    " SELECT 'steps' AS metric, day + INTERVAL 12 HOUR AS ts, c AS value FROM g UNION ALL SELECT 'calories_burned', day + INTERVAL 12 HOUR, v FROM g UNION ALL SELECT 'active_minutes', day + INTERVAL 12 HOUR, c FROM g UNION ALL SELECT 'sleep_hours', day + INTERVAL 6 HOUR, e / 60 FROM g WHERE e > 0",
)
def activity_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts written as days of activity in JSON and read again."""
    n = lambda test: F.count_if(test).cast("double")
    metric = F.col("metric")
    days = points.event_points(spark, sf_dir).groupBy(F.date_format(C.bucket("day"), "yyyy-MM-dd").alias("date")).agg(
        n(metric == "click").alias("steps"), n(metric == "view").alias("caloriesOut"), n(metric == "click").alias("veryActiveMinutes"),
        n((metric == "error") & (F.col("tags")["user"] == "3")).alias("totalMinutesAsleep"),
    )
    line = F.to_json(F.struct("date", F.struct("steps", "caloriesOut", "veryActiveMinutes", "totalMinutesAsleep").alias("summary")))
    return imports.activity_points(days.select(line.alias("line")))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet*")


def _bucket_sql(interval: str) -> str:
    return f"{P} SELECT date_trunc('{interval}', ts)::TIMESTAMP AS bucket, metric, {near('avg(value)')} AS mean, count(*) AS n FROM p GROUP BY 1, 2"


for _interval in INTERVALS:

    def stream_buckets(spark: SparkSession, sf_dir: str, interval: str = _interval) -> DataFrame:
        made = tables.run_to_table(streams.bucketed(stream(spark, sf_dir), interval), "complete")
        return made.select("bucket", "metric", C.rounded(F.col("mean"), 6).alias("mean"), "n")

    add(f"stream_{_interval}", _bucket_sql(_interval))(stream_buckets)


@add("stream_dedup", f"{P} SELECT metric, ts, value, seq FROM p")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in the stream, once in the result."""
    twice = stream(spark, sf_dir)
    made = tables.run_to_table(streams.first_only(twice.unionByName(stream(spark, sf_dir))))
    return made.select("metric", "ts", "value", "seq")


_TOPICS = [("a", "metrics.click"), ("b", "metrics.*"), ("b", "metrics.view"), ("c", "category.custom"), ("d", "category.*")]


@add(
    "stream_topics",
    f"{P}, c AS (SELECT *, CASE WHEN metric IN ('purchase', 'signup') THEN 'custom' ELSE 'other' END AS category FROM p) "
    + " UNION ALL ".join(f"SELECT '{s}' AS subscriber, 'metrics.' || metric AS topic, value, seq FROM c WHERE {w}" for s, w in (("a", "metric = 'click'"), ("b", "true"), ("c", "category = 'custom'"), ("d", "true"))),
)
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscriptions = spark.createDataFrame(_TOPICS, "subscriber string, topic string")
    made = tables.run_to_table(stream(spark, sf_dir), batch=lambda rows: streams.routed(rows, subscriptions, points.metric_table(rows.sparkSession)))
    return made.select("subscriber", "topic", "value", "seq")


@add("stream_ingest", f"{P} SELECT metric, ts, value, seq FROM p WHERE value <= 200")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed events, very large values made infinite; the good rows that were written."""
    rows = stream(spark, sf_dir).withColumn("value", F.when(F.col("value") > 200, float("inf")).otherwise(F.col("value")))
    return tables.run_to_table(rows, batch=lambda b: streams.split_ingest(b, NOW)[0]).select("metric", "ts", "value", "seq")


for _op, _sign in (("gte", ">="), ("gt", ">"), ("lt", "<"), ("lte", "<=")):
    add(f"time_{_op}", rows_sql(f"date_trunc('millisecond', ts) {_sign} TIMESTAMP '2024-01-15 12:00:00' AND metric = 'click'"))(on_points(Query.select("click").where_time(_op, MIDDLE)))


@add("time_eq", f"{P}, t AS (SELECT max(epoch_ms(ts)) AS latest FROM p WHERE metric = 'click') SELECT ts, arg_min(value, seq) AS click FROM p, t WHERE metric = 'click' AND epoch_ms(ts) = latest GROUP BY ts")
def time_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last millisecond that has a click."""
    own = points.event_points(spark, sf_dir)
    at = own.where("metric = 'click'").agg(F.max(C.millis("ts"))).first()[0]
    return Query.select("click").where_time("=", at).run(own, NOW, KINDS)


add("time_between", rows_sql("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15 12:00:00' AND metric = 'click'"))(
    on_points(Query.select("click").where_time(">=", to_ms(datetime(2024, 1, 10))).where_time("<", MIDDLE))
)


@add("export_sorted", f"""{P} SELECT row_number() OVER (ORDER BY ts, metric, seq) AS place, epoch_us(ts) // 1000 AS timestamp, metric, value FROM p WHERE {IN_WEEK} AND metric IN ('click', 'error')""")
def export_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of their file, as their number there shows."""
    rows = export.export_rows(points.event_points(spark, sf_dir), WEEK, "click, error", ordered=True)
    part = staged(rows.select("timestamp", "metric", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "export")
    sizes = part.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = sizes.select("part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return part.join(before, "part").select((F.col("row") - F.col("first") + F.col("before") + 1).alias("place"), "timestamp", "metric", "value")


@add(
    "ingest_batches",
    f"{P}, e AS (SELECT day(ts) AS batch, seq, concat_ws(', ', CASE WHEN metric = 'error' THEN 'metric_empty' END, CASE WHEN value > 200 OR value < 1 THEN 'value_not_finite' END, CASE WHEN u = '7' THEN 'tag_value' END) AS errors FROM p),"
    " b AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE errors <> '') AS bad, string_agg('item ' || seq || ': ' || errors, '; ' ORDER BY seq) FILTER (WHERE errors <> '') AS texts FROM e GROUP BY batch), m AS (SELECT count(*) // 31 AS most FROM p)"
    " SELECT batch, CASE WHEN n > most THEN 0 ELSE n - bad END AS accepted, CASE WHEN n > most THEN n ELSE bad END AS rejected, CASE WHEN n > most THEN n || ' items, ' || most || ' at most' ELSE coalesce(texts, '') END AS errors FROM b, m",
)
def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each day of the month; those above the usual size are turned away."""
    items = incoming(spark, sf_dir).withColumns({"batch": F.dayofmonth("ts").cast("long"), "item": F.col("seq")})
    found = validation.ingest_batches(items, NOW, limit=items.count() // 31)
    return found.select("batch", "accepted", "rejected", F.array_join("errors", "; ").alias("errors"))


@add("metrics_list", "SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'sum' WHEN 'view' THEN 'average' END AS aggregation, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def metrics_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a category, with the number of their points."""
    found = lookups.metric_rows(points.metric_table(spark), category="productivity")
    return points.event_points(spark, sf_dir).join(found.withColumnRenamed("name", "metric"), "metric").groupBy(F.col("metric").alias("name"), "aggregation").agg(F.count("*").alias("n"))


@add("json_rows", f"""{P}, c AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE metric = 'click') AS BIGINT) AS click, nullif(count(*) FILTER (WHERE metric = 'error' AND u = '3'), 0) AS error FROM p GROUP BY 1)
    SELECT '{{"day":"' || day || '","click":' || click || coalesce(',"error":' || error, '') || '}}' AS json FROM c""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = points.event_points(spark, sf_dir).groupBy(F.date_format(C.bucket("day"), "yyyy-MM-dd").alias("day"))
    error = F.nullif(F.count_if((F.col("metric") == "error") & (F.col("tags")["user"] == "3")), F.lit(0))
    return export.json_rows(days.agg(F.count_if(F.col("metric") == "click").alias("click"), error.alias("error")))


@add("text_rows", f"{P} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS time, coalesce(printf('%.1f', CAST(nullif(count(*) FILTER (WHERE metric = 'click'), 0) AS DOUBLE)), '-') AS click, coalesce(printf('%.1f', CAST(nullif(count(*) FILTER (WHERE metric = 'error'), 0) AS DOUBLE)), '-') AS error FROM p WHERE {IN_WEEK} AND metric IN ('click', 'error') GROUP BY 1")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.text_rows(Query.select("click", "error").time_range(WEEK).group_by("hour").aggregate("count").run(points.event_points(spark, sf_dir), NOW, KINDS))


@add(
    "csv_report",
    f"{P} SELECT count(*) AS rows_read, count(*) FILTER (WHERE metric <> 'error') * 1 AS points, count(*) FILTER (WHERE metric = 'error') AS failed,"
    " array_to_string(list_slice(list('row ' || seq || ': not a time: soon' ORDER BY seq) FILTER (WHERE metric = 'error'), 1, 100), '; ') AS errors, greatest(count(*) FILTER (WHERE metric = 'error') - 100, 0) AS more FROM p",
)
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines of a CSV between semicolons, those of errors without a good time, and a report of reading them."""
    own = points.event_points(spark, sf_dir)
    time = F.when(F.col("metric") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat_ws(";", time, F.col("value").cast("string"), F.col("metric"))
    found = imports.csv_report(own.select("seq", line.alias("line")), '"Local time";Value;"Kind; as text"', "seq", separator=";")
    return found.withColumn("errors", F.array_join("errors", "; "))


def health_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, day, record): clicks and views as health records in XML."""
    own = points.event_points(spark, sf_dir).where("metric in ('click', 'view')")
    kind = F.when(F.col("metric") == "click", "HKQuantityTypeIdentifierStepCount").otherwise("HKQuantityTypeIdentifierHeartRate")
    unit = F.when(F.col("metric") == "click", ' unit="count"').otherwise("")
    record = F.concat(
        F.lit('<Record type="'), kind, F.lit('" sourceName="user '), F.col("tags")["user"], F.lit('"'), unit,
        F.lit(' startDate="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(' +0000" value="'), F.col("value").cast("string"), F.lit('"/>'),
    )
    return own.select(F.col("tags")["user"].alias("user"), C.bucket("day").alias("day"), record.alias("record"))


def zipped(text: str) -> bytes:
    """A health export as it comes: an archive with one file in a folder."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("export/export.xml", f"<Data>{text}</Data>")
    return whole.getvalue()


@add("health_archive", ORACLES["health_points"])
def health_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as archives in a column, one for each user and day, and read again."""
    files = health_records(spark, sf_dir).groupBy("user", "day").agg(F.array_join(F.collect_list("record"), "").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(zipped(x)).decode() for x in b.column(0).to_pylist()], pa.string())], ["archive"])

    return imports.health_archives(files.select("text").mapInArrow(pack, "archive string"))


@add("health_files", ORACLES["health_points"])
def health_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as archives on disk, one for each user, unpacked where they lie."""
    folder = shared_path(spark, "zips")
    files = health_records(spark, sf_dir).groupBy("user").agg(F.array_join(F.collect_list("record"), "").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            store, base = pafs.FileSystem.from_uri(folder)
            store.create_dir(base)
            for user, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{user}.zip") as f:
                    f.write(zipped(text))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    files.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return imports.health_files(spark, folder).drop("file")


@add("health_xml", ORACLES["health_points"])
def health_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as plain XML, a file for each user."""
    folder = shared_path(spark, "xml")
    text = F.concat(F.lit("<HealthData>\n"), F.array_join(F.collect_list("record"), "\n"), F.lit("\n</HealthData>"))
    health_records(spark, sf_dir).groupBy("user").agg(text.alias("value")).write.partitionBy("user").text(folder)
    return imports.health_xml(spark, folder)


@add(
    "health_acronyms",
    f"{P} SELECT CASE metric WHEN 'click' THEN 'hrv' ELSE 'vo2_max' END AS metric, date_trunc('second', ts)::TIMESTAMP AS ts, value FROM p WHERE metric IN ('click', 'view')",
)
def health_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose types hold acronyms, which are words of their own names."""
    changed = F.replace(F.replace("record", F.lit("StepCount"), F.lit("HeartRateVariabilitySDNN")), F.lit("IdentifierHeartRate\""), F.lit("IdentifierVO2Max\""))
    return imports.health_points(health_records(spark, sf_dir).select(changed.alias("line")), acronyms=True).select("metric", "ts", "value")


_USER3 = ", ".join(f"CAST(count(*) FILTER (WHERE metric = '{m}' AND u = '3') AS DOUBLE) AS {m}3, CAST(count(*) FILTER (WHERE metric = '{m}' AND u <> '3') AS DOUBLE) AS {m}" for m in ("click", "error", "view"))


@add(
    "csv_files",
    f"{P}, w AS (SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOUR AS ts, {_USER3} FROM p GROUP BY 1)"
    " SELECT 'click' AS metric, ts, click3 AS value FROM w UNION ALL SELECT 'error', ts, error3 FROM w UNION ALL SELECT 'page_view', ts, view FROM w UNION ALL SELECT 'click', ts, click FROM w",
)
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts in two files that differ in the order and number of their columns, in one import."""
    own, folder = points.event_points(spark, sf_dir), shared_path(spark, "csv")
    count = lambda m, test: F.count_if((F.col("metric") == m) & test)
    user3, day = F.col("tags")["user"] == "3", F.date_format(C.bucket("day"), "yyyy-MM-dd").alias("day")
    days = own.groupBy(day).agg(count("click", user3).alias("a"), count("error", user3).alias("b"), count("view", ~user3).alias("c"), count("click", ~user3).alias("d"))
    for header, columns in (("Date,click,error", ["day", "a", "b"]), ('"Page view",Click,Local time,note', ["c", "d", "day", F.lit("x").alias("e")])):
        lines = days.select(F.lit(1).alias("rank"), F.to_csv(F.struct(*columns)).alias("value"))
        head = spark.createDataFrame([(0, header)], "rank int, value string")
        head.union(lines).repartition(1).sortWithinPartitions("rank").select("value").write.mode("append").text(folder)
    return imports.csv_file_points(spark, folder).drop("file")


def store(spark: SparkSession, sf_dir: str, **more) -> str:
    """The events as a store that goes with the driver."""
    folder = shared_path(spark, "store")
    storage.store_points(points.event_points(spark, sf_dir), folder, **more)
    return folder


@add("tag_stored", f"{P} SELECT metric, ts, value, seq, u FROM p WHERE k = '7'")
def tag_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by a tag that a store keeps as a column: the test reaches the scan; other tags are still in the map."""
    found = storage.with_tag(storage.stored_points(spark, store(spark, sf_dir, tags=("k",))), "k", ["7"])
    return storage.whole_points(found).select("metric", "ts", "value", "seq", F.col("tags")["user"].alias("u"))


@add("points_removed", f"{P} SELECT metric, ts, value, seq, k FROM p WHERE NOT (k IN ('1', '2') AND metric = 'click') AND ts < TIMESTAMP '2024-01-29'")
def points_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points removed from the files of a store, whole days among them."""
    folder = store(spark, sf_dir, tags=("k",))
    stored = storage.stored_points(spark, folder)
    storage.remove_points(spark, folder, stored.where("(tag_k in ('1', '2') and metric = 'click') or ts >= timestamp_ntz '2024-01-29'").select("seq", "ts"))
    return storage.stored_points(spark, folder).select("metric", "ts", "value", "seq", F.col("tag_k").alias("k"))


@add("points_compacted", f"{P} SELECT strftime(ts, '%Y-%m-%d') AS day, 1::BIGINT AS files, count(*) AS n, sum(seq)::BIGINT AS seqs FROM p GROUP BY 1")
def points_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that was written in three turns, compacted: a file for each day."""
    folder, own = shared_path(spark, "store"), points.event_points(spark, sf_dir)
    for turn in range(3):
        storage.store_points(own.where(F.col("seq") % 3 == turn), folder)
    storage.compact(spark, folder)
    files = F.count_distinct("_metadata.file_path").alias("files")
    return storage.stored_points(spark, folder).groupBy(F.col("day").cast("string").alias("day")).agg(files, F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@add("tag_sketches", f"{P}, t AS (SELECT 'k' AS key, k AS value FROM p WHERE {IN_WEEK} UNION ALL SELECT 'user', u FROM p WHERE {IN_WEEK}) SELECT key, count(*) AS points, true AS near FROM t GROUP BY key")
def tag_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values tags have in a week, from daily sketches, and whether that is within 5 % of the count."""
    own = points.event_points(spark, sf_dir)
    sketches = staged(storage.value_sketches(own), "sketches")
    exact = lookups.tag_keys(own.where(C.in_range(WEEK))).select("key", F.col("distinct_values").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return storage.distinct_values(sketches, WEEK).join(exact, "key").select("key", "points", near.alias("near"))


@add("json_array", f"{P} SELECT seq, metric, value FROM p WHERE metric <> 'error' UNION ALL SELECT -1, 'brackets', 2.0")
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as one JSON array over several files, and read by lines."""
    folder = shared_path(spark, "array")
    export.write_json_array(points.event_points(spark, sf_dir).where("metric <> 'error'").select("seq", "metric", "value"), folder)
    lines = spark.read.text(folder)
    own = lines.where("value not in ('[', ']')").select(F.from_json(F.regexp_replace("value", "^,", ""), "seq long, metric string, value double").alias("r")).select("r.*")
    return own.union(lines.where("value in ('[', ']')").agg(F.lit(-1).cast("long").alias("seq"), F.lit("brackets").alias("metric"), F.count("*").cast("double").alias("value")))


@add(
    "source_sync",
    f"{P}, g AS (SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOUR AS ts, count(*) FILTER (WHERE metric = 'click') AS n FROM p GROUP BY 1)"
    " SELECT 'steps' AS metric, ts, CAST(n AS DOUBLE) AS value FROM g WHERE ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'active_minutes', ts, 0.0 FROM g WHERE ts >= TIMESTAMP '2024-01-15'",
)
def source_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the activity source has from a time on."""
    days = points.event_points(spark, sf_dir).groupBy(F.date_format(C.bucket("day"), "yyyy-MM-dd").alias("date")).agg(F.count_if(F.col("metric") == "click").cast("double").alias("steps"))
    return imports.sync("activity", days.select(F.to_json(F.struct("date", F.struct("steps").alias("summary"))).alias("line")), C.moment(to_ms(datetime(2024, 1, 15))))


def _repository_sql(where: str) -> str:
    counts = {"commits": "2 * count(*) FILTER (WHERE metric = 'click')", "prs_merged": "count(*) FILTER (WHERE metric = 'view' AND value > 50)", "prs_opened": "count(*) FILTER (WHERE metric = 'signup')", "code_reviews": "count(*) FILTER (WHERE metric = 'error')"}
    return (
        f"{P}, g AS (SELECT date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOUR AS ts, {', '.join(f'CAST({x} AS DOUBLE) AS {m}' for m, x in counts.items())} FROM p WHERE {where} GROUP BY 1) "
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, ts, {m} AS value FROM g WHERE {m} > 0" for m in counts)
    )


def raw_folder(spark: SparkSession, lines: DataFrame) -> str:
    """The lines as text files."""
    path = shared_path(spark, "raw")
    lines.select("line").write.text(path)
    return path


@add("repository_since", _repository_sql("ts >= TIMESTAMP '2024-01-15 12:00:00'"))
def repository_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source has from a time within a day on."""
    return imports.sync("repository", repository_lines(spark, sf_dir), C.moment(MIDDLE))


@add("raw_source", _repository_sql("ts >= TIMESTAMP '2024-01-15 12:00:00' AND metric IN ('click', 'error')"))
def raw_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event files read by the library's own format; the filters are applied by its reader."""
    raw.register_raw(spark)
    events = spark.read.format("tidemark_raw").options(**raw.RAW["repository"]).load(raw_folder(spark, repository_lines(spark, sf_dir)))
    return imports.repository_points(events.where((F.col("at") >= C.moment(MIDDLE)) & F.col("kind").isin("PushEvent", "PullRequestReviewEvent")))


@add("raw_stream", _repository_sql("true"))
def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, whose rows are summed afterwards."""
    raw.register_raw(spark)
    events = spark.readStream.format("tidemark_raw").options(**raw.RAW["repository"]).load(raw_folder(spark, repository_lines(spark, sf_dir)))
    return imports.repository_points(tables.run_to_table(events))


@add("sync_twice", _repository_sql("true"))
def sync_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two syncs of one source that split a day, and a third that finds nothing: the totals of one."""
    raw.register_raw(spark)
    table_, lines = incremental.SyncTable(spark, shared_path(spark, "sync")), repository_lines(spark, sf_dir)
    for some in (lines.where(F.col("ts") < C.moment(MIDDLE)), lines, lines):
        table_.sync("repository", spark.read.format("tidemark_raw").options(**raw.RAW["repository"]).load(raw_folder(spark, some)))
    return table_.points().drop("source")


@add("table_and_stream", f"{P} SELECT metric, ts, value, seq FROM p")
def table_and_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table holds up to a time and a stream has read from a time before on, each row once."""
    streamed = tables.run_to_table(stream(spark, sf_dir).where(F.col("ts") >= C.moment(to_ms(datetime(2024, 1, 10)))))
    stored = points.event_points(spark, sf_dir).where(F.col("ts") < C.moment(MIDDLE))
    return streams.with_table(streamed, stored).select("metric", "ts", "value", "seq")


@add("stream_resumed", f"{P} SELECT metric, ts, value, seq FROM p")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named stream run twice: the second run finds nothing new, and every row is there once."""
    name = f"resumed-{uuid.uuid4().hex}"
    tables.run_to_table(stream(spark, sf_dir), name=name)
    return tables.run_to_table(stream(spark, sf_dir), name=name).select("metric", "ts", "value", "seq")


_WANTED = ["metrics.click", "metrics.*", "category.productivity", "metrics.view"]


@add(
    "stream_subscriptions",
    f"{P}, q AS (SELECT 's' || (user_id % 5) AS subscriber, {_WANTED}[user_id % 4 + 1] AS topic, ts, event_type FROM events WHERE event_type IN ('purchase', 'error')),"
    " s AS (SELECT q.subscriber, q.topic, q.ts, min(u.ts) AS gone FROM q LEFT JOIN q AS u ON u.subscriber = q.subscriber AND u.topic = q.topic AND u.ts > q.ts AND u.event_type = 'error'"
    " WHERE q.event_type = 'purchase' GROUP BY q.subscriber, q.topic, q.ts), o AS (SELECT subscriber, topic, ts, least(ts + INTERVAL 2 DAY, coalesce(gone, ts + INTERVAL 2 DAY)) AS until FROM s),"
    " w AS (SELECT (least(max(epoch_us(ts)) FILTER (metric IN ('click', 'view')), max(epoch_us(ts)) FILTER (metric IN ('purchase', 'error'))) // 1000 - 3600000) * 1000 AS passed FROM p)"
    " SELECT DISTINCT subscriber, 'metrics.' || metric AS topic, p.ts, value, seq FROM p, w, o WHERE metric IN ('click', 'view') AND p.ts >= o.ts AND p.ts < until AND epoch_us(p.ts) < passed"
    " AND o.topic IN ('metrics.' || metric, 'metrics.*', 'category.productivity', 'category.*')",
)
def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views for subscribers that come with each purchase, for two days, and go with each error; up to the watermark."""
    events = stream(spark, sf_dir)
    user = F.col("tags")["user"].cast("long")
    asked = events.where("metric in ('purchase', 'error')").select(
        F.concat(F.lit("s"), (user % 5).cast("string")).alias("subscriber"), F.get(F.array(*map(F.lit, _WANTED)), (user % 4).cast("int")).alias("topic"), "ts",
        F.when(F.col("metric") == "purchase", "subscribe").otherwise("unsubscribe").alias("action"), F.expr("INTERVAL '2 00:00:00' DAY TO SECOND").alias("lease"),
    )
    made = subscriptions.deliveries(events.where("metric in ('click', 'view')"), asked, points.metric_table(spark), shards=8)
    with subscriptions.rocksdb(spark):
        return tables.run_to_table(made)


@add("stream_standing", f"{P} SELECT metric, ts, value, seq FROM p")
def stream_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that stands, is stopped, and stands again: every row is there once."""
    kept = tables.stream_table(stream(spark, sf_dir))
    for _ in range(2):
        query = kept.start(stream(spark, sf_dir), every="100 milliseconds")
        query.processAllAvailable()
        tables.stop(query)
    return kept.rows().select("metric", "ts", "value", "seq")


@add("stream_update", _bucket_sql("day"))
def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily buckets in update mode: of each bucket the newest row."""
    made = tables.run_to_table(streams.bucketed(stream(spark, sf_dir), "day"), "update", keys=("bucket", "metric"))
    return made.select("bucket", "metric", C.rounded(F.col("mean"), 6).alias("mean"), "n")


_ASKED = {"click": "mood", "view": "sleep_hours", "purchase": "energy"}
_LEVEL = f"{D}, l AS (SELECT metric, avg(mean) / 10 AS v FROM d GROUP BY metric)"


@add(
    "insight_rules",
    f"{_LEVEL}, q AS (SELECT (SELECT v FROM l WHERE metric = 'click') AS mood, (SELECT v FROM l WHERE metric = 'view') AS sleep, (SELECT v FROM l WHERE metric = 'purchase') AS energy)"
    " SELECT concat_ws(' ', 'Your mood has been ' || CASE WHEN mood < 5 THEN 'low' WHEN mood > 7 THEN 'positive' ELSE 'moderate' END || printf(', at %.1f on average.', mood),"
    " CASE WHEN sleep < 6.5 AND mood < 6 THEN printf('Short sleep (%.1f hours) may play a part.', sleep) END,"
    " CASE WHEN sleep > 8.5 THEN printf('Lately there has been plenty of sleep, %.1f hours on average.', sleep) ELSE 'Your sleep has been ' || CASE WHEN sleep < 6 THEN 'quite low' WHEN sleep < 7 THEN 'slightly below seven hours' ELSE 'in a healthy range' END || printf(', at %.1f on average.', sleep) END,"
    " CASE WHEN energy < 5 THEN printf('Your energy has been low, at %.1f on average.', energy) WHEN energy > 7 THEN printf('Your energy has been good, at %.1f on average.', energy) END,"
    " CASE WHEN energy < 5 AND sleep < 7 THEN printf('Short sleep (%.1f hours) may play a part.', sleep) END) AS text FROM q",
)
def insight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' answer about mood, sleep and energy, for which three kinds of events stand, without changes."""
    rows = analysis.trends(daily(spark, sf_dir)).where(F.col("metric").isin(*_ASKED)).collect()
    found = insights.explain("how are my mood, sleep and energy?", {_ASKED[r["metric"]]: r["average"] / 10 for r in rows}, {})
    return spark.createDataFrame([(found.text,)], "text string")


@add(
    "insight_patterns",
    _TREND.replace(" SELECT metric,", ", t AS (SELECT metric,", 1) + "), l AS (SELECT count(*) AS n, string_agg(metric, ', ' ORDER BY metric) FILTER (WHERE trend > 0.3) AS up, string_agg(metric, ', ' ORDER BY metric) FILTER (WHERE trend < -0.3) AS down FROM t)"
    " SELECT concat_ws(' ', 'Going down: ' || down || '.', n || ' metrics were looked at.', 'Improving: ' || up || '.', 'Declining: ' || down || '.') AS text FROM l",
)
def insight_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' answer about declines and patterns, from the trends of all kinds of events."""
    found = insights.insight("why is it low, and do you see a pattern?", daily(spark, sf_dir))
    return spark.createDataFrame([(found.text,)], "text string")


@add(
    "csv_rows",
    f"""{P} SELECT (epoch_us(ts) // 1000) || ',' || metric || ',' || CAST(value AS VARCHAR) || ',"{{""k"":""' || k || '"",""user"":""' || u || '""}}"' AS line FROM p WHERE {IN_WEEK} AND metric = 'click' UNION ALL SELECT 'timestamp,metric,value,tags'""",
)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported CSV files, by lines; the header, which each file has, once."""
    folder = shared_path(spark, "export")
    export.write_csv(export.export_rows(points.event_points(spark, sf_dir), WEEK, "click").coalesce(1), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@add(
    "metrics_registered",
    "WITH n AS (SELECT o_orderpriority AS name, 'orders' AS unit FROM orders GROUP BY 1), k AS (SELECT DISTINCT event_type AS name FROM events WHERE event_type IN ('click', 'view'))"
    " SELECT name, 'known' AS unit FROM k UNION ALL SELECT lower(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g')), unit FROM n UNION ALL SELECT 'signup', 'orders'",
)
def metrics_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that are added to known ones: the first of a name stays."""
    define = lambda names, unit: names.select(F.lit(0).cast("long").alias("id"), "name", F.lit(unit).alias("unit"), F.lit("custom").alias("category"), F.lit("sum").alias("aggregation"), F.lit("").alias("description"), F.lit(None).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"))
    kinds = points.event_points(spark, sf_dir).select(F.col("metric").alias("name")).distinct()
    known = define(kinds.where("name in ('click', 'view')"), "known")
    new = points.order_points(spark, sf_dir).select(F.col("metric").alias("name")).distinct().union(kinds.where("name in ('click', 'signup')"))
    return points.register(known, define(new, "orders")).select("name", "unit")


@add("definitions_checked", "SELECT p_name AS name, regexp_matches(p_name, '^[A-Za-z0-9_]{1,100}$') AND strlen(p_type) <= 50 AS good FROM part")
def definitions_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names and units of parts may define a metric."""
    return validation.checked_metrics(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("unit"), F.lit("custom").alias("category"), F.lit("sum").alias("aggregation"))).select("name", (F.size("errors") == 0).alias("good"))


@add("ranges_met", f"{P} SELECT metric, count(*) AS n FROM p WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15' GROUP BY metric")
def ranges_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in what a month and a range that is widened by a day share, less all but one day."""
    month, around = TimeRange.month(2024, 1), TimeRange(to_ms(datetime(2023, 12, 1)), to_ms(datetime(2024, 1, 14))).expand(DAY)
    found = month.intersection(around).intersection(TimeRange.day(2024, 1, 14))
    return points.event_points(spark, sf_dir).where(C.in_range(found)).groupBy("metric").agg(F.count("*").alias("n"))


@add("request_auto", f"{P} SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, {near('sum(value)')} AS click FROM p WHERE metric = 'click' AND ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1")
def request_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with relative and written times, whose bucket follows from its range: days, for more than seven of them."""
    request = {"select": ["click"], "time_range": {"start": "now-20d", "end": "2024-01-30T12:00:00Z"}, "group_by": "auto", "aggregation": "sum"}
    found = Query.from_request(request, NOW).run(points.event_points(spark, sf_dir), NOW, KINDS)
    return found.withColumn("click", C.rounded(F.col("click"), 6))


_NAMED = {"click": ("step_count", "health"), "view": ("mood_score", "mood"), "error": ("workout_minutes", "habit"), "purchase": ("reading", "custom"), "signup": ("resting_heart_rate", "health")}


@add(
    "health_categories",
    f"{P} SELECT CASE metric " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in _NAMED.items()) + " END AS metric, CASE metric " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in _NAMED.items()) + " END AS category, count(*) AS n FROM p GROUP BY p.metric",
)
def health_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that the names of metrics tell."""
    names = F.create_map(*[F.lit(x) for k, (n, _) in _NAMED.items() for x in (k, n)])
    own = points.event_points(spark, sf_dir).select(names[F.col("metric")].alias("metric"))
    return own.groupBy("metric", imports.health_category(F.col("metric")).alias("category")).agg(F.count("*").alias("n"))
