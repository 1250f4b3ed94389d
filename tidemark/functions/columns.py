"""Column expressions over points: (metric, ts, value, tags, seq)."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.times import TimeRange, interval_name, to_text

#: Two values closer than this count as equal.
EPSILON = 2.220446049250313e-16

# Comparison signs and names of aggregations, with their synonyms.
COMPARE: dict[str, Callable] = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge,
}
AGGREGATES = ("avg", "sum", "min", "max", "count", "first", "last")
SYNONYMS = {"average": "avg", "mean": "avg"}


def moment(ms: int) -> Column:
    """A literal that is pushed down to the scan of a timestamp without zone."""
    return F.lit(to_text(ms)).cast("timestamp_ntz")


def in_range(span: TimeRange, ts: str = "ts") -> Column:
    """start <= ts < end, on the raw column."""
    return (F.col(ts) >= moment(span.start)) & (F.col(ts) < moment(span.end))


def bucket(interval: str, ts: str = "ts") -> Column:
    """Start of the calendar hour, day, week (from Monday) or month."""
    return F.date_trunc(interval_name(interval), F.col(ts)).cast("timestamp_ntz")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone; no clock change of the session's zone enters."""
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(F.to_date(ts)).cast("long") * 86_400 + of_day) * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def millis(ts: str = "ts") -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down."""
    return F.floor(micros(ts) / 1000)


def value_is(op: str, number: float, value: str = "value") -> Column:
    """A comparison of the value; equality allows for rounding, and a value that is no number satisfies nothing."""
    c, compare = F.col(value), COMPARE[op]
    if compare in (operator.eq, operator.ne):
        near = F.abs(c - F.lit(float(number))) < F.lit(EPSILON)
        test = near if compare is operator.eq else ~near
    else:
        test = compare(c, F.lit(float(number)))
    return test & ~F.isnan(c)


def tag_is(key: str, op: str, text: str, tags: str = "tags") -> Column:
    """A comparison of a tag as text; a missing tag only satisfies !=."""
    test = COMPARE[op](F.col(tags)[key], F.lit(str(text)))
    return F.coalesce(test, F.lit(COMPARE[op] is operator.ne))


def aggregate_name(name: str) -> str:
    found = SYNONYMS.get(name.lower(), name.lower())
    if found not in AGGREGATES:
        raise ValueError(f"not an aggregation: {name!r}")
    return found


def cell(name: str, metric: str | None = None) -> Column:
    """One aggregate over the points of one metric (or of all); without points it is null, counts too."""
    name = aggregate_name(name)
    own = F.lit(True) if metric is None else F.col("metric") == metric
    value, order = F.when(own, F.col("value")), F.when(own, F.struct("ts", "seq"))
    if name == "avg":
        return F.avg(value)
    if name == "sum":
        return F.sum(value)
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(F.when(own & ~F.isnan("value"), F.col("value")))
    if name == "count":
        return F.nullif(F.count(value), F.lit(0)).cast("double")
    return (F.min_by if name == "first" else F.max_by)(value, order)


def rounded(x: Column, places: int) -> Column:
    """Half away from zero, on the binary value; the same in any engine."""
    scale = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def strength(r: Column) -> Column:
    """Name of a correlation's size."""
    size = F.abs(r)
    return F.when(size > 0.7, "strong").when(size > 0.5, "moderate").when(size > 0.3, "weak").otherwise("negligible")


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns from five sums; 0 where a column does not vary."""
    n, sx, sy = F.count(F.col(x)), F.sum(x), F.sum(y)
    top = n * F.sum(F.col(x) * F.col(y)) - sx * sy
    spread = (n * F.sum(F.col(x) * F.col(x)) - sx * sx) * (n * F.sum(F.col(y) * F.col(y)) - sy * sy)
    return F.when(spread > 0, top / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))).otherwise(0.0)
