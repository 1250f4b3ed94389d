"""Queries over points, put together with a fluent builder and turned into one DataFrame.

    Query.select("click", "view").last_days(7).group_by("day").aggregate("avg").run(points, now_ms)

A query is a scan with pushed-down time and metric predicates, tag and value predicates, then either one hash aggregation
with a conditional cell for each item, or a pivot of rows that share a time; results are ordered by time,
oldest first, and a limit keeps the oldest.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import REQUEST_UNITS, TimeRange, auto_interval, interval_name, parse_time, to_ms


#: The times that a condition without the other end reaches to.
EARLIEST, LATEST = to_ms(datetime(1, 1, 1)), to_ms(datetime(9999, 12, 31))


class MetricNotFound(ValueError):
    """A metric that the registry does not hold."""


@dataclass(frozen=True)
class Item:
    """A metric of the result, its aggregation (none: the last value) and its name."""

    metric: str
    aggregation: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.metric


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...] = ()
    span: TimeRange | None = None
    last: tuple[int, int, int] | None = None
    interval: str | None = None
    tests: tuple[tuple, ...] = field(default=())
    rows: int | None = None

    @classmethod
    def select(cls, *items: str | Item) -> Query:
        return cls(tuple(i if isinstance(i, Item) else Item(i) for i in items))

    def time_range(self, span: TimeRange) -> Query:
        """Keep [start, end); several ranges are intersected."""
        span = span if self.span is None else self.span.intersection(span)
        if span is None:
            raise ValueError("the time ranges do not meet")
        return replace(self, span=span)

    def where_time(self, op: str, at_ms: int) -> Query:
        """A condition on the time, exact to the millisecond; several are intersected, and with ranges, too."""
        spans = {"eq": (at_ms, at_ms + 1), "ge": (at_ms, LATEST), "gt": (at_ms + 1, LATEST), "lt": (EARLIEST, at_ms), "le": (EARLIEST, at_ms + 1)}
        kind = C.COMPARE[op].__name__
        if kind not in spans:
            raise ValueError(f"not a condition on the time: {op}")
        return self.time_range(TimeRange(*spans[kind]))

    def last_days(self, n: int) -> Query:
        return replace(self, last=(n, 0, 0))

    def last_hours(self, n: int) -> Query:
        return replace(self, last=(0, n, 0))

    def last_minutes(self, n: int) -> Query:
        return replace(self, last=(0, 0, n))

    def group_by(self, interval: str) -> Query:
        return replace(self, interval=interval_name(interval))

    def aggregate(self, name: str) -> Query:
        """One aggregation for all items."""
        return replace(self, items=tuple(replace(i, aggregation=C.aggregate_name(name)) for i in self.items))

    def where_tag(self, key: str, op: str, text: str) -> Query:
        return replace(self, tests=(*self.tests, ("tag", key, op, text)))

    def where_value(self, op: str, number: float) -> Query:
        return replace(self, tests=(*self.tests, ("value", op, number)))

    def limit(self, n: int) -> Query:
        return replace(self, rows=n)

    @classmethod
    def from_request(cls, request: Mapping, now_ms: int) -> Query:
        """A query from a request: select, time_range{start,end}, group_by (or auto), aggregation, filters, limit."""
        if not request.get("select"):
            raise ValueError("select is empty")
        query, group = cls.select(*request["select"]), request.get("group_by")
        if span := request.get("time_range"):
            bounds = TimeRange(*(parse_time(span[k], now_ms, REQUEST_UNITS) for k in ("start", "end")))
            query = query.time_range(bounds)
            group = auto_interval(bounds.start, bounds.end) if group == "auto" else group
        query = query.group_by(group) if group else query
        query = query.aggregate(request["aggregation"]) if request.get("aggregation") else query
        for f in request.get("filters", ()):
            query = query.where_tag(f["tag"], f["op"], str(f["value"]))
        return query if request.get("limit") is None else query.limit(request["limit"])

    def predicates(self, now_ms: int) -> list[Column]:
        days, hours, minutes = self.last or (7, 0, 0)
        span = self.span or TimeRange.last(now_ms, days, hours, minutes)
        made = {"tag": C.tag_is, "value": C.value_is}
        return [C.in_range(span), *(made[kind](*rest) for kind, *rest in self.tests)]

    def run(self, points: DataFrame, now_ms: int, metrics: list[str] | None = None) -> DataFrame:
        """The result: the time (bucket or ts; none for one global row) and a nullable column for each item.

        A metric that is not among `metrics`, or without them one that has no point at any time, is an error; where there are no points at all, none is known to be wrong.
        """
        items = self.items
        if [i.metric for i in items] == ["*"]:
            if metrics is None:
                raise ValueError("select * needs the names of the metrics")
            items = tuple(Item(m, items[0].aggregation) for m in sorted(metrics))
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise ValueError(f"two items have one name; give an alias: {names}")
        wanted = sorted({i.metric for i in items})
        known = set(metrics) if metrics is not None else {m for m in wanted if not points.where(F.col("metric") == m).isEmpty()}
        unknown = [m for m in wanted if m not in known]
        if unknown and (metrics is not None or not points.isEmpty()):
            raise MetricNotFound(", ".join(unknown))
        chosen = points.where(F.col("metric").isin(sorted({i.metric for i in items}))).where(reduce(lambda a, b: a & b, self.predicates(now_ms)))
        if self.interval:
            cells = [C.cell(i.aggregation or "last", i.metric).alias(i.name) for i in items]
            out = chosen.groupBy(C.bucket(self.interval).alias("bucket")).agg(*cells).orderBy("bucket")
        elif any(i.aggregation for i in items):
            out = chosen.agg(*[C.cell(i.aggregation or "last", i.metric).alias(i.name) for i in items])
        else:
            first = [F.min_by(F.when(F.col("metric") == i.metric, F.col("value")), F.when(F.col("metric") == i.metric, F.col("seq"))).alias(i.name) for i in items]
            out = chosen.groupBy("ts").agg(*first).orderBy("ts")
        return out if self.rows is None else out.limit(self.rows)


def last_days(metric: str, n: int) -> Query:
    """One metric's rows over the last days."""
    return Query.select(metric).last_days(n)


def daily_average(metric: str, n: int) -> Query:
    """One metric's daily means over the last days."""
    return Query.select(metric).last_days(n).group_by("day").aggregate("avg")


def series(result: DataFrame) -> DataFrame:
    """The first item of a result as (time, value), without the times that lack it."""
    time, first = result.columns[:2]
    return result.select(F.col(time).alias("time"), F.col(first).alias("value")).where("value is not null")
