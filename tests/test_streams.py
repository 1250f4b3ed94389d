"""Tables of streams and subscriptions that change."""

import os
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources.points import metric_table
from tidemark.streaming import streams, subscriptions, tables

START = datetime(2024, 1, 1)
POINTS = "metric string, ts timestamp_ntz, value double, seq long"


def put(spark, rows, folder, kinds=POINTS):
    """One more file in the folder."""
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(folder))


def read(spark, folder, kinds=POINTS):
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder))


def some(first, n):
    return [("m" if i % 2 else "n", START + timedelta(hours=i), float(i), i) for i in range(first, first + n)]


def daily(stream):
    return stream.groupBy(F.date_trunc("day", "ts").alias("day"), "metric").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_stopped_and_started_again(spark, tmp_path, mode):
    """Standing, stopped, more rows, a batch that is killed half-way, started again: every row counts once."""
    folder = tmp_path / "in"
    put(spark, some(0, 30), folder)
    broken = [False]

    def batch(rows):
        if broken[0]:
            raise RuntimeError("killed")
        return rows

    source = lambda: read(spark, folder) if mode == "append" else daily(read(spark, folder))
    kept = tables.stream_table(source(), mode, batch, f"again-{os.getpid()}-{mode}", ("day", "metric"))
    assert kept.rows().count() == 0
    query = kept.start(source(), every="50 milliseconds")
    query.processAllAvailable()
    put(spark, some(30, 20), folder)
    query.processAllAvailable()
    tables.stop(query)
    broken[0] = True
    put(spark, some(50, 10), folder)
    query = kept.start(source())
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    broken[0] = False
    kept.start(source()).awaitTermination()
    kept.start(source()).awaitTermination()  # nothing new
    every = spark.createDataFrame(some(0, 60), POINTS)
    wanted = every if mode == "append" else daily(every)
    assert sorted(map(tuple, kept.rows().collect())) == sorted(map(tuple, wanted.select(kept.rows().columns).collect()))
    if mode == "complete":
        assert len(kept.batches()) == 1


def test_without_files_and_compacted(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for mode in ("append", "complete"):
        made = read(spark, tmp_path / "none") if mode == "append" else daily(read(spark, tmp_path / "none"))
        assert tables.run_to_table(made, mode).count() == 0
    with pytest.raises(ValueError, match="keys"):
        tables.stream_table(read(spark, tmp_path / "none"), "update")
    for k in range(4):
        put(spark, some(5 * k, 5), tmp_path / "in")
    kept = tables.stream_table(read(spark, tmp_path / "in"))
    kept.start(read(spark, tmp_path / "in")).awaitTermination()
    assert len(kept.batches()) == 4
    kept.compact()
    assert len(kept.batches()) == 1 and kept.rows().count() == 20
    put(spark, some(20, 5), tmp_path / "in")
    kept.start(read(spark, tmp_path / "in")).awaitTermination()
    assert sorted(r["seq"] for r in kept.rows().collect()) == list(range(25))


ASKED = "subscriber string, topic string, ts timestamp_ntz, action string, lease interval day to second"


def wanted(points, asked, categories, until):
    """By the rule, from all rows in order of time."""
    out = set()
    for metric, ts, value, seq in points:
        if ts >= until:
            continue
        for who in {a[0] for a in asked}:
            for topic in {f"metrics.{metric}", "metrics.*", f"category.{categories.get(metric, 'custom')}", "category.*"}:
                mine = sorted((a[2], a[3] == "subscribe", a[4]) for a in asked if a[:2] == (who, topic) and a[2] <= ts)
                end = datetime.min
                for at, begins, lease in mine:
                    end = max(end if end > at else datetime.min, at + lease if lease else datetime.max) if begins else datetime.min
                if end > ts:
                    out.add((who, f"metrics.{metric}", ts, value, seq))
    return sorted(out)


def test_subscriptions_come_and_go(spark, tmp_path):
    """Random requests in several files, within the delay out of order; equal instants; a lease; renewals; several matching topics."""
    rnd = random.Random(11)
    metrics = [(0, "click", "", "productivity", "sum", "", 0.0, None), (1, "error", "", "health", "sum", "", 0.0, None)]
    at = lambda: START + timedelta(minutes=30 * rnd.randint(0, 199))
    points = [(rnd.choice(["click", "error", "odd"]), at(), float(i), i) for i in range(300)]
    topics = ["metrics.click", "metrics.*", "category.custom", "category.*", "metrics.odd"]
    asked = [(f"s{rnd.randint(0, 3)}", rnd.choice(topics), at(), rnd.choice(["subscribe", "subscribe", "unsubscribe"]), rnd.choice([None, timedelta(hours=3), timedelta(days=1)])) for i in range(60)]
    edge = START + timedelta(hours=98, minutes=30)
    for rows, name, kinds, tick in ((points, "points", POINTS, ("tick", edge + timedelta(hours=9), 0.0, 10**6)), (asked, "asked", ASKED, ("x", "metrics.x", edge + timedelta(hours=9), "unsubscribe", None))):
        rows.sort(key=lambda r: r[1] if isinstance(r[1], datetime) else r[2])
        third = len(rows) // 3
        put(spark, rows[:third][::-1], tmp_path / name, kinds)
        put(spark, rows[third:], tmp_path / name, kinds)
        put(spark, [tick], tmp_path / name, kinds)
    categories = metric_table(spark, metrics)
    made = subscriptions.deliveries(read(spark, tmp_path / "points"), read(spark, tmp_path / "asked", ASKED), categories, shards=3, delay="200 hours")
    with subscriptions.rocksdb(spark):
        found = tables.run_to_table(made)
    assert found.count() == 0  # the watermark has passed nothing
    made = subscriptions.deliveries(read(spark, tmp_path / "points"), read(spark, tmp_path / "asked", ASKED), categories, shards=3, delay="9 hours")
    for name in ("points", "asked"):
        assert spark.read.parquet(str(tmp_path / name)).count() > 60
    with subscriptions.rocksdb(spark):
        found = tables.run_to_table(made)
    have = sorted(map(tuple, found.collect()))
    assert have == wanted(points, asked, {"click": "productivity", "error": "health"}, edge) and have


class Kept(dict):
    """Map state that counts its calls."""

    calls = 0

    def getValue(self, k):
        Kept.calls += 1
        return self[k]

    def updateValue(self, k, v):
        Kept.calls += 1
        self[k] = v

    removeKey = dict.__delitem__
    iterator = dict.items


class Handle(set):
    """State of one shard, in memory; the set holds its timers."""

    def getMapState(self, name, *kinds):
        return Kept()

    listTimers, registerTimer, deleteTimer = set.copy, set.add, set.remove


@pytest.mark.parametrize(("at_once", "batch", "out"), [(500_000, 50_000, 1_000_000), (40, 7, 30)])
def test_deliveries_take_many_rows_at_once(monkeypatch, at_once, batch, out):
    """Rows wait as batches; taken in parts, over several watermarks, also before 1970, they give what the rule says."""
    for k, v in (("AT_ONCE", at_once), ("BATCH", batch), ("OUT_AT_ONCE", out)):
        monkeypatch.setattr(subscriptions, k, v)
    monkeypatch.setattr(Kept, "calls", 0)
    rnd = random.Random(4)
    start = datetime(1969, 12, 30)
    at = lambda: start + timedelta(minutes=30 * rnd.randint(0, 199))
    us = lambda x: (x - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    points = [(rnd.choice(["click", "odd"]), at(), float(i), i) for i in range(900)]
    topics = ["metrics.click", "metrics.*", "category.custom", "category.*", "metrics.odd", "metrics.none"]
    asked = [(f"s{rnd.randint(0, 3)}", rnd.choice(topics), at(), rnd.choice(["subscribe", "subscribe", "unsubscribe"]), rnd.choice([None, timedelta(hours=3), timedelta(hours=9)])) for _ in range(80)]
    categories = {"click": "productivity"}
    rows = [(us(t), subscriptions.POINT, "", f"metrics.{m}", 0, f"category.{categories.get(m, 'custom')}", v, n) for m, t, v, n in points]
    rows += [(us(t), subscriptions.SUBSCRIBE if a == "subscribe" else subscriptions.UNSUBSCRIBE, s, topic, lease // timedelta(microseconds=1) if lease else subscriptions.FOREVER, "", 0.0, -1) for s, topic, t, a, lease in asked]
    rows.sort(key=lambda r: r[0] + rnd.randint(0, 20) * 3_600_000_000)  # out of order by up to 20 hours
    made, handle, shard = [], Handle(), subscriptions.Deliveries()
    shard.init(handle)
    names = [x.split()[0] for x in subscriptions.ROW.split(", ")]
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    mark = us(start) // 1000
    for a in range(0, len(rows), 100):
        frames = [pd.DataFrame(rows[k : k + 25], columns=names) for k in range(a, min(a + 100, len(rows)), 25)]
        made += shard.handleInputRows((0,), iter(frames), clock(mark))
        mark = max(mark, min((r[0] for r in rows[a + 100 :]), default=us(start + timedelta(hours=90))) // 1000)
    assert len(handle) == 1 and min(handle) > us(start) // 1000
    edge = start + timedelta(hours=90)
    made += shard.handleExpiredTimer((0,), clock(us(edge) // 1000), None)
    have = sorted(map(tuple, pd.concat(made)[["subscriber", "topic", "at", "value", "seq"]].itertuples(index=False)))
    assert have == wanted(points, asked, categories, edge) and have
    assert sum(r[0] >= us(edge) for r in rows) > 0 and handle == {min(r[0] for r in rows if r[0] >= us(edge)) // 1000 + 1}
    if batch > 7:
        assert Kept.calls < len(rows) / 2


def test_zones(spark):
    assert streams.valid_topic("metrics.click") and not streams.valid_topic("metrics.")
