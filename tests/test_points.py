import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import DAY, TimeRange, to_ms
from tidemark.operators import analysis, insights, lookups, ordered, validation
from tidemark.plans.query import Item, MetricNotFound, Query, series
from tidemark.sinks import export
from tidemark.sources import imports, points
from tidemark.streaming import streams, tables

NOW = to_ms(datetime(2024, 1, 31))


def frame(spark, rows):
    """rows: metric, time text, value, tags; numbered in order."""
    made = [(m, datetime.fromisoformat(t), float(v), g, i) for i, (m, t, v, g) in enumerate(rows)]
    return spark.createDataFrame(made, points.SCHEMA)


def values(df):
    return [tuple(r) for r in df.collect()]


def test_calendar_buckets(spark):
    days = ["2024-01-15 14:35:42", "2024-01-17 14:35:42", "2024-02-29 23:59:59", "2024-12-31 00:00:00"]
    own = frame(spark, [("m", d, 1, {}) for d in days])
    week = [r[0] for r in own.orderBy("seq").select(C.bucket("week")).collect()]
    month = [r[0] for r in own.orderBy("seq").select(C.bucket("month")).collect()]
    assert week == [datetime(2024, 1, 15), datetime(2024, 1, 15), datetime(2024, 2, 26), datetime(2024, 12, 30)]
    assert month == [datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 12, 1)]


def test_hourly_average_and_missing_cells(spark):
    own = frame(spark, [("a", "2024-01-20 01:10", 5, {}), ("a", "2024-01-20 01:20", 6, {}), ("a", "2024-01-20 01:59", 7, {}), ("b", "2024-01-20 02:00", 9, {})])
    found = Query.select(Item("a", "avg"), Item("b", "count", "n")).last_days(30).group_by("hour").run(own, NOW)
    assert values(found) == [(datetime(2024, 1, 20, 1), 6.0, None), (datetime(2024, 1, 20, 2), None, 1.0)]


def test_first_last_ties_go_by_sequence(spark):
    own = frame(spark, [("a", "2024-01-20 01:00", 1, {}), ("a", "2024-01-20 01:00", 2, {}), ("a", "2024-01-20 01:00", 3, {})])
    found = Query.select(Item("a", "first", "f"), Item("a", "last", "l"), Item("a", None, "d")).last_days(30).group_by("day").run(own, NOW)
    assert values(found) == [(datetime(2024, 1, 20), 1.0, 3.0, 3.0)]


def test_range_is_half_open_and_ranges_meet(spark):
    own = frame(spark, [("a", f"2024-01-20 00:00:0{i}", i, {}) for i in range(5)])
    start = to_ms(datetime(2024, 1, 20))
    query = Query.select("a").time_range(TimeRange(start + 1000, start + 4000)).time_range(TimeRange(start, start + 3000))
    assert [r[1] for r in values(query.run(own, NOW))] == [1.0, 2.0]
    with pytest.raises(ValueError):
        query.time_range(TimeRange(start + 3000, start + 4000))


def test_tag_and_value_predicates(spark):
    own = frame(spark, [("a", "2024-01-30 00:00:00", 0.1 + 0.2, {"p": "home"}), ("a", "2024-01-30 00:00:01", math.nan, {"p": ""}), ("a", "2024-01-30 00:00:02", 4, {})])
    run = lambda q: [r[1] for r in values(q.run(own, NOW))]
    every = Query.select("a")
    assert run(every.where_value("=", 0.3)) == [0.1 + 0.2]
    assert run(every.where_value("!=", 0.3)) == [4.0]
    assert len(run(every.where_tag("p", "!=", "home"))) == 2
    assert run(every.where_tag("p", "=", "home")) == [0.1 + 0.2]
    assert run(every.where_tag("p", "<", "a").where_value(">", 1)) == []


def test_limit_keeps_the_oldest(spark):
    own = frame(spark, [("a", f"2024-01-30 00:{i:02d}:00", i, {}) for i in range(59, -1, -1)])
    assert [r[1] for r in values(Query.select("a").limit(3).run(own, NOW))] == [0.0, 1.0, 2.0]
    assert values(Query.select("a").limit(0).run(own, NOW)) == []


def test_row_mode_joins_equal_times(spark):
    own = frame(spark, [("a", "2024-01-30 00:00", 7, {}), ("b", "2024-01-30 00:00", 6, {}), ("b", "2024-01-30 00:01", 5, {}), ("a", "2024-01-30 00:00", 8, {})])
    found = Query.select("a", "b").run(own, NOW)
    assert values(found) == [(datetime(2024, 1, 30), 7.0, 6.0), (datetime(2024, 1, 30, 0, 1), None, 5.0)]
    assert values(series(found)) == [(datetime(2024, 1, 30), 7.0)]


def test_names(spark):
    own = frame(spark, [("a", "2024-01-30 00:00", 7, {})])
    with pytest.raises(ValueError, match="alias"):
        Query.select(Item("a", "min"), Item("a", "max")).run(own, NOW)
    with pytest.raises(MetricNotFound):
        Query.select("nope").run(own, NOW, ["a"])
    assert Query.select("*").group_by("day").run(own, NOW, ["b", "a"]).columns == ["bucket", "a", "b"]
    assert values(Query.select(Item("a", "sum"), Item("a", "count", "n")).run(own, NOW)) == [(7.0, 1.0)]


def test_request(spark):
    own = frame(spark, [("a", "2024-01-30 00:00", 7, {"k": "5"}), ("a", "2024-01-30 00:01", 9, {"k": "6"})])
    query = Query.from_request({"select": ["a"], "time_range": {"start": "now-3d", "end": "now"}, "group_by": "d", "aggregation": "average", "filters": [{"tag": "k", "op": "=", "value": 5}], "limit": 1}, NOW)
    assert values(query.run(own, NOW)) == [(datetime(2024, 1, 30), 7.0)]
    with pytest.raises(ValueError):
        Query.from_request({"select": []}, NOW)


def test_time_and_metric_reach_the_scan(spark, sf_dir):
    found = Query.select("click").group_by("day").aggregate("avg").run(points.event_points(spark, sf_dir), NOW)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize(("ys", "r"), [([2, 4, 6, 8, 10], 1.0), ([10, 8, 6, 4, 2], -1.0), ([3, 3, 3, 3, 3], 0.0)])
def test_pearson(spark, ys, r):
    own = spark.createDataFrame([(float(x), float(y)) for x, y in zip(range(1, 6), ys, strict=True)], "x double, y double")
    assert own.agg(C.pearson("x", "y")).first()[0] == pytest.approx(r)


def test_correlation_gates(spark):
    rows = [(m, f"2024-01-{d:02d} 05:00", v(d), {}) for d in range(1, 8) for m, v in (("a", float), ("b", lambda d: -2.0 * d), ("c", lambda d: 1.0))]
    rows += [("d", f"2024-01-{d:02d} 05:00", d, {}) for d in range(1, 7)]
    found = values(analysis.correlations(analysis.daily_means(frame(spark, rows))))
    assert found == [("a", "b", -1.0, "strong", "negative", 7)]


def test_rounding_and_strength(spark):
    own = spark.createDataFrame([(0.285,), (-0.285,), (0.3001,), (0.8,), (-0.6,)], "r double")
    assert [r[0] for r in own.select(C.rounded(F.col("r"), 2)).collect()] == [0.28, -0.28, 0.3, 0.8, -0.6]
    assert [r[0] for r in own.select(C.strength(F.col("r"))).collect()] == ["negligible", "negligible", "weak", "strong", "moderate"]


@pytest.mark.parametrize(("n", "trend"), [(3, None), (4, 2.0), (5, 2.5)])
def test_trend_halves(spark, n, trend):
    own = frame(spark, [("a", f"2024-01-{d:02d} 05:00", d, {}) for d in range(1, n + 1)])
    assert analysis.trends(analysis.daily_means(own)).first()["trend"] == trend


def test_cards_and_sparkline_of_a_flat_metric(spark):
    daily = analysis.daily_means(frame(spark, [("a", f"2024-01-{d:02d} 05:00", 4, {}) for d in range(1, 10)]))
    card = analysis.metric_cards(daily).first()
    assert (card["arrow"], card["low"], card["high"]) == ("flat", 3.0, 5.0)
    assert [r["height"] for r in analysis.sparklines(daily).collect()] == [20] * 7


def test_as_of_over_days(spark):
    own = frame(spark, [("m", "2024-01-01 10:00", 1, {}), ("m", "2024-01-01 12:00", 2, {}), ("m", "2024-01-05 09:00", 3, {})])
    probes = spark.createDataFrame([(i, datetime.fromisoformat(t), "m") for i, t in enumerate(["2024-01-01 09:00", "2024-01-01 12:00", "2024-01-03 00:00", "2024-01-05 08:00", "2024-01-06 00:00"])], "id long, ts timestamp_ntz, metric string")
    found = sorted((r["id"], r["found_value"]) for r in ordered.as_of(probes, own, "metric").collect())
    assert found == [(0, None), (1, 2.0), (2, 2.0), (3, 2.0), (4, 3.0)]


def test_lookups(spark):
    own = frame(spark, [("m", "2024-01-01 10:00", 1, {"a": "x", "b": "1"}), ("m", "2024-01-01 12:00", 2, {"a": "y"}), ("n", "2024-01-05 09:00", 3, {})])
    assert [r["seq"] for r in lookups.floor_points(own, to_ms(datetime(2024, 1, 1, 11))).collect()] == [0]
    assert sorted(r["seq"] for r in lookups.ceiling_points(own, to_ms(datetime(2024, 1, 1, 11))).collect()) == [1, 2]
    assert lookups.any_tag(own, "a", ["x", "y"]).count() == 2 and lookups.all_tags(own, {"a": "x", "b": "1"}).count() == 1
    assert values(lookups.tag_keys(own).orderBy("key")) == [("a", 2, 2), ("b", 1, 1)]
    metrics = points.metric_table(spark, [(0, "m", "", "mood", "sum", "", None, None)])
    assert lookups.of_category(own, metrics, "mood").count() == 2
    assert points.register(metrics, points.metric_table(spark, [(1, "m", "u", "health", "sum", "", None, None), (2, "n", "", "mood", "max", "", None, None)])).count() == 2


def test_validation(spark):
    own = frame(spark, [("m", "2024-01-01 10:00", 1, {}), ("", "2024-01-01 10:00", math.inf, {}), ("m" * 101, "1999-01-01 10:00", 1, {"": "x"}), ("m", "2024-01-01 10:00", 1, {"k": "é" * 101})])
    errors = {r["seq"]: r["errors"] for r in validation.rejected(own, NOW).collect()}
    assert errors == {1: ["metric_empty", "value_not_finite"], 2: ["metric_long", "time_out_of_range", "tag_key"], 3: ["tag_value"]}
    assert validation.accepted(own, NOW).count() == 1
    validation.check_metric("a_1", "kg", "Health", "sum")
    for bad in (("a b", "", "health", "sum"), ("a", "", "pets", "sum"), ("a", "x" * 51, "health", "sum")):
        with pytest.raises(ValueError):
            validation.check_metric(*bad)


def test_csv(spark):
    lines = ["date,Mood,Deep Work", "2024-01-15,7.5,6.0", "01/02/2024,,7", "13/02/2024,x,5", "2024-01-17T10:00:00Z,8", "nonsense,1,1"]
    found = imports.csv_points(spark.createDataFrame([(x,) for x in lines], "line string"), lines[0])
    assert sorted(values(found)) == [
        ("deep_work", datetime(2024, 1, 2, 12), 7.0), ("deep_work", datetime(2024, 1, 15, 12), 6.0), ("deep_work", datetime(2024, 2, 13, 12), 5.0),
        ("mood", datetime(2024, 1, 15, 12), 7.5), ("mood", datetime(2024, 1, 17, 10), 8.0),
    ]
    with pytest.raises(ValueError):
        imports.csv_columns("a,b")


def test_health(spark):
    lines = ['<Record type="HKQuantityTypeIdentifierVO2Max" startDate="2024-01-15 08:00:00 +0100" value="40.5"/>', '<Record type="HKCategoryTypeIdentifierSleepAnalysis" startDate="2024-01-15" value="Asleep"/>', "<Other/>", '<Record type="HKQuantityTypeIdentifierStepCount" unit="count" startDate="2024-01-15" value="12"/>']
    found = sorted(values(imports.health_points(spark.createDataFrame([(x,) for x in lines], "line string")).select("metric", "ts", "value", "unit")))
    assert found == [("steps", datetime(2024, 1, 15), 12.0, "count"), ("v_o2_max", datetime(2024, 1, 15, 7), 40.5, "")]
    names = spark.createDataFrame([("workout",), ("heart_rate",), ("zzz",)], "m string").select(imports.health_category(F.col("m")))
    assert [r[0] for r in names.collect()] == ["habit", "health", "custom"]


def test_repository_and_activity(spark):
    lines = [
        '{"type":"PushEvent","created_at":"2024-01-15T08:00:00Z","payload":{"commits":[{"sha":"a"},{"sha":"b"}]}}',
        '{"type":"PullRequestEvent","created_at":"2024-01-15T09:00:00Z","payload":{"action":"closed","pull_request":{"merged":true}}}',
        '{"type":"PullRequestEvent","created_at":"2024-01-15T09:00:00Z","payload":{"action":"closed","pull_request":{"merged":false}}}',
        '{"type":"PushEvent","created_at":"bad","payload":{"commits":[{"sha":"a"}]}}',
    ]
    found = sorted(values(imports.repository_points(spark.createDataFrame([(x,) for x in lines], "line string"))))
    assert found == [("commits", datetime(2024, 1, 15, 12), 2.0), ("prs_merged", datetime(2024, 1, 15, 12), 1.0)]
    days = ['{"date":"2024-01-15","summary":{"steps":10,"caloriesOut":20,"veryActiveMinutes":3,"totalMinutesAsleep":450}}']
    found = sorted(values(imports.activity_points(spark.createDataFrame([(x,) for x in days], "line string"))))
    assert found == [("active_minutes", datetime(2024, 1, 15, 12), 3.0), ("calories_burned", datetime(2024, 1, 15, 12), 20.0), ("sleep_hours", datetime(2024, 1, 15, 6), 7.5), ("steps", datetime(2024, 1, 15, 12), 10.0)]


def test_exports(spark, tmp_path):
    own = frame(spark, [("m", "2024-01-01 10:00:00.778549", 1, {"z": 'q"', "a": "x"}), ("n", "2024-01-01 12:00", 2, {})])
    rows = export.export_rows(own, TimeRange.month(2024, 1))
    assert values(rows.orderBy("timestamp")) == [(1704103200778, "m", 1.0, '{"a":"x","z":"q\\""}'), (1704110400000, "n", 2.0, "{}")]
    export.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r["tags"] for r in back.collect()) == ['{"a":"x","z":"q\\""}', "{}"]
    export.write_points(own, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 2
    wide = Query.select("m", "n").time_range(TimeRange.month(2024, 1)).group_by("hour").aggregate("avg").run(own, NOW)
    assert [r["value"] for r in export.chart_rows(wide).collect()] == [1.0, 0.0, 0.0, 2.0]
    assert '"n"' not in export.json_rows(wide).first()["json"]
    assert export.text_rows(wide).first()["n"] == "-"


def test_insights():
    found = insights.explain("Why is my mood low?", {"mood": 4.2, "sleep_hours": 6.0}, {"mood": -0.8, "sleep_hours": 0.0})
    assert "low" in found.text and "Going down: mood." in found.text and found.data == {"mood": 4.2} and "get more sleep first" in found.advice
    assert "1 metrics" in insights.explain("hello", {"x": 1.0}, {}).text
    assert "Improving: x." in insights.explain("any trend?", {"x": 1.0}, {"x": 0.5}).text


def test_topics():
    assert [streams.valid_topic(t) for t in ("metrics.mood", "metrics.*", "category.health", "insights", "system", "invalid", "", "random.topic")] == [True] * 5 + [False] * 3


def test_empty_points(spark):
    own = spark.createDataFrame([], points.SCHEMA)
    assert values(Query.select("a").group_by("day").run(own, NOW)) == []
    assert values(analysis.correlations(analysis.daily_means(own))) == []
    assert validation.rejected(own, NOW).count() == 0 and NOW % DAY == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_stream_buckets_in_other_zones(spark, sf_dir, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    wanted = {(r["bucket"], r["metric"]): r["n"] for r in points.event_points(spark, sf_dir).groupBy(C.bucket("week").alias("bucket"), "metric").agg(F.count("*").alias("n")).collect()}
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for interval in ("week", "hour"):
            stream = streams.event_stream(spark, f"{sf_dir}/events.parquet*")
            found = tables.run_to_table(streams.bucketed(stream, interval), "complete").collect()
            if interval == "week":
                assert {(r["bucket"], r["metric"]): r["n"] for r in found} == wanted
            assert all(r["bucket"].minute == 0 for r in found)
        odd = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "ts timestamp_ntz").select(streams.zone_free(streams.instant()).alias("t")).first()
        assert odd["t"] == datetime(2024, 3, 10, 2, 30)  # an hour that New York skips
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_named_stream_goes_on(spark, tmp_path):
    own = frame(spark, [("a", "2024-01-20 01:00", i, {}) for i in range(4)])
    own.where("seq < 2").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    name, seen = f"test-{tmp_path.name}-{id(own)}", []

    def batch(rows):
        seen.append(sorted(r["seq"] for r in rows.collect()))
        return rows

    assert tables.run_to_table(read(), batch=batch, name=name).count() == 2
    own.where("seq >= 2").write.mode("append").parquet(str(tmp_path / "in"))
    assert tables.run_to_table(read(), batch=batch, name=name).count() == 4
    assert [x for x in seen if x] == [[0, 1], [2, 3]]


def test_windows_reach_over_days_without_points(spark):
    own = frame(spark, [("a", f"2024-01-{d:02d} 0{h}:00", 10 * d + h, {}) for d, h in ((1, 0), (1, 1), (2, 0), (5, 0), (5, 1), (6, 0), (9, 3), (9, 4), (20, 0))])
    rows = sorted(own.collect(), key=lambda r: r["ts"])
    mean = {r["seq"]: r["moving_avg"] for r in ordered.running(own, 3).collect()}
    gap = {r["seq"]: r["delta_ms"] for r in ordered.deltas(own).collect()}
    for i, r in enumerate(rows):
        near = [x["value"] for x in rows[max(0, i - 3) : i + 1]]
        assert mean[r["seq"]] == pytest.approx(sum(near) / len(near))
        assert gap[r["seq"]] == (0 if not i else (r["ts"] - rows[i - 1]["ts"]).total_seconds() * 1000)


def test_time_conditions(spark):
    own = frame(spark, [("a", f"2024-01-20 00:00:0{i}", i, {}) for i in range(5)])
    at = to_ms(datetime(2024, 1, 20)) + 2000
    run = lambda *tests: [r[1] for r in values(next(iter([_with(tests)])).run(own, NOW))]

    def _with(tests):
        query = Query.select("a")
        for op, ms in tests:
            query = query.where_time(op, ms)
        return query

    assert run(("gt", at)) == [3, 4] and run((">=", at)) == [2, 3, 4] and run(("<=", at)) == [0, 1, 2] and run(("=", at)) == [2]
    assert run((">=", at - 1000), ("<", at + 1000)) == [1, 2]
    with pytest.raises(ValueError):
        Query.select("a").where_time("!=", at)


def test_several_records_on_one_line_and_entities(spark):
    record = '<Record type="HKQuantityTypeIdentifierHeartRate" sourceName="{}" startDate="2024-01-15 10:00:00 +0100" value="{}"/>'
    lines = spark.createDataFrame([(record.format("A &amp; B &gt; C", 60) + record.format("x > y", 61) + "<Workout/>",), ("nothing",), (None,)], "line string")
    found = sorted((r["value"], r["source"], r["ts"]) for r in imports.health_points(lines).collect())
    assert found == [(60.0, "A & B > C", datetime(2024, 1, 15, 9)), (61.0, "x > y", datetime(2024, 1, 15, 9))]


def test_broken_archives_give_nothing(spark):
    rows = spark.createDataFrame([("bm90IGEgemlw",), (None,), ("%%%",)], "archive string")
    assert imports.health_archives(rows).count() == 0


def test_csv_with_separator_and_report(spark):
    lines = spark.createDataFrame([(0, '"The date";"a;b";c'), (1, "2024-01-15;1;2"), (2, "2024-01-16;;3"), (3, "never;1;1"), (4, "")], "n long, line string")
    header = '"The date";"a;b";c'
    found = sorted((r["metric"], r["value"]) for r in imports.csv_points(lines, header, separator=";").collect())
    assert found == [("a;b", 1.0), ("c", 2.0), ("c", 3.0)]
    report = imports.csv_report(lines, header, "n", separator=";", listed=1).first()
    assert tuple(report) == (4, 3, 2, ["row 3: not a time: never"], 1)
    assert imports.csv_points(lines, header, separator=";", only=["c"]).count() == 2


def test_insights_at_the_edges_of_bands():
    text = lambda v: insights.explain("mood and sleep", {"mood": v, "sleep": v}, {}).text
    assert "moderate" in text(7.0) and "positive" in text(7.0000005) and "positive" in text(120.0)
    assert "healthy" in text(8.5) and "plenty" in text(8.5000005) and "plenty" in text(99.0)


def test_sources_by_name(spark):
    lines = spark.createDataFrame([('{"date":"2024-01-15","summary":{"steps":5}}',), ('{"date":"2024-01-17","summary":{"steps":7}}',)], "line string")
    found = imports.sync("activity", lines, C.moment(to_ms(datetime(2024, 1, 16))))
    assert {(r["metric"], r["value"]) for r in found.collect()} == {("steps", 7.0), ("active_minutes", 0.0)}
    with pytest.raises(ValueError):
        imports.sync("none", lines)
