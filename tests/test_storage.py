"""Stores: tests on tags reach the scan, removal touches only its days, compaction, sketches, JSON arrays."""

import json
import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import TimeRange, to_ms
from tidemark.plans.query import MetricNotFound, Query
from tidemark.sinks import export, storage

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"m{i % 3}", START + timedelta(hours=i), float(i), {"k": str(i % 50), "user": str(i % 7), "odd": "x" if i % 2 else None}, i) for i in range(240)]
    return spark.createDataFrame(rows, "metric string, ts timestamp_ntz, value double, tags map<string,string>, seq long").cache()


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def same(a, b):
    show = lambda x: sorted((r["seq"], r["metric"], r["ts"], r["value"], tuple(sorted((k, v) for k, v in r["tags"].items() if v is not None))) for r in x.collect())
    return show(a) == show(b)


def test_a_tag_reaches_the_scan(spark, points, tmp_path):
    path = str(tmp_path / "s")
    storage.store_points(points, path, tags=("k", "absent"))
    stored = storage.stored_points(spark, path)
    found = storage.with_tag(stored, "k", ["7"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag_k,7)" in plan.replace(" ", "") and "tags" not in found.select("seq")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert sorted(r["seq"] for r in found.collect()) == [i for i in range(240) if i % 50 == 7]
    assert storage.with_tag(stored, "user", ["1", "2"]).count() == sum(i % 7 in (1, 2) for i in range(240)) and storage.with_tag(stored, "absent", ["x"]).count() == 0
    assert same(storage.whole_points(stored), points)
    import pyarrow.parquet as pq

    one = next(Path(path).rglob("*.parquet"))
    names = [c.path_in_schema for c in (pq.ParquetFile(one).metadata.row_group(0).column(i) for i in range(pq.ParquetFile(one).metadata.num_columns))]
    assert "tag_k" in names and "day" not in names


def test_removal_touches_only_its_days(spark, points, tmp_path):
    path = str(tmp_path / "s")
    storage.store_points(points, path, tags=("k",), rows_each=10)
    before = files(path)
    gone = points.where("seq in (30, 31, 1000) or to_date(ts) = '2024-01-05'").select("seq", "ts")
    assert storage.remove_points(spark, path, gone) == ["2024-01-02", "2024-01-05"]
    after = files(path)
    kept = {p: t for p, t in before.items() if "day=2024-01-02" not in str(p) and "day=2024-01-05" not in str(p)}
    assert {p: t for p, t in after.items() if p in kept} == kept and not os.path.exists(f"{path}/day=2024-01-05")
    wanted = points.where("seq not in (30, 31) and to_date(ts) <> '2024-01-05'")
    assert same(storage.whole_points(storage.stored_points(spark, path)), wanted)
    assert storage.remove_points(spark, path, gone) == [] and files(path) == after


def test_compaction(spark, points, tmp_path):
    path = str(tmp_path / "s")
    for k in range(3):
        storage.store_points(points.where(f"seq % 3 = {k} and (to_date(ts) < '2024-01-03' or {k} = 0)"), path)
    before = files(path)
    assert storage.compact(spark, path) == ["2024-01-01", "2024-01-02"]
    after = files(path)
    assert len(after) == 10 and all(after[p] == before[p] for p in after if "2024-01-01" not in str(p) and "2024-01-02" not in str(p))
    assert storage.compact(spark, path) == [] and storage.stored_points(spark, path).count() == 48 + 64


def test_sketches_merge(spark):
    rows = spark.range(60_000).select(F.lit("m").alias("metric"), (F.lit(START) + F.make_dt_interval(F.col("id") % 3)).cast("timestamp_ntz").alias("ts"), F.create_map(F.lit("k"), (F.col("id") % 20_000).cast("string")).alias("tags"))
    sketches = storage.value_sketches(rows)
    span = lambda a, b: TimeRange(to_ms(START + timedelta(days=a)), to_ms(START + timedelta(days=b)))
    whole = storage.distinct_values(sketches, span(0, 3)).first()
    assert whole["points"] == 60_000 and abs(whole["distinct_values"] / 20_000 - 1) < 0.05
    assert storage.distinct_values(sketches, span(1, 2)).first()["points"] == 20_000 and storage.distinct_values(sketches, span(5, 6)).count() == 0
    assert storage.distinct_values(sketches, span(0, 3), ["other"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_one_array_over_all_files(spark, tmp_path, n):
    export.write_json_array(spark.range(n).select("id", (F.col("id") * 2).alias("twice")).repartition(4), str(tmp_path / "a"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert sorted(r["id"] for r in json.loads(text)) == list(range(n))


def test_unknown_metrics_are_errors(points):
    now = to_ms(START + timedelta(days=400))
    with pytest.raises(MetricNotFound, match="nosuch"):
        Query.select("m1", "nosuch").run(points, now)
    assert Query.select("m1").run(points, now).count() == 0  # known, though it has no point in the range
