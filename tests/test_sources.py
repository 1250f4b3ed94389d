"""Raw events as a data source, syncs that go on, CSV files with their own headers, archives as files."""

import gzip
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.times import to_ms
from tidemark.sources import imports, incremental, raw

START = datetime(2024, 1, 15)


def event(at, kind="PushEvent", commits=1):
    return json.dumps({"type": kind, "created_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "payload": {"commits": [{"sha": str(k)} for k in range(commits)]}})


def loaded(spark, path, **more):
    raw.register_raw(spark)
    return spark.read.format("tidemark_raw").options(**raw.RAW["repository"], **more).load(str(path))


def seen(frame):
    return sorted((r["at"], r["kind"], r["line"]) for r in frame.collect())


@pytest.mark.parametrize("piece", [1, 7, 100, 10**6])
def test_pieces_give_each_line_once(spark, tmp_path, piece):
    """Wherever files are cut; empty lines, no last end of line, lines that are no JSON, other fields and zones."""
    lines = [event(START + timedelta(hours=i), "PushEvent" if i % 2 else "IssuesEvent") for i in range(20)]
    (tmp_path / "a.json").write_text("\n".join(lines[:9]) + "\n\n\n")
    (tmp_path / "b.json").write_text("\n".join([*lines[9:], "no json", '["a list"]', '{"type": 3, "created_at": "soon"}', '{"type": "x", "created_at": "2024-01-15T03:00:00+02:00"}']))
    (tmp_path / "_hidden").write_text("x\n")
    (tmp_path / "empty.json").write_text("")
    found = loaded(spark, tmp_path, piece=piece).collect()
    assert sorted(r["line"] for r in found) == sorted([*lines, "no json", '["a list"]', '{"type": 3, "created_at": "soon"}', '{"type": "x", "created_at": "2024-01-15T03:00:00+02:00"}'])
    assert {r["at"] for r in found if r["kind"] == "x"} == {datetime(2024, 1, 15, 1)}
    assert sum(r["at"] is None for r in found) == 3 and {r["file"].rsplit("/", 1)[-1] for r in found} == {"a.json", "b.json"}


def test_filters_are_applied_by_the_reader(spark, tmp_path):
    lines = [event(START + timedelta(hours=i), "PushEvent" if i % 2 else "IssuesEvent") for i in range(20)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text("\n".join(lines[:3]))
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        f.write("\n".join(lines[:5]))
    every = loaded(spark, tmp_path)
    at = C.moment(to_ms(START + timedelta(hours=12)))
    found = every.where((F.col("at") >= at) & (F.col("kind") == "PushEvent"))
    assert [r["at"].hour for r in found.orderBy("at").collect()] == [13, 15, 17, 19]
    assert every.where("file like '%b.json' and at is not null").count() == 3 and every.where(F.col("file").startswith(str(tmp_path / "c"))).count() == 5
    assert every.where(F.col("kind").isin("PushEvent", "x")).count() == 13 and every.where("kind like '%Event' and at < timestamp_ntz '2024-01-15 02:00:00'").count() == 6


def test_reader_keeps_only_what_it_can_test():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull

    reader = raw.RawReader({"path": "/x"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("at",), START), EqualTo(("kind",), "a"), IsNotNull(("at",)), EqualTo(("line",), "b")]))
    assert left == [IsNotNull(("at",)), EqualTo(("line",), "b")] and reader.allows("at", START) and not reader.allows("at", None) and not reader.allows("kind", "b")
    with pytest.raises(ValueError, match="path"):
        raw.RawReader({})


def test_stream_follows_a_growing_log(spark, tmp_path):
    from tidemark.streaming import tables

    raw.register_raw(spark)
    lines = [event(START + timedelta(hours=i)) for i in range(10)]
    log = tmp_path / "in"
    log.mkdir()
    source = lambda: spark.readStream.format("tidemark_raw").options(**raw.RAW["repository"]).load(str(log))
    kept = tables.stream_table(source())
    run = lambda: kept.start(source()).awaitTermination()
    run()
    assert kept.rows().count() == 0
    (log / "1.json").write_text(lines[0] + "\n" + lines[1] + "\n" + lines[2][:20])  # a line that is not ended
    run()
    assert sorted(r["line"] for r in kept.rows().collect()) == lines[:2]
    (log / "1.json").write_text("\n".join(lines[:4]) + "\n")
    (log / "2.json").write_text("\n".join(lines[4:6]) + "\n")
    run()
    with (log / "2.json").open("a") as f:
        f.write("\n".join(lines[6:]) + "\n")
    run()
    run()
    assert sorted(r["line"] for r in kept.rows().collect()) == lines


def test_since_is_applied_to_events(spark):
    lines = spark.createDataFrame([(event(START + timedelta(hours=h)),) for h in (3, 19, 20)], "line string")
    total = lambda hour: [r["value"] for r in imports.sync("repository", lines, C.moment(to_ms(START + timedelta(hours=hour)))).collect()]
    assert total(18) == [2.0] and total(6) == [2.0] and total(0) == [3.0] and total(21) == []
    day = spark.createDataFrame([('{"date": "2024-01-15", "summary": {"steps": 5}}',), ('{"date": "2024-01-14", "summary": {"steps": 6}}',)], "line string")
    found = imports.sync("activity", day, C.moment(to_ms(START + timedelta(hours=18)))).where("metric = 'steps'").collect()
    assert [r["value"] for r in found] == [5.0]
    with pytest.raises(ValueError, match="nosuch"):
        imports.sync("nosuch", lines)


def test_syncs_that_split_a_day(spark, tmp_path):
    """Totals of one sync; events at the very time of the mark that come later; a repeated sync; a sync that died."""
    base, folder = f"file://{tmp_path}/table", tmp_path / "in"
    folder.mkdir()
    table = incremental.SyncTable(spark, base)
    events = [event(START + timedelta(hours=h), commits=c) for h, c in ((3, 1), (19, 2), (19, 3), (20, 4), (30, 5))]
    take = lambda lines: ((folder / "x.json").write_text("\n".join(lines)), table.sync("repository", loaded(spark, folder)))[1]
    assert table.points().count() == 0 and table.mark("repository") is None
    assert take(events[:2]) == 2 and table.mark("repository") == START + timedelta(hours=19)
    assert take(events[:3]) == 1 and take(events[:3]) == 0
    (tmp_path / "table/batch=3/kind=point").mkdir(parents=True)  # of a sync that died
    assert take(events) == 2 and take(events) == 0
    assert sorted((r["ts"].day, r["value"]) for r in table.points().collect()) == [(15, 10.0), (16, 5.0)]
    days = lambda n: [json.dumps({"date": "2024-01-15", "summary": {"steps": n}})]
    for n in (5, 8):
        (folder / "x.json").write_text("\n".join(days(n)))
        raw.register_raw(spark)
        assert table.sync("activity", spark.read.format("tidemark_raw").options(**raw.RAW["activity"]).load(str(folder))) == 1
    assert [r["value"] for r in table.points().where("source = 'activity' and metric = 'steps'").collect()] == [8.0]


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Heart Rate,Steps\n2024-01-15,60,100\n2024-01-16,x,\nDate,Heart Rate,Steps\n')
    (tmp_path / "b.csv").write_text('"Steps",Mood,"Time, local",Extra\n7,3,2024-01-15 10:00:00,1\n')
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    found = imports.csv_file_points(spark, str(tmp_path)).orderBy("file", "metric").collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["metric"], r["ts"].hour, r["value"]) for r in found] == [
        ("a.csv", "heart_rate", 12, 60.0), ("a.csv", "steps", 12, 100.0), ("b.csv", "extra", 10, 1.0), ("b.csv", "mood", 10, 3.0), ("b.csv", "steps", 10, 7.0),
    ]
    assert imports.csv_file_points(spark, str(tmp_path), only=["mood"]).count() == 1


def test_large_csv_is_split(spark, tmp_path):
    rows = [f"2024-01-15 10:00:{i % 60:02d},{i}" for i in range(20_000)]
    (tmp_path / "a.csv").write_text("time,n\n" + "\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = imports.csv_file_points(spark, str(tmp_path)).agg(F.count("*"), F.sum("value")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(found) == (20_000, sum(range(20_000)))


RECORDS = "".join(
    f'<Record type="HKQuantityTypeIdentifierStepCount" sourceName="a &amp; b" unit="count" startDate="2024-01-15 10:00:{i % 60:02d} +0100" value="{i}"/>\n' for i in range(200)
)


def test_health_exports_as_files(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("apple/export.xml", f"<HealthData>{RECORDS}</HealthData>")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("x.txt", "y")
    found = imports.health_files(spark, str(tmp_path), piece=500)
    assert found.count() == 400 and found.select("file").distinct().count() == 2
    assert {(r["metric"], r["source"], r["ts"].hour) for r in found.collect()} == {("steps", "a & b", 9)}
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml/export.xml").write_text(f"<HealthData>\n{RECORDS}</HealthData>")
    plain = imports.health_xml(spark, str(tmp_path / "xml"))
    key = ["metric", "ts", "value", "unit", "source"]
    assert sorted(map(tuple, plain.select(key).collect())) == sorted(map(tuple, found.where(F.col("file").contains("one")).select(key).collect()))


def test_acronyms(spark):
    kinds = ["HKQuantityTypeIdentifierVO2Max", "HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "HKQuantityTypeIdentifierStepCount", "HKCategoryTypeIdentifierSleepAnalysis", "Plain"]
    frame = spark.createDataFrame([(k,) for k in kinds], "k string")
    names = lambda **more: [r[0] for r in frame.select(imports.health_metric(F.col("k"), **more)).collect()]
    assert names(acronyms=True) == ["vo2_max", "hrv", "steps", "sleep", "plain"]
    assert names() == ["v_o2_max", "heart_rate_variability_s_d_n_n", "steps", "sleep", "plain"]
