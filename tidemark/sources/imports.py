"""Importers: wide CSV lines, health records in XML, repository events and daily activity in JSON.

Each takes a DataFrame of raw text rows (from a file, a stream or a table) and returns points; all parsing is
done by Spark's own expressions, so an import is spread over its input like any scan. Archives alone are unpacked by Python, in a stream.
`SOURCES` holds the importers of services by name; others can be added.
"""

from __future__ import annotations

import base64
import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import staged

# Time formats tried in turn for CSV cells; those of dates alone stand for noon.
CSV_TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
CSV_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy")

# Names that differ from the record type's own words, and words that tell a category.
HEALTH_NAMES = {
    "step_count": "steps", "distance_walking_running": "distance", "active_energy_burned": "calories_active", "basal_energy_burned": "calories_basal",
    "sleep_analysis": "sleep", "body_mass": "weight", "body_mass_index": "bmi", "oxygen_saturation": "spo2", "walking_heart_rate_average": "walking_heart_rate",
    "heart_rate_variability_sdnn": "hrv", "apple_stand_hour": "stand_hours", "apple_exercise_time": "exercise_minutes", "mindful_session": "mindfulness_minutes",
    "dietary_water": "water", "dietary_caffeine": "caffeine",
}
HEALTH_CATEGORIES = (
    ("health", ("heart", "blood", "spo2", "step", "distance", "calories", "weight", "bmi", "height", "sleep", "vo2", "respiratory")),
    ("habit", ("exercise", "workout")),
    ("mood", ("energy", "mood")),
)


def _noon(c: Column) -> Column:
    return (c + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz")


def csv_time(text: Column, first_format: str | None = None) -> Column:
    """A CSV cell as a time: the given format, then the usual ones, dates at noon UTC, then RFC 3339; null if none fits."""
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in ([first_format] if first_format else []) + list(CSV_TIMES)]
    tries += [_noon(F.try_to_timestamp(text, F.lit(f))) for f in CSV_DATES]
    zoned = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz"))
    return F.coalesce(*tries, zoned)


def csv_columns(header: str, separator: str = ",") -> tuple[int, dict[int, str]]:
    """From a header the place of the time column (the last whose name says so) and the metric of each other column."""
    names = [n.strip() for n in next(csv.reader([header], delimiter=separator))]
    times = [i for i, n in enumerate(names) if re.search("date|time", n.lower())]
    if not times:
        raise ValueError("no column is called date, time or timestamp")
    return times[-1], {i: n.lower().replace(" ", "_") for i, n in enumerate(names) if i not in times}


def _csv_rows(lines: DataFrame, header: str, line_col: str, first_format: str | None, separator: str, only: list[str] | None, keep: list[str]) -> DataFrame:
    """(line, ts, cells, *keep) of the lines that are no header; cells are structs of metric and value."""
    at, metrics = csv_columns(header, separator)
    names = next(csv.reader([header], delimiter=separator))
    chosen = {i: m for i, m in metrics.items() if only is None or m in only}
    cells = F.from_csv(F.col(line_col), F.lit(", ".join(f"c{i} string" for i in range(len(names)))), {"mode": "PERMISSIVE", "sep": separator})
    rows = lines.where(F.col(line_col) != F.lit(header)).select(F.col(line_col).alias("line"), *keep, cells.alias("c"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(trim(c.c{i}) as double)").alias("value")) for i, m in chosen.items()])
    return rows.select("line", *keep, F.trim(f"c.c{at}").alias("time_text"), csv_time(F.trim(f"c.c{at}"), first_format).alias("ts"), each.alias("cells"))


def csv_points(lines: DataFrame, header: str, line_col: str = "line", first_format: str | None = None, separator: str = ",", only: list[str] | None = None) -> DataFrame:
    """(metric, ts, value) from lines of a wide CSV: a point for each cell that is a number; ragged rows and other cells are passed over.

    Lines equal to the header are headers. `only` names the metrics to read, all by default.
    """
    long = _csv_rows(lines, header, line_col, first_format, separator, only, []).select("ts", F.explode("cells").alias("p"))
    return long.select("p.metric", "ts", "p.value").where("ts is not null and value is not null")


def csv_report(
    lines: DataFrame, header: str, number_col: str, line_col: str = "line", first_format: str | None = None, separator: str = ",", only: list[str] | None = None, listed: int = 100
) -> DataFrame:
    """One row (rows_read, points, failed, errors, more) about an import: rows without a good time fail; the first `listed` errors by number, and how many more there are."""
    rows = _csv_rows(lines, header, line_col, first_format, separator, only, [number_col])
    good = F.col("ts").isNotNull()
    text = F.format_string("row %d: not a time: %s", F.col(number_col), F.coalesce("time_text", F.lit("")))
    first = rows.where(~good).select(F.struct(F.col(number_col).alias("n"), text.alias("text")).alias("e")).orderBy("e").limit(listed)
    errors = first.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]).alias("errors"), F.lit(1).alias("key"))  # `listed` at most
    counts = rows.agg(
        F.count("*").alias("rows_read"), F.coalesce(F.sum(F.when(good, F.size(F.filter("cells", lambda c: c["value"].isNotNull())))), F.lit(0)).cast("long").alias("points"), F.count_if(~good).alias("failed"), F.lit(1).alias("key")
    )
    return counts.join(errors, "key").select("rows_read", "points", "failed", "errors", (F.col("failed") - F.size("errors")).alias("more"))  # one row each


def csv_file_points(spark: SparkSession, path: str, first_format: str | None = None, separator: str = ",", only: list[str] | None = None) -> DataFrame:
    """(file, metric, ts, value) from wide CSV files in a folder, each with a header of its own as its first line.

    Files may differ in their columns, in their order and number. A file whose header names no time gives nothing; a line that equals the header further down is
    a row like others. Lines do not go over ends of lines. Large files are split; headers are a row for each file and joined to its lines.
    """
    options = {"mode": "PERMISSIVE", "sep": separator}
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    first = text.where(F.col("_block") == 0).groupBy("file").agg(F.min_by("value", "_at").alias("_header"), F.min("_at").alias("_first"))
    widest = first.agg(F.max(F.size(F.split("_header", re.escape(separator))))).first()[0] or 1
    shape, places = ", ".join(f"c{i} string" for i in range(widest)), range(widest)
    cells = lambda line: F.array(*[F.trim(F.from_csv(line, F.lit(shape), options)[f"c{i}"]) for i in places])
    names = first.select("file", "_first", cells(F.col("_header")).alias("_names"))
    timed = F.filter(F.sequence(F.lit(0), F.lit(widest - 1)), lambda i: F.coalesce(F.lower(F.get("_names", i)).rlike("date|time"), F.lit(False)))
    heads = staged(names.withColumn("_times", timed).where(F.size("_times") > 0), "headers")
    rows = text.join(heads, "file").where((F.col("_block") > 0) | (F.col("_at") != F.col("_first"))).withColumn("_cells", cells(F.col("value")))
    ts = csv_time(F.get("_cells", F.element_at("_times", -1)), first_format)
    metric = F.replace(F.lower("c._names"), F.lit(" "), F.lit("_"))
    long = rows.select("file", "_times", ts.alias("ts"), F.posexplode(F.arrays_zip("_names", "_cells")).alias("place", "c"))
    made = long.where(~F.array_contains("_times", F.col("place")) & F.col("c._names").isNotNull()).select("file", metric.alias("metric"), "ts", F.expr("try_cast(c._cells as double)").alias("value"))
    made = made.where("ts is not null and value is not null")
    return made if only is None else made.where(F.col("metric").isin(only))


def health_metric(kind: Column, acronyms: bool = False) -> Column:
    """A health record's type as a metric name: without prefix, words in lower case joined by underscores, usual names for some.

    Each capital begins a word, so that letters of an acronym are words of their own (v_o2_max); with `acronyms` it is one word (vo2_max), and hrv gets its usual name.
    """
    plain = F.regexp_replace(kind, "^HK(Quantity|Category)TypeIdentifier", "")
    begins = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z0-9])(?=[A-Z][a-z])" if acronyms else "(?<!^)(?=[A-Z])"
    snake = F.lower(F.regexp_replace(plain, begins, "_"))
    names = F.create_map(*[F.lit(x) for pair in HEALTH_NAMES.items() for x in pair])
    return F.coalesce(names[snake], snake)


def health_category(metric: Column) -> Column:
    """The category that words in a metric's name tell; custom if none does."""
    out = F.lit("custom")
    for category, words in reversed(HEALTH_CATEGORIES):
        out = F.when(reduce(lambda a, b: a | b, [metric.contains(w) for w in words]), category).otherwise(out)
    return out


def _plain(text: Column) -> Column:
    """Text without XML entities."""
    for entity, sign in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _health_rows(records: DataFrame, keep: list[str], acronyms: bool = False) -> DataFrame:
    """(*keep, metric, ts, value, unit, source) from the attributes of records; values that are no numbers and times that are none are left out."""
    zoned = F.to_utc_timestamp(F.try_to_timestamp("startDate", F.lit("yyyy-MM-dd HH:mm:ss Z")), F.current_timezone()).cast("timestamp_ntz")
    ts = F.coalesce(zoned, F.try_to_timestamp("startDate", F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
    made = records.select(*keep, health_metric(F.col("type"), acronyms).alias("metric"), ts.alias("ts"), F.expr("try_cast(value as double)").alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), F.col("sourceName").alias("source"))
    return made.where("metric is not null and ts is not null and value is not null")


def health_points(lines: DataFrame, line_col: str = "line", keep: list[str] | None = None, acronyms: bool = False) -> DataFrame:
    """(*keep, metric, ts, value, unit, source) of every <Record …> in the lines."""

    def attribute(name: str) -> Column:
        found = F.regexp_extract("_record", rf'\s{name}="([^"]*)"', 1)
        return F.when(found != "", _plain(found)).alias(name)

    rows = lines.select(*(keep or []), F.explode(F.regexp_extract_all(F.col(line_col), F.lit("<Record(?:[^>\"]|\"[^\"]*\")*>"), 0)).alias("_record"))
    return _health_rows(rows.select(*(keep or []), *map(attribute, ("type", "startDate", "value", "unit", "sourceName"))), keep or [], acronyms)


def _pieces(archive: IO[bytes], inside: str, piece: int) -> Iterator[str]:
    """The file `inside` of a zipped archive, in pieces that end after a record."""
    try:
        whole = zipfile.ZipFile(archive)
    except (zipfile.BadZipFile, OSError, ValueError):
        return
    name = next((n for n in whole.namelist() if n.rsplit("/", 1)[-1] == inside), None)
    if name is None:
        return
    with whole.open(name) as f:
        rest = b""
        while more := f.read(piece):
            cut = (rest + more).rfind(b">") + 1
            yield (rest + more)[:cut].decode("utf-8", "replace")
            rest = (rest + more)[cut:]
        yield rest.decode("utf-8", "replace")


def archive_lines(archives: DataFrame, archive_col: str = "archive", inside: str = "export.xml", piece: int = 1 << 20) -> DataFrame:
    """(line): the file `inside` of each zipped archive (base64 text), read in pieces that end after a record; broken archives and those without the file give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                try:
                    whole = base64.b64decode(packed.as_py() or "")
                except ValueError:
                    continue
                for text in _pieces(io.BytesIO(whole), inside, piece):
                    yield pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["line"])

    return archives.select(F.col(archive_col).cast("string")).mapInArrow(run, "line string")


def health_archives(archives: DataFrame, archive_col: str = "archive") -> DataFrame:
    """The points of `health_points` from exported archives as base64 text."""
    return health_points(archive_lines(archives, archive_col))


def health_files(spark: SparkSession, path: str, inside: str = "export.xml", piece: int = 1 << 20, acronyms: bool = False) -> DataFrame:
    """(file, metric, ts, value, unit, source) from zipped exports in a folder, of whatever size.

    Spark lists the files; a task opens its own where they lie and unpacks them in pieces, so neither an archive nor what is in it is held whole. Files that
    are no archives or lack `inside` give nothing.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")  # contents are not read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                files, own = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with files.open_input_file(own) as f:
                    for text in _pieces(f, inside, piece):
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([text], pa.string())], ["file", "line"])

    return health_points(listed.mapInArrow(run, "file string, line string"), keep=["file"], acronyms=acronyms)


def health_xml(spark: SparkSession, path: str, acronyms: bool = False) -> DataFrame:
    """(metric, ts, value, unit, source) from exports as plain XML, by Spark's own reader: each <Record …> of a well-formed file is a row."""
    shape = "_type string, _startDate string, _value string, _unit string, _sourceName string"
    rows = spark.read.format("xml").option("rowTag", "Record").schema(shape).load(path)
    return _health_rows(rows.select(*[F.col(f"_{c}").alias(c) for c in ("type", "startDate", "value", "unit", "sourceName")]), [], acronyms)


# The shape of a repository event.
REPOSITORY_EVENT = "type string, created_at string, payload struct<action:string, commits:array<struct<sha:string>>, pull_request:struct<merged:boolean>>"


def repository_points(lines: DataFrame, line_col: str = "line", since: Column | None = None) -> DataFrame:
    """(metric, ts, value): daily counts at noon from events as JSON lines; counts of zero and events without a good time are left out."""
    rows = lines.select(F.from_json(line_col, REPOSITORY_EVENT).alias("e")).select("e.*")
    rows = rows.withColumn("at", F.to_utc_timestamp(F.try_to_timestamp("created_at"), F.current_timezone()).cast("timestamp_ntz")).where("at is not null")
    rows = rows if since is None else rows.where(F.col("at") >= since)
    action, merged = F.col("payload.action"), F.coalesce("payload.pull_request.merged", F.lit(False))
    pull, closed = F.col("type") == "PullRequestEvent", action == "closed"
    counts = {
        "commits": F.sum(F.when(F.col("type") == "PushEvent", F.coalesce(F.size("payload.commits"), F.lit(0))).otherwise(0)),
        "prs_opened": F.count_if(pull & (action == "opened")),
        "prs_merged": F.count_if(pull & closed & merged),
        "issues_closed": F.count_if((F.col("type") == "IssuesEvent") & closed),
        "code_reviews": F.count_if(F.col("type") == "PullRequestReviewEvent"),
    }
    days = rows.groupBy(F.date_trunc("day", "at").alias("day")).agg(*[c.cast("double").alias(n) for n, c in counts.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in counts])).alias("p")
    return days.select(each, _noon(F.col("day")).alias("ts")).select("p.metric", "ts", "p.value").where("value > 0")


# The shape of a day of activity.
ACTIVITY_DAY = "date string, summary struct<steps:double, caloriesOut:double, veryActiveMinutes:double, fairlyActiveMinutes:double, totalMinutesAsleep:double>"


def activity_points(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(metric, ts, value) from days as JSON lines: steps, calories and active minutes at noon, hours of sleep (if any) at six."""
    s = F.col("d.summary")
    days = lines.select(F.from_json(line_col, ACTIVITY_DAY).alias("d")).withColumn("day", F.try_to_timestamp("d.date", F.lit("yyyy-MM-dd"))).where("day is not null")
    active = F.coalesce(s["veryActiveMinutes"], F.lit(0.0)) + F.coalesce(s["fairlyActiveMinutes"], F.lit(0.0))
    sleep = F.when(s["totalMinutesAsleep"] > 0, s["totalMinutesAsleep"] / 60)
    cells = [("steps", 12, s["steps"]), ("calories_burned", 12, s["caloriesOut"]), ("active_minutes", 12, active), ("sleep_hours", 6, sleep)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(h).alias("hour"), v.cast("double").alias("value")) for n, h, v in cells])).alias("p")
    made = days.select("day", each).where("p.value is not null")
    return made.select("p.metric", (F.col("day") + F.make_dt_interval(hours=F.col("p.hour"))).cast("timestamp_ntz").alias("ts"), "p.value")


@dataclass(frozen=True)
class Source:
    """An importer of a service: the metrics it can provide (none given: any) and how its raw lines, from a time on, become points.

    `additive`: points of one metric and time from different lines add up; else each line's point stands for itself.
    """

    metrics: tuple[str, ...]
    points: Callable[[DataFrame, Column | None], DataFrame]
    additive: bool = False


def _since(points: DataFrame, since: Column | None) -> DataFrame:
    return points if since is None else points.where(F.col("ts") >= since)


#: Importers by name; a plug-in adds its own.
SOURCES: dict[str, Source] = {
    "repository": Source(("commits", "prs_opened", "prs_merged", "issues_closed", "code_reviews"), lambda lines, since: repository_points(lines, since=since), additive=True),
    "activity": Source(("steps", "calories_burned", "active_minutes", "sleep_hours"), lambda lines, since: _since(activity_points(lines), None if since is None else F.date_trunc("day", since).cast("timestamp_ntz"))),
    "health": Source((), lambda lines, since: _since(health_points(lines).select("metric", "ts", "value"), since)),
}


def source(name: str) -> Source:
    if name not in SOURCES:
        raise ValueError(f"no source is called {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]


def sync(name: str, lines: DataFrame, since: Column | None = None) -> DataFrame:
    """(metric, ts, value): what a source has from a time on, of the metrics it provides.

    The time is applied to the source's own events before they are summed: events of a repository, records of health; of days of activity the whole day counts.
    """
    own = source(name)
    found = own.points(lines, since)
    return found.where(F.col("metric").isin(*own.metrics)) if own.metrics else found
