"""Windows at any size, and staged tables."""

import os
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import columns as C
from tidemark.operators import ordered

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def crowd(spark):
    """One metric with nearly all rows, most of them at one instant, and small ones."""
    rnd = random.Random(7)
    rows = [("hot", START + timedelta(seconds=0 if i % 3 else i), float(rnd.randint(0, 99)), i) for i in range(6000)]
    rows += [(f"m{i % 4}", START + timedelta(minutes=i), float(i), 10_000 + i) for i in range(20)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "metric string, ts timestamp_ntz, value double, seq long").repartition(5).cache(), rows


def by_metric(rows):
    out = {}
    for m, ts, value, seq in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        out.setdefault(m, []).append((ts, value, seq))
    return out


@pytest.mark.parametrize("each", [100, 1000, 10**6])
def test_windows_are_the_same_however_rows_are_cut(crowd, each):
    frame, rows = crowd
    gap, mean = {}, {}
    for own in by_metric(rows).values():
        for i, (ts, _, seq) in enumerate(own):
            gap[seq] = (round((ts - own[i - 1][0]).total_seconds() * 1000) if i else 0, i)
            near = [v for _, v, _ in own[max(0, i - 6) : i + 1]]
            mean[seq] = sum(near) / len(near)
    assert {r["seq"]: (r["delta_ms"], r["place"]) for r in ordered.deltas(frame, each).collect()} == gap
    assert {r["seq"]: r["moving_avg"] for r in ordered.running(frame, rows_each=each).collect()} == pytest.approx(mean)
    starts = frame.groupBy("metric").agg(F.min(C.millis("ts")).alias("start_ms"))
    back = ordered.times_of(ordered.deltas(frame, each), starts, each)
    assert {(r["seq"], r["at_ms"]) for r in back.collect()} == {(r["seq"], r["at"]) for r in frame.select("seq", C.millis("ts").alias("at")).collect()}


@pytest.mark.parametrize("each", [100, 10**6])
def test_as_of_however_rows_are_cut(spark, crowd, each):
    frame, rows = crowd
    probes = [(i, START + timedelta(seconds=s), m) for i, (s, m) in enumerate([(-1, "hot"), (0, "hot"), (1, "hot"), (5000, "hot"), (59, "m1"), (61, "m1"), (9999, "none")] + [(0, "hot")] * 900)]
    found = ordered.as_of(spark.createDataFrame(probes, "id long, ts timestamp_ntz, metric string"), frame, "metric", rows_each=each)
    own = by_metric(rows)
    for r in found.collect():
        before = [x for x in own.get(r["metric"], []) if x[0] <= r["ts"]]
        assert (r["found_ts"], r["found_value"]) == ((before[-1][0], before[-1][1]) if before else (None, None))
    assert found.count() == len(probes)


def test_no_stretch_holds_much_more_than_its_share(crowd):
    frame, rows = crowd
    cut, several = ordered.stretched(frame, ["metric"], ["ts", "seq"], 200)
    sizes = [r["count"] for r in cut.groupBy("metric", "_stretch").count().collect()]
    assert several and sum(sizes) == len(rows) and max(sizes) <= 3 * 200
    alike, _ = ordered.stretched(frame.select(F.lit("x").alias("metric"), F.lit(1).alias("ts")), ["metric"], ["ts"], 200)
    assert max(r["count"] for r in alike.groupBy("_stretch").count().collect()) <= 3 * 200


def test_scratch_of_other_threads_is_left_alone(spark):
    """Tables are removed by the scope that staged them, in whatever order threads end; kept ones stay."""
    ready, kept, errors = threading.Barrier(3), [], []

    def work(k):
        try:
            with session.scratch(spark):
                one = session.staged(spark.range(k + 5), "one")
                with session.scratch(spark):
                    two = session.staged(one.where("id > 0"), "two", keep=True)
                    gone = session.staged(one, "gone")
                    ready.wait(60)
                assert two.count() == k + 4 and one.count() == k + 5
                kept.append((session.staged(two, "kept", keep=True), k, gone.inputFiles() if k < 0 else None))
                ready.wait(60)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
            ready.abort()

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted((df.count(), k) for df, k, _ in kept) == [(4, 0), (5, 1), (6, 2)]
    session.release(spark)


def test_release_leaves_nothing(spark):
    session.release(spark)
    folder = session.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert session.staged(spark.range(3), "left").count() == 3 and set(os.listdir(folder)) != before
    session.release(spark)
    assert set(os.listdir(folder)) == before
