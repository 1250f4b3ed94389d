from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import times as t

NOW = 1_705_329_342_123


def test_durations_by_input():
    assert t.duration_ms("5m") == 300_000
    assert t.duration_ms("1m", t.REQUEST_UNITS) == 30 * t.DAY
    assert t.duration_ms("1y", t.COMMAND_UNITS) == 365 * t.DAY
    with pytest.raises(ValueError):
        t.duration_ms("5x")


@pytest.mark.parametrize(
    ("text", "ms"),
    [(1000, 1000), ("1000", 1000), ("now", NOW), ("now-7d", NOW - 7 * t.DAY), ("now-24h", NOW - t.DAY), ("2024-01-15", 1_705_276_800_000), ("2024-01-15T00:00:00Z", 1_705_276_800_000), ("2024-01-15T01:00:00+01:00", 1_705_276_800_000)],
)
def test_parse_time(text, ms):
    assert t.parse_time(text, NOW) == ms


def test_bad_time():
    with pytest.raises(ValueError):
        t.parse_time("yesterday-ish", NOW)


def test_ranges():
    span = t.TimeRange(1000, 2000)
    assert [span.contains(x) for x in (999, 1000, 1999, 2000)] == [False, True, True, False]
    assert not span.overlaps(t.TimeRange(2000, 3000)) and span.overlaps(t.TimeRange(1999, 3000))
    assert span.intersection(t.TimeRange(1500, 5000)) == t.TimeRange(1500, 2000) and span.intersection(t.TimeRange(2000, 5000)) is None
    assert t.TimeRange.month(2024, 12).millis == 31 * t.DAY and t.TimeRange.day(2024, 2, 29).millis == t.DAY
    assert span.expand(5) == t.TimeRange(995, 2005) and span.seconds == 1
    with pytest.raises(ValueError):
        t.TimeRange(5, 5)


def test_auto_interval():
    assert [t.auto_interval(0, d * t.DAY) for d in (7, 8, 90, 91)] == [None, "day", "day", "week"]


@given(st.integers(min_value=0, max_value=4_000_000_000_000))
def test_text_round_trip(ms):
    assert t.to_ms(datetime.fromisoformat(t.to_text(ms))) == ms
