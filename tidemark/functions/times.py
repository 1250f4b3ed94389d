"""Time ranges, durations and time expressions. All times are UTC milliseconds; `now` is always given."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

SECOND = 1000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# What the letter of a duration means in each kind of input.
QUERY_UNITS = {"d": DAY, "h": HOUR, "m": MINUTE, "s": SECOND}
REQUEST_UNITS = {"h": HOUR, "d": DAY, "w": 7 * DAY, "m": 30 * DAY}
COMMAND_UNITS = {"d": DAY, "w": 7 * DAY, "m": 30 * DAY, "y": 365 * DAY}

# Calendar intervals, their short names and approximate lengths.
INTERVALS = {"hour": HOUR, "day": DAY, "week": 7 * DAY, "month": 30 * DAY}
SHORT_INTERVALS = {"h": "hour", "d": "day", "w": "week", "m": "month"}


def to_ms(moment: datetime) -> int:
    """Milliseconds of a moment; one without a zone is taken as UTC."""
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def to_text(ms: int) -> str:
    """The moment as text that Spark casts to a timestamp without zone."""
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=" ", timespec="milliseconds")


def duration_ms(text: str, units: dict[str, int] = QUERY_UNITS) -> int:
    """Length of a duration such as 7d."""
    found = re.fullmatch(r"(\d+)([a-z])", text.strip())
    if not found or found[2] not in units:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * units[found[2]]


def parse_time(text: str | int, now_ms: int, units: dict[str, int] = REQUEST_UNITS) -> int:
    """Milliseconds from an integer, now or now-<duration>, an RFC 3339 time, a local time (UTC) or a date (midnight)."""
    if isinstance(text, int):
        return text
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if text.lower() in ("now", "now()"):
        return now_ms
    if found := re.fullmatch(r"now(?:\(\))?\s*-\s*(\w+)", text.lower()):
        return now_ms - duration_ms(found[1], units)
    try:
        return to_ms(datetime.fromisoformat(text))
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None


def interval_name(text: str) -> str:
    """hour, day, week or month from a full or short name."""
    name = SHORT_INTERVALS.get(text.lower(), text.lower())
    if name not in INTERVALS:
        raise ValueError(f"not an interval: {text!r}")
    return name


def auto_interval(start_ms: int, end_ms: int) -> str | None:
    """The bucket a chart over the range uses: weeks beyond 90 days, days beyond 7, else none."""
    days = (end_ms - start_ms) / DAY
    return "week" if days > 90 else "day" if days > 7 else None


@dataclass(frozen=True)
class TimeRange:
    """A half-open range of milliseconds; it is never empty."""

    start: int
    end: int

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError(f"empty or inverted time range: {self.start} to {self.end}")

    @classmethod
    def attempt(cls, start: int, end: int) -> TimeRange | None:
        return cls(start, end) if start < end else None

    @classmethod
    def last(cls, now_ms: int, days: int = 0, hours: int = 0, minutes: int = 0) -> TimeRange:
        return cls(now_ms - days * DAY - hours * HOUR - minutes * MINUTE, now_ms)

    @classmethod
    def day(cls, year: int, month: int, day: int) -> TimeRange:
        start = to_ms(datetime(year, month, day))
        return cls(start, start + DAY)

    @classmethod
    def month(cls, year: int, month: int) -> TimeRange:
        return cls(to_ms(datetime(year, month, 1)), to_ms(datetime(year + month // 12, month % 12 + 1, 1)))

    def contains(self, ms: int) -> bool:
        return self.start <= ms < self.end

    def overlaps(self, other: TimeRange) -> bool:
        return self.start < other.end and other.start < self.end

    def intersection(self, other: TimeRange) -> TimeRange | None:
        return self.attempt(max(self.start, other.start), min(self.end, other.end))

    def expand(self, ms: int) -> TimeRange:
        return TimeRange(self.start - ms, self.end + ms)

    @property
    def millis(self) -> int:
        return self.end - self.start

    @property
    def seconds(self) -> int:
        return self.millis // SECOND
