"""Ranges and calendars: everything is epoch milliseconds, half open, and right across clock changes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import DataFrame, SparkSession

from meterlark.sources.local import local_table

HOUR = 3_600_000
#: Rolling periods, by name, in milliseconds.
ROLLING = {"1h": HOUR, "5h": 5 * HOUR, "24h": 24 * HOUR}
CALENDAR = ("today", "this_week", "this_month")


@dataclass(frozen=True)
class Range:
    start: int
    end: int

    def clipped(self, other: Range) -> Range:
        return Range(max(self.start, other.start), min(self.end, other.end))


class Zone:
    """A time zone by IANA name."""

    def __init__(self, name: str):
        canonical = {z.lower(): z for z in available_timezones()}.get(name.strip().lower())
        if canonical is None:
            raise ValueError(f"no such time zone: {name!r}")
        self.name, self.info = canonical, ZoneInfo(canonical)

    def offset(self, ms: int) -> int:
        at = datetime.fromtimestamp(ms / 1000, self.info)
        return round(at.utcoffset().total_seconds() * 1000)

    def date_at(self, ms: int) -> date:
        return datetime.fromtimestamp(ms // 1000, UTC).astimezone(self.info).date()

    def start_of(self, day: date) -> int:
        """The day's first instant: local midnight, the earlier of two, or the clock change that skips it."""
        naive = round((datetime(day.year, day.month, day.day) - datetime(1970, 1, 1)).total_seconds() * 1000)
        guesses = sorted({naive - self.offset(naive - 26 * HOUR), naive - self.offset(naive + 26 * HOUR)})
        for at in guesses:
            if at + self.offset(at) == naive:
                return at
        lo, hi = guesses[0] - 26 * HOUR, guesses[-1] + 26 * HOUR  # midnight doesn't exist: find the change
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if mid + self.offset(mid) < naive else (lo, mid)
        return hi

    def iso(self, ms: int) -> str:
        """Local time with its offset, `Z` for none."""
        local = datetime.fromtimestamp(ms // 1000, self.info)
        text = f"{local:%Y-%m-%dT%H:%M:%S}" + (f".{ms % 1000:03d}" if ms % 1000 else "")
        minutes = self.offset(ms) // 60_000
        return text + ("Z" if not minutes else f"{'+' if minutes > 0 else '-'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}")


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def first_of_month(day: date, months: int = 0) -> date:
    at = day.year * 12 + day.month - 1 + months
    return date(at // 12, at % 12 + 1, 1)


def unit_start(day: date, unit: str) -> date:
    return {"day": day, "week": monday_of(day), "month": first_of_month(day)}[unit]


def unit_next(day: date, unit: str) -> date:
    return first_of_month(day, 1) if unit == "month" else day + timedelta(days=7 if unit == "week" else 1)


def resolve_period(name: str, now: int, zone: Zone, *, extent: tuple[int, int] | None = None, custom: Range | None = None) -> Range:
    """A period's range: rolling ones end now, inclusive; calendar ones at the next start; `all` holds every stored row."""
    if name in ROLLING:
        return Range(now - ROLLING[name], now + 1)
    if name in CALENDAR:
        unit = {"today": "day", "this_week": "week", "this_month": "month"}[name]
        day = unit_start(zone.date_at(now), unit)
        return Range(zone.start_of(day), zone.start_of(unit_next(day, unit)))
    if name == "all":
        return Range(extent[0], extent[1] + 1) if extent else Range(0, 0)
    if name == "custom":
        if custom is None or custom.end < custom.start:
            raise ValueError("a custom period needs a start at or before its end")
        return custom
    raise ValueError(f"no such period: {name!r}")


def parse_bound(text: str, zone: Zone, *, until: bool = False) -> int:
    """A date (an until-date is inclusive) or an instant with an offset; nothing before 1970."""
    try:
        day = date.fromisoformat(text)
        ms = zone.start_of(day + timedelta(days=1) if until else day)
    except ValueError:
        at = datetime.fromisoformat(text)
        if at.tzinfo is None:
            raise ValueError(f"{text!r}: an instant needs an offset") from None
        ms = round(at.timestamp() * 1000)
    if ms < 0:
        raise ValueError(f"{text!r}: before 1970")
    return ms


def calendar_slices(span: Range, unit: str, zone: Zone) -> list[tuple[date, Range]]:
    """Days, weeks or months of a range, empty ones included; the first and last are clipped to it."""
    out: list[tuple[date, Range]] = []
    if span.end <= span.start:
        return out
    day = unit_start(zone.date_at(span.start), unit)
    while zone.start_of(day) < span.end:
        following = unit_next(day, unit)
        out.append((day, Range(zone.start_of(day), zone.start_of(following)).clipped(span)))
        day = following
    return out


def equal_buckets(span: Range, n: int) -> list[Range]:
    """n buckets of equal width, edges rounded half up; the last ends with the range."""
    if n < 1:
        raise ValueError("at least one bucket")
    width = (span.end - span.start) / n
    edges = [span.start + int((i * width) // 1 + (1 if (i * width) % 1 >= 0.5 else 0)) for i in range(n)] + [span.end]
    return [Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def activity_range(kind: str, now: int) -> tuple[Range, int]:
    """(aligned rolling window, bucket width) of an activity series; it ends at the next bucket's boundary."""
    length, bucket = {"5h": (5 * HOUR, 60_000), "24h": (24 * HOUR, 300_000), "7d": (7 * 24 * HOUR, HOUR)}[kind]
    end = (now // bucket + 1) * bucket
    return Range(end - length, end), bucket


def spine(spark: SparkSession, slots: list[Range], days: list[date] | None = None) -> DataFrame:
    """The slots of a series as a table: slot, day, lo, hi."""
    rows = [(i, days[i] if days else None, s.start, s.end) for i, s in enumerate(slots)]
    return local_table(spark, rows, "slot int, day date, lo long, hi long")
