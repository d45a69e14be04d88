"""Limit windows as columns: labels, lengths, scopes, and how times and shares are told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of a week and of each unit of a label; labels of the oldest window kinds.
WEEK_MINUTES = 10_080
UNITS = {"MIN": 1, "HOUR": 60, "DAY": 1_440, "WEEK": 10_080}
LABELS = {"five_hour": "5-HOUR", "seven_day": "WEEKLY"}
LENGTH = r"(^|\s)(\d+)-(MIN|HOUR|DAY|WEEK)$"
TOLD_LENGTH = r"(?i)\s+(WEEKLY|\d+-(MIN|HOUR|DAY|WEEK))$"
SLOT = r"^(.+)_(primary|secondary|individualLimit)$"


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def label_for(kind: Column) -> Column:
    out = F.upper(F.replace(kind, F.lit("_"), F.lit(" ")))
    for key, label in LABELS.items():
        out = F.when(kind == key, label).otherwise(out)
    return out


def label_for_minutes(minutes: Column, kind: Column) -> Column:
    """`WEEKLY`, `2-WEEK`, `3-DAY`, `5-HOUR`, `45-MIN`; by the kind where no length is known."""
    whole = F.floor(minutes).cast("long")
    told = lambda unit: F.concat((whole / UNITS[unit]).cast("long").cast("string"), F.lit(f"-{unit}"))
    by_length = F.when(whole == WEEK_MINUTES, "WEEKLY")
    for unit in ("WEEK", "DAY", "HOUR"):
        by_length = by_length.when(whole % UNITS[unit] == 0, told(unit))
    return F.when(finite(minutes) & (minutes > 0), by_length.otherwise(told("MIN"))).otherwise(label_for(kind))


def window_label(kind: Column, label: Column, minutes: Column) -> Column:
    return F.when(label != "", label).otherwise(label_for_minutes(minutes, kind))


def window_minutes(kind: Column, label: Column, minutes: Column) -> Column:
    """The window's length: as stated, else by its kind, else read from its label; null when nothing tells."""
    text = F.coalesce(label, F.lit(""))
    unit = F.regexp_extract(text, LENGTH, 3)
    size = F.lit(None).cast("double")
    for name, n in UNITS.items():
        size = F.when(unit == name, F.try_to_number(F.regexp_extract(text, LENGTH, 2), F.lit("999999999")).cast("double") * n).otherwise(size)
    return (
        F.when(finite(minutes) & (minutes > 0), minutes).when(kind.isin("session", "five_hour"), 300.0)
        .when(F.startswith(kind, F.lit("weekly")) | F.startswith(kind, F.lit("seven_day")) | F.rlike(text, F.lit(r"(^|\s)WEEKLY$")), float(WEEK_MINUTES)).otherwise(size)
    )


def window_scope(provider: Column, kind: Column, label: Column) -> Column:
    """The model a window is limited to, or null for one that limits the whole account."""
    owner = F.regexp_extract(kind, SLOT, 1)
    named = F.regexp_replace(label, TOLD_LENGTH, "")
    codex = F.when((owner == "") | (owner == "codex"), None).when((named != label) & (named != ""), named).otherwise(F.regexp_replace(owner, "^codex_", ""))
    weekly = F.regexp_replace(label, r"(?i)\s+WEEKLY$", "")
    old = F.regexp_extract(kind, r"^seven_day_(.+)$", 1)
    claude = F.when(F.rlike(kind, F.lit(r"^weekly_scoped(_\d+)?$")), F.when(weekly != "", weekly).otherwise("scoped")).when(old != "", F.replace(old, F.lit("_"), F.lit(" ")))
    return F.when(provider == "codex", codex).otherwise(claude)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def scope_matches(scope: Column, model: Column) -> Column:
    """Whether every word of the scope (at least one) is a word of the model."""
    need = words(scope)
    return F.coalesce((F.size(need) > 0) & (F.size(F.array_except(need, words(model))) == 0), F.lit(False))


def order_rank(kind: Column) -> Column:
    return F.when(kind == "five_hour", 0).when(kind == "seven_day", 1).otherwise(2)


# --- telling -------------------------------------------------------------------------------------------------------


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def _units(ms: Column, gap: str, seconds_below: int) -> Column:
    s = F.greatest(F.lit(0).cast("long"), F.floor(ms / 1000 + 0.5).cast("long"))
    m, text = F.floor(s / 60 + 0.5).cast("long"), lambda x, u: F.concat(x.cast("string"), F.lit(u))
    h = F.floor(m / 60).cast("long")
    days = F.floor(h / 24).cast("long")
    pair = lambda big, u, small, v: F.when(small == 0, text(big, u)).otherwise(F.concat(text(big, u), F.lit(gap), text(small, v)))
    out = F.when(s < 60, text(s, "s"))
    if seconds_below > 60:
        out = out.when(s < seconds_below, pair(F.floor(s / 60).cast("long"), "m", s % 60, "s"))
    return out.when(m < 60, text(m, "m")).when(h < 24, pair(h, "h", m % 60, "m")).otherwise(pair(days, "d", h % 24, "h"))


def duration(ms: Column) -> Column:
    """`45s`, `1m 15s` (below ten minutes), `38m`, `2h 10m`, `3d 4h`."""
    return _units(ms, " ", 600)


def compact(ms: Column) -> Column:
    """`45s`, `38m`, `1h12m`, `2d4h`."""
    return _units(ms, "", 60)


def local(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), zone)


def clock(ms: Column, now: int, zone: str) -> Column:
    """Local time, with the date where it isn't today's."""
    at, today = local(ms, zone), local(F.lit(now), zone)
    time = F.date_format(at, "HH:mm")
    return F.when(F.to_date(at) == F.to_date(today), time).otherwise(F.concat(F.date_format(at, "MMM d"), F.lit(" "), time))


#: The hours at which parts of a day begin; the steps of a countdown in minutes.
PARTS = ((6, "morning"), (12, "afternoon"), (18, "evening"), (22, "night"))
STEPS = ((5, "<5m"), (10, "<10m"), (15, "<15m"), (20, "<20m"), (30, "<30m"), (45, "<45m"), (60, "<1h"), (90, "<1.5h"), (120, "<2h"), (180, "<3h"), (240, "<4h"), (360, "<6h"), (480, "<8h"), (720, "<12h"), (1080, "<18h"), (1440, "<24h"))


def roughly(ms: Column, now: int, zone: str) -> Column:
    """A day and a part of it: `~this evening`, `~tonight`, `~tomorrow morning`, `~Sun evening`, `~next Wed night`."""
    at, today = local(ms, zone), local(F.lit(now), zone)
    hour = F.hour(at)
    part = F.lit("night")
    for begins, name in PARTS:
        part = F.when(hour >= begins, name).otherwise(part)
    day = F.when(hour < PARTS[0][0], F.date_sub(F.to_date(at), 1)).otherwise(F.to_date(at))
    ahead, weekday = F.datediff(day, F.to_date(today)), F.date_format(day, "EEE")
    return (
        F.when(ahead < 0, "~tonight")
        .when(ahead == 0, F.when(part != "night", F.concat(F.lit("~this "), part)).when(F.hour(today) < PARTS[0][0], F.concat(F.lit("~"), weekday, F.lit(" night"))).otherwise("~tonight"))
        .when(ahead == 1, F.concat(F.lit("~tomorrow "), part)).otherwise(F.concat(F.when(ahead >= 7, "~next ").otherwise("~"), weekday, F.lit(" "), part))
    )


def countdown(ms: Column, now: int) -> Column:
    """The time left rounded up to the next step; whole days, up, beyond one."""
    left = ms - now
    out = F.when(left < 60_000, "now")
    for minutes, name in STEPS:
        out = out.when(left <= minutes * 60_000, name)
    return out.otherwise(F.concat(F.lit("~"), F.ceil(left / 86_400_000).cast("string"), F.lit("d")))
