"""ISO timestamps of many shapes as epoch milliseconds, by built-ins alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
#: The shapes of ISO 8601: dates, weeks, times and offsets, each with all of its marks or none.
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{4}-W\d{2}-\d|\d{4}-W\d{2}|\d{8}|\d{4}W\d{2}\d?)"
_CLOCK = r"(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
REST = rf"^(?:.({_CLOCK})(Z|[+-]{_CLOCK})?)?$"
MIDNIGHT = r"^[T ]24:00(:00([.,]0+)?)?($|Z|[+-])"
DAY_US = 86_400_000_000


def _clock(text: Column) -> tuple[Column, Column]:
    """(microseconds of a clock time, whether minutes and seconds are below 60); '' is midnight."""
    digits = F.rpad(F.regexp_replace(F.regexp_replace(text, r"[.,].*$", ""), ":", ""), 6, "0")
    two = lambda at: F.substring(digits, at, 2).cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"[.,](\d+)$", 1), 1, 6), 6, "0").cast("long")
    return ((two(1) * 60 + two(3)) * 60 + two(5)) * 1_000_000 + fraction, (two(3) < 60) & (two(5) < 60)


def _day(date: Column) -> Column:
    """Days since 1970 of a calendar or week date; null if there is no such day."""
    digits = F.regexp_replace(date, "[-W]", "")
    number = lambda at, n: F.substring(digits, at, n).cast("int")
    weekday = F.when(F.length(digits) == 7, number(7, 1)).otherwise(1)
    monday = F.date_add(F.trunc(F.make_date(F.greatest(number(1, 4), F.lit(1)), F.lit(1), F.lit(4)), "week"), (number(5, 2) - 1) * 7)
    in_year = (F.year(F.date_add(monday, 3)) == number(1, 4)) & number(5, 2).between(1, 53) & weekday.between(1, 7)
    calendar = F.try_to_date(F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)), "yyyy-MM-dd")
    return F.unix_date(F.when(number(1, 4) < 1, None).when(F.contains(date, F.lit("W")), F.when(in_year, F.date_add(monday, weekday - 1))).otherwise(calendar)).cast("long")


def _any_shape(text: Column) -> Column:
    """Microseconds of an ISO text of any shape; null for other texts."""
    date = F.regexp_extract(text, DATE, 1)
    rest = F.substr(text, F.length(date) + 1)
    time, zone = F.regexp_extract(rest, REST, 1), F.regexp_extract(rest, REST, 2)
    (at, fits), (off, off_fits) = _clock(time), _clock(F.regexp_replace(zone, "^[-+Z]", ""))
    fits = fits & ((at < DAY_US) | F.rlike(rest, F.lit(MIDNIGHT))) & off_fits & (off < DAY_US)
    east = F.when(F.startswith(zone, F.lit("-")), -off).otherwise(off)
    return F.when((date != "") & F.rlike(rest, F.lit(REST)) & fits, _day(date) * DAY_US + at - east)


def timestamp_ms(text: Column) -> Column:
    """Epoch ms of an ISO text (week dates, basic forms, offsets; no offset is UTC; 24:00 is the next midnight), half to even.

    The usual shape is one parse; the other shapes are a higher-order function, which is worked out for texts of such a shape alone and
    takes no room in generated code.
    """
    usual = F.coalesce(F.rlike(text, F.lit(USUAL)), F.lit(False))
    fast = F.when(usual, F.unix_micros(F.try_to_timestamp(text)))
    slow = F.get(F.transform(F.when(text.isNotNull() & fast.isNull(), F.array(text)), _any_shape), F.lit(0))
    return F.bround(F.coalesce(fast, slow) / 1000).cast("long")
