"""Clocks and time parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(site: Column, published: Column, first_seen: Column) -> Column:
    """Publication, else first sight; for subscription feeds publication alone."""
    return F.when(site == "opmlrss", published).otherwise(F.coalesce(published, first_seen))


def retention_time(last_seen: Column, published: Column, first_seen: Column, now: Column) -> Column:
    return F.coalesce(last_seen, published, first_seen, now)


def epoch(value: Column) -> Column:
    """Seconds, or milliseconds above 1e10, as a timestamp."""
    n = value.cast("double")
    return F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n))


def relative(text: Column, now: Column) -> Column:
    """'N minutes/hours/days ago' in English or Chinese, 'just now', 'yesterday', a clock time of today ('HH:MM'), or a
    month and day in Chinese; else null. A clock time over 5 minutes ahead is yesterday's, a date over 2 days ahead last
    year's; a year before the month doesn't count. The first of these that fits decides; clocks are read in UTC."""
    text = F.trim(text)
    n = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("int")
    back = lambda c, unit: now - F.make_dt_interval(**{unit: c})
    minutes, hours, days = n(r"(\d+)\s*(?:分钟|minutes? ago)"), n(r"(\d+)\s*(?:小时|hours? ago)"), n(r"(\d+)\s*(?:天|days? ago)")
    clock, date = r"^(?:今天)?\s*(\d{1,2}):(\d{2})$", r"^(?:\d{4}年\s*)?(\d{1,2})月(\d{1,2})日$"
    midnight = F.date_trunc("day", now)
    at = F.when((n(clock) < 24) & (n(clock, 2) < 60), midnight + F.make_dt_interval(hours=n(clock), mins=n(clock, 2)))
    day = lambda year: F.try_make_timestamp(year, n(date), n(date, 2), F.lit(0), F.lit(0), F.lit(0))
    this = day(F.year(now))
    return (
        F.when(minutes.isNotNull(), back(minutes, "mins"))
        .when(hours.isNotNull(), back(hours, "hours"))
        .when(days.isNotNull(), back(days, "days"))
        .when(text.rlike("刚刚|just now"), now)
        .when(text.rlike("昨天|yesterday"), back(F.lit(1), "days"))
        .when(at > now + F.make_dt_interval(mins=F.lit(5)), at - F.make_dt_interval(days=F.lit(1)))
        .when(at.isNotNull(), at)
        .when(this > now + F.make_dt_interval(days=F.lit(2)), day(F.year(now) - 1))
        .otherwise(this)
    )


# Zone names with their offset from UTC in seconds.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "CET": 3600, "CEST": 7200, "EST": -18000, "EDT": -14400, "PST": -28800, "PDT": -25200, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "BST": 3600, "JST": 32400}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_CLOCK = r"(?:[T\s,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp][Mm])?)?"
_ZONE = r"\s*(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})?(?:\s*\([A-Z]+\))?\s*$"
_WEEKDAY = r"^\s*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it refers to many times, with the value's expression standing in the plan only once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date(text: Column, pattern: str, year: int, month: int, day: int, clock: int) -> Column:
    """A timestamp from a pattern's groups; null where it doesn't match or names no date. Without zone it is UTC."""
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    said = part(month)
    of_name = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(said, 1, 3))), F.lit(0)).cast("int")
    number = F.coalesce(said.try_cast("int"), of_name)
    hour, half = F.coalesce(part(clock).cast("int"), F.lit(0)), F.lower(part(clock + 3))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    zone = part(clock + 4)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    offset = F.coalesce(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.upper(F.coalesce(zone, F.lit("UTC")))], numeric)
    at = F.try_make_timestamp(part(year).cast("int"), number, part(day).cast("int"), hour, F.coalesce(part(clock + 1).cast("int"), F.lit(0)), F.coalesce(part(clock + 2).cast("int"), F.lit(0)))
    return at - F.make_dt_interval(secs=offset)


def parse_date(text: Column) -> Column:
    """A written date or time as a timestamp: ISO and its relatives, mail and feed dates, American ones; zones by offset
    or by a known name. The session's time zone is UTC. What fits no form is null."""
    return bound(F.trim(text), _written)


def _written(text: Column) -> Column:
    return F.coalesce(
        _date(text, r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK + _ZONE, 1, 2, 3, 4),
        _date(text, "(?i)" + _WEEKDAY + r"(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?,?[\s-]+(\d{4})" + _CLOCK + _ZONE, 3, 2, 1, 4),
        _date(text, "(?i)" + _WEEKDAY + r"([a-z]{3})[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _CLOCK + _ZONE, 3, 1, 2, 4),
    )


def parse_any(value: Column, now: Column) -> Column:
    """What a source gives as a time, as text: an epoch, a relative time, else a written date; null if nothing fits."""
    shown = r"(\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}:\d{2}[AP]M)\s+UTC"

    def read(said: Column) -> Column:
        number = F.when(said.rlike(r"^(\d{9,11}|\d{12,})$"), epoch(said.try_cast("double")))
        written = F.coalesce(F.nullif(F.regexp_extract(said, shown, 1), F.lit("")), said)
        return F.coalesce(number, relative(said, now), parse_date(written))

    return bound(F.nullif(F.regexp_replace(F.trim(value), r"^\$D", ""), F.lit("")), read)


def iso(at: Column) -> Column:
    """A time as the published files have it; null stays null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86400e6


def evaluation_time(published: Column, first_seen: Column, last_seen: Column) -> Column:
    """The clock of replays: publication, else first, else last sight."""
    return F.coalesce(published, first_seen, last_seen)


def year_month(heading: Column) -> Column:
    """struct(year, month) of a heading that names them; null without."""
    pattern = r"(20\d{2})\s*年\s*(\d{1,2})\s*月"
    part = lambda i: F.nullif(F.regexp_extract(heading, pattern, i), F.lit("")).cast("int")
    return F.when(heading.rlike(pattern), F.struct(part(1).alias("year"), part(2).alias("month")))


def month_day(heading: Column) -> Column:
    """struct(month, day) of a heading that names them; null without."""
    pattern = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    part = lambda i: F.nullif(F.regexp_extract(heading, pattern, i), F.lit("")).cast("int")
    return F.when(heading.rlike(pattern), F.struct(part(1).alias("month"), part(2).alias("day")))
