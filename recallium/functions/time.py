"""Dates and times: ages, weeks that begin on Sunday, ranges that phrases name, strict stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) / 1e6


def age_days(stamp: Column, now: str) -> Column:
    """Days between a stamp and the clock, with fraction."""
    return (F.unix_timestamp(F.lit(now)) - seconds(stamp)) / 86400


def whole_days(stamp: Column, now: str) -> Column:
    return F.floor(age_days(stamp, now))


def week_start(day: Column) -> Column:
    """The Sunday that begins the week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


#: Fixed values: (name, pattern); the range each names follows in ``phrase_range``.
PHRASES = [
    ("today", r"(?i)\btoday\b"),
    ("yesterday", r"(?i)\byesterday\b"),
    ("this week", r"(?i)\bthis week\b"),
    ("last week", r"(?i)\blast week\b"),
    ("this month", r"(?i)\bthis month\b"),
    ("last month", r"(?i)\blast month\b"),
    ("last days", r"(?i)\blast ([0-9]+) days?\b"),
    ("days ago", r"(?i)\b([0-9]+) days? ago\b"),
    ("weeks ago", r"(?i)\b([0-9]+) weeks? ago\b"),
]


def phrase_range(text: Column, today: Column) -> Column:
    """struct(first, last): the days that the first phrase found stands for, else nulls."""
    n = lambda p: F.coalesce(F.try_to_number(F.regexp_extract(text, p, 1), F.lit("999")).cast("int"), F.lit(0))
    patterns = dict(PHRASES)
    week, month = week_start(today), F.trunc(today, "month")
    spans = {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "this week": (week, today),
        "last week": (F.date_sub(week, 7), F.date_sub(week, 1)),
        "this month": (month, today),
        "last month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "last days": (F.date_sub(today, n(patterns["last days"])), today),
        "days ago": (F.date_sub(today, n(patterns["days ago"])),) * 2,
        "weeks ago": (F.date_sub(today, n(patterns["weeks ago"]) * 7), F.date_add(F.date_sub(today, n(patterns["weeks ago"]) * 7), 6)),
    }
    first, last = F.lit(None).cast("date"), F.lit(None).cast("date")
    for name, pattern in reversed(PHRASES):
        hit = text.rlike(pattern)
        first, last = F.when(hit, spans[name][0]).otherwise(first), F.when(hit, spans[name][1]).otherwise(last)
    return F.struct(first.alias("first"), last.alias("last"))


def rfc3339(text: Column) -> Column:
    """A strict stamp with an offset, else null; days that don't exist are null as well."""
    fits = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)$")
    return F.when(fits, F.try_to_timestamp(text))


def in_quiet_hours(hour: Column, first: int, last: int) -> Column:
    """Whether an hour lies in [first, last), which may go past midnight; equal bounds: never."""
    if first == last:
        return F.lit(False)
    return (hour >= first) & (hour < last) if first < last else (hour >= first) | (hour < last)
