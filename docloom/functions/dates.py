"""Dates as ISO strings, which are compared as strings, and periods named in questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: month names that a question may use
MONTHS = (
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11), ("december", 12),
    ("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("sept", 9), ("oct", 10), ("nov", 11), ("dec", 12),
)
_ISO = r"^\d{4}-\d{2}-\d{2}"


def iso_date(text: Column) -> Column:
    """The first ten characters if they are a calendar date, else null."""
    part = F.substring(text, 1, 10)
    return F.when(part.rlike(_ISO + "$"), F.try_to_date(part, "yyyy-MM-dd")).cast("string")


def date_prefix(text: Column) -> Column:
    """What stands before a `T`, trimmed, if it is a calendar date, else null."""
    part = F.substring_index(F.trim(text), "T", 1)
    return F.when(part.rlike(_ISO + "$"), F.try_to_date(part, "yyyy-MM-dd")).cast("string")


def next_day(date_to: str) -> str | None:
    """The day after the first ten characters; None for anything but a date, which then bounds nothing."""
    try:
        return (dt.date.fromisoformat(date_to[:10]) + dt.timedelta(days=1)).isoformat() if len(date_to) >= 10 else None
    except (ValueError, OverflowError):
        return None


def document_date(text: Column, today: dt.date) -> Column:
    """An ISO date from 1900 to a year and a day from today, else null."""
    d = date_prefix(text)
    return F.when(d.between("1900-01-01", (today + dt.timedelta(days=366)).isoformat()), d)


def date_for_tags(result: Column, existing: Column, today: dt.date) -> Column:
    return F.coalesce(date_prefix(result), date_prefix(existing), F.lit(today.isoformat()))


def _range(first: Column, months: int) -> Column:
    """From a first day (string) to the end of the months-th month; null if there is no such date."""
    start = F.try_to_date(first, "yyyy-MM-dd")
    return F.when(start.isNotNull(), F.struct(start.cast("string").alias("date_from"), F.last_day(F.add_months(start, months - 1)).cast("string").alias("date_to")))


def date_range(text: Column, today: dt.date) -> Column:
    """struct(date_from, date_to): the first rule that applies of ISO day, quarter, month, year, relative phrase; nulls if none does."""
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    iso = part(r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    day = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).cast("string")
    quarter_pattern = r"(?i)\bq([1-4])\s+(\d{4})\b"
    quarter, quarter_year = part(quarter_pattern, 1), part(quarter_pattern, 2)
    names = "|".join(sorted((n for n, _ in MONTHS), key=len, reverse=True))
    month_pattern = rf"(?i)\b({names})\s+(\d{{4}})\b"
    month, month_year = F.lower(part(month_pattern, 1)), part(month_pattern, 2)
    number = F.element_at(F.create_map(*[x for n, k in MONTHS for x in (F.lit(n), F.lit(f"{k:02d}"))]), month)
    year = part(r"\b((?:19|20|21)\d{2})\b(?!-)", 1)
    this = today.replace(day=1)
    last = (this - dt.timedelta(days=1)).replace(day=1)
    none = F.lit(None).cast("struct<date_from:string,date_to:string>")
    return F.coalesce(
        F.when(day.isNotNull(), F.struct(day.alias("date_from"), day.alias("date_to"))),
        F.when(quarter != "", _range(F.concat(quarter_year, F.lit("-"), F.lpad(((quarter.cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01")), 3)),
        F.when(month != "", _range(F.concat(month_year, F.lit("-"), number, F.lit("-01")), 1)),
        F.when(year != "", _range(F.concat(year, F.lit("-01-01")), 12)),
        F.when(text.rlike(r"(?i)\blast\s+month\b"), _range(F.lit(last.isoformat()), 1)),
        F.when(text.rlike(r"(?i)\bthis\s+month\b"), _range(F.lit(this.isoformat()), 1)),
        F.when(text.rlike(r"(?i)\blast\s+year\b"), _range(F.lit(f"{today.year - 1:04d}-01-01"), 12)),
        F.when(text.rlike(r"(?i)\bthis\s+year\b"), _range(F.lit(f"{today.year:04d}-01-01"), 12)),
        none,
    )


def utc_timestamp(text: Column) -> Column:
    """An ISO timestamp, taken as UTC if it names no zone, whatever the session's zone; null if it is none."""
    zoned = text.rlike(r"[T ].*(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(text.rlike(_ISO), F.when(zoned, text).when(text.rlike(_ISO + "$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))))


def normalise_timestamp(text: Column) -> Column:
    """`2024-06-01T12:00:00+00:00` for what is a timestamp; anything else as it is."""
    t = F.to_utc_timestamp(utc_timestamp(text), F.current_timezone())
    micros = F.date_format(t, "SSSSSS")
    shown = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))
    return F.coalesce(shown, text)


def seconds_to_midnight(ts: Column) -> Column:
    return F.unix_timestamp(F.date_add(F.to_date(ts), 1).cast("timestamp")) - F.unix_timestamp(ts)
