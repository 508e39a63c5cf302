"""Dates as written: the calendar day never depends on a zone, the order of instants does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_or_null(text: Column) -> Column:
    """An ISO date and time with offset, years 1970 to 9999; an impossible offset becomes +00:00, anything else null."""
    body = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    zone = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    hours, minutes = zone.substr(2, 2).try_cast("int"), zone.substr(5, 2).try_cast("int")
    good = (zone == "Z") | ((hours <= 14) & (minutes < 60))
    year = body.substr(1, 4).try_cast("int")
    ok = (body != "") & F.try_to_timestamp(body, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return F.when(ok & year.between(1970, 9999), F.concat(body, F.when(good, zone).otherwise("+00:00")))


def instant(iso: Column) -> Column:
    return F.try_to_timestamp(iso)


def earliest(iso: Column) -> Column:
    """Aggregate: the text of the earliest instant, the smaller text of equal ones."""
    return F.min_by(iso, F.struct(instant(iso), iso))


def latest(iso: Column) -> Column:
    """Aggregate: the text of the latest instant, the smaller text of equal ones."""
    return F.min_by(iso, F.struct((-F.unix_micros(instant(iso))).alias("at"), iso.alias("text")))


def label(bucket: Column, grain: str) -> Column:
    """A bucket's first day as people write it: 2026-03-09, 2026-03, Q1 2026, 2026."""
    return {
        "day": F.date_format(bucket, "yyyy-MM-dd"),
        "week": F.date_format(bucket, "yyyy-MM-dd"),
        "month": F.date_format(bucket, "yyyy-MM"),
        "quarter": F.concat(F.lit("Q"), F.quarter(bucket).cast("string"), F.lit(" "), F.year(bucket).cast("string")),
        "year": F.year(bucket).cast("string"),
    }[grain]


def last_day(bucket: Column, grain: str) -> Column:
    """A bucket's last day from its first."""
    return {
        "day": bucket,
        "week": F.date_add(bucket, 6),
        "month": F.last_day(bucket),
        "quarter": F.last_day(F.add_months(bucket, 2)),
        "year": F.last_day(F.add_months(bucket, 11)),
    }[grain]


def long_form(iso: Column) -> Column:
    """10 March 2026, the day as written."""
    return F.date_format(F.to_date(iso.substr(1, 10)), "d MMMM yyyy")


def stale(seen: Column, now: Column, days: int = 7) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp")) > days * 86_400_000_000


#: How prose writes dates (fixed values): a month, written out or cut short, and a day, ordinal or not.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_MONTH = rf"(?:{MONTHS}|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_EDGES = (r"(?i)(?<![A-Za-z0-9_])", r"(?![\p{L}\p{N}])")
#: "14 March 2026", "March 14th, 2026", "March 2026", "2026-03-14" with or without a time, "2026-03", "2026".
STATED = rf"(?:{_DAY}\s+{_MONTH}\s+\d{{4}}|{_MONTH}\s+{_DAY},?\s+\d{{4}}|{_MONTH}\s+\d{{4}}|\d{{4}}-\d{{2}}(?:-\d{{2}}(?:T[\d:.]+(?:Z|[+-]\d{{2}}:?\d{{2}})?)?)?|(?:19|20)\d{{2}})"
#: "between January and March 2026": the first month takes the year that closes the range.
MONTH_RANGE = rf"(?:between|from)\s+({_MONTH})\s+(?:and|to|until|through)\s+{_MONTH}\s+(\d{{4}})"


def _month_number(text: Column) -> Column:
    """1 to 12 of the first word of three letters or more, 0 without one."""
    short = F.substring(F.lower(F.regexp_extract(text, r"[A-Za-z]{3,}", 0)), 1, 3)
    return F.when(short == "", 0).otherwise(F.floor((F.position(short, F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)).cast("int")


def _named(text: Column, year: Column, month: Column, day: Column, refused: Column) -> Column:
    """(text, from, to): the days that a date names, both '' where there is no such day; month and day are 0 where not written."""
    no_month, no_day = month == 0, day == 0
    first = F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    most = F.day(F.last_day(first))
    bad = refused | (month > 12) | (~no_month & (day > most))
    shown = lambda m, d: F.format_string("%04d-%02d-%02d", year, m, d)
    begin = shown(F.greatest(month, F.lit(1)), F.greatest(day, F.lit(1)))
    end = shown(F.when(no_month, 12).otherwise(month), F.when(~no_day, day).when(no_month, 31).otherwise(most))
    return F.struct(text.alias("text"), F.when(bad, "").otherwise(begin).alias("from"), F.when(bad, "").otherwise(end).alias("to"))


def stated_dates(text: Column) -> Column:
    """Array of (text, from, to): the dates that a text states, as the days they name, inclusive. First those months that a range gives a year, then all dates
    in order. A month without a year is none; a day or month that does not exist has empty bounds. Null gives null."""
    number = lambda m, pattern: F.coalesce(F.nullif(F.regexp_extract(m, pattern, 1), F.lit("")).cast("int"), F.lit(0))

    def read(m: Column) -> Column:
        iso = m.rlike(r"^\d{4}(?:-|$)")
        year = F.when(iso, number(m, r"^(\d{4})")).otherwise(number(m, r"(\d{4})$"))
        month = F.when(iso, number(m, r"^\d{4}-(\d{2})")).otherwise(_month_number(m))
        day = F.when(iso, number(m, r"^\d{4}-\d{2}-(\d{2})")).otherwise(number(m, r"(?i)^(?:[a-z]+\.?\s+)?(\d{1,2})(?:st|nd|rd|th)?,?\s"))
        written_day = m.rlike(r"^\d{4}-\d{2}-|^\d{1,2}\D|(?i)^[a-z]+\.?\s+\d{1,2}\D")
        return _named(m, year, month, day, (written_day & (day == 0)) | (m.rlike(r"^\d{4}-") & (month == 0)))

    def opened(r: Column) -> Column:
        month = F.regexp_extract(r, _EDGES[0] + MONTH_RANGE, 1)
        return _named(month, number(r, r"(\d{4})$"), _month_number(month), F.lit(0), F.lit(False))

    ranges = F.regexp_extract_all(text, F.lit(_EDGES[0] + MONTH_RANGE + _EDGES[1]), F.lit(0))
    dates = F.regexp_extract_all(text, F.lit(_EDGES[0] + STATED + _EDGES[1]), F.lit(0))
    return F.concat(F.transform(ranges, opened), F.transform(dates, read))
