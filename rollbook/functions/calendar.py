"""Periods are strings that sort by time: 'YYYY-MM' or 'YYYY-Qn'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(period: Column) -> tuple[Column, Column, Column]:
    year = F.substring(period, 1, 4).cast("int")
    is_quarter = F.substring(period, 6, 1) == F.lit("Q")
    tail = F.regexp_extract(period, r"(\d+)$", 1).cast("int")
    return year, is_quarter, tail


def period_ordinal(period: Column) -> Column:
    """Calendar number of a period in its own unit, so neighbours differ by one."""
    year, is_quarter, tail = _parts(period)
    return F.when(is_quarter, year * 4 + tail).otherwise(year * 12 + tail)


def month_ordinal(period: Column) -> Column:
    """Calendar month number; a quarter counts as its last month."""
    year, is_quarter, tail = _parts(period)
    return year * 12 + F.when(is_quarter, tail * 3).otherwise(tail)


def quarter_of(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def short_date(ts: Column) -> Column:
    """'YY/MM/DD' as in the raw lines."""
    return F.date_format(ts, "yy/MM/dd")


def last_saturday(day: Column) -> Column:
    """Saturday on or before the day."""
    return F.date_sub(day, F.dayofweek(day) % 7)


def us_date(text: Column) -> Column:
    """'m/d/yyyy' to a date, NULL when malformed or not a calendar day."""
    body = F.trim(text)
    ok = body.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(ok, F.try_to_timestamp(body, F.lit("M/d/yyyy")).cast("date"))


def month_year_date(text: Column) -> Column:
    """'Nov 2038' to the first day of that month; 'N/A' and malformed text to NULL."""
    body = F.initcap(F.trim(text))
    ok = body.rlike(r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}$")
    return F.when(ok, F.try_to_timestamp(body, F.lit("MMM yyyy")).cast("date"))
