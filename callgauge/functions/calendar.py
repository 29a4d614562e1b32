"""Quarter labels, call dates and day differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUARTER_LABEL = r"^\s*[Qq]([1-4])\s+(\d{4})\s*$"


def quarter_end(label: Column) -> Column:
    """``'Q2 2023'`` to 2023-06-30; null for anything else."""
    q = F.regexp_extract(label, QUARTER_LABEL, 1).try_cast("int")
    y = F.regexp_extract(label, QUARTER_LABEL, 2).try_cast("int")
    return F.when(q.isNotNull() & (y > 0), F.last_day(F.make_date(y, q * 3, F.lit(1))))


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date).cast("string"), F.lit(" "), F.year(date).cast("string"))


def quarter_of_month_abbr(abbr: Column) -> Column:
    """``'Apr'`` to ``'Q2'``; null for anything that is no English month abbreviation."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    month = F.array_position(F.array(*[F.lit(n) for n in names]), abbr)
    return F.when(month > 0, F.concat(F.lit("Q"), F.ceil(month / 3).cast("string")))


def call_date_after_quarter(label: Column, days: int = 21) -> Column:
    """Quarter end plus a few weeks: the usual time of the call."""
    return F.date_add(quarter_end(label), days)


def call_date_month_end(label: Column) -> Column:
    """End of the month after the quarter's end."""
    return F.last_day(F.add_months(quarter_end(label), 1))


def to_utc(ts: Column) -> Column:
    """Text with or without zone offset to a timestamp (session zone UTC); bad text is null."""
    return F.try_to_timestamp(ts)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("int")


def event_date(own: Column, label: Column) -> Column:
    """The record's own date, else the end of its quarter."""
    return F.coalesce(own.try_cast("date"), quarter_end(label))
