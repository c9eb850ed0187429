"""Date window defaults and day-granular range predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day format, default window (last 14 days including today),
# furthest allowed end date (one year ahead).
DATE_FMT = "%Y-%m-%d"
DEFAULT_WINDOW_DAYS = 14
MAX_FUTURE_DAYS = 365


def parse_day(value: str | dt.date | dt.datetime) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, DATE_FMT).date()


def default_window(
    min_date: str | dt.date,
    today: dt.date,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
) -> tuple[dt.date, dt.date]:
    """Configured pair if both are set, else the last 14 days incl. today;
    both ends clamped to ``min_date``."""
    lo = parse_day(min_date)
    if start is not None and end is not None:
        s, e = parse_day(start), parse_day(end)
    else:
        e = today
        s = today - dt.timedelta(days=DEFAULT_WINDOW_DAYS - 1)
    return max(s, lo), max(e, lo)


def check_window(start: dt.date, end: dt.date, min_date: str | dt.date, today: dt.date) -> None:
    """Reject a user range before ``min_date`` or beyond one year ahead."""
    lo, hi = parse_day(min_date), today + dt.timedelta(days=MAX_FUTURE_DAYS)
    for d in (start, end):
        if d < lo or d > hi:
            raise ValueError(f"date {d} outside [{lo}, {hi}]")


def day_range(col: str | Column, start, end, dtype: T.DataType | None = None) -> Column:
    """Inclusive day range on a timestamp column: ``start 00:00 <= ts < end+1d``.

    Written as two plain comparisons against literals of the column's own type
    so the predicate is pushed into the Parquet scan.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = parse_day(start)
    e = parse_day(end) + dt.timedelta(days=1)
    if isinstance(dtype, T.DateType):
        return (c >= F.lit(s)) & (c < F.lit(e))
    cast = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    lo = F.lit(s.strftime(DATE_FMT)).cast(cast)
    hi = F.lit(e.strftime(DATE_FMT)).cast(cast)
    return (c >= lo) & (c < hi)
