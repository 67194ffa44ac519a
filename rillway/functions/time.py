"""Date and time functions as column expressions. Texts that don't parse give null, never an error."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME, DATE, DATE_KEY, MINUTE_KEY = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "yyyyMMddHHmm"


def parse_time(c: Column, pattern: str = TIME) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def parse_date_key(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(DATE_KEY)).cast("date")


def before(a: Column, b: Column) -> Column:
    return F.coalesce(parse_time(a) < parse_time(b), F.lit(False))


def after(a: Column, b: Column) -> Column:
    return F.coalesce(parse_time(a) > parse_time(b), F.lit(False))


def minus_seconds(a: Column, b: Column) -> Column:
    """Whole seconds from b to a; 0 if either doesn't parse."""
    return F.coalesce(F.unix_timestamp(parse_time(a)) - F.unix_timestamp(parse_time(b)), F.lit(0)).cast("long")


def date_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH")


def format_date(ts: Column) -> Column:
    return F.date_format(ts, DATE)


def format_time(ts: Column) -> Column:
    return F.date_format(ts, TIME)


def format_date_key(ts: Column) -> Column:
    return F.date_format(ts, DATE_KEY)


def format_minute_key(ts: Column) -> Column:
    return F.date_format(ts, MINUTE_KEY)


def today(on: datetime.date | None = None) -> Column:
    """The given day, or the current one."""
    return F.lit(on) if on else F.current_date()


def yesterday(on: datetime.date | None = None) -> Column:
    return F.date_sub(today(on), 1)


def from_epoch_millis(c: Column) -> Column:
    """A timestamp from milliseconds as text; null if that isn't a number."""
    return F.timestamp_millis(c.try_cast("bigint"))


def whole_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))
