"""Predicates with optional parameters, and rounding."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(c: Column, low: Any | None, high: Any | None) -> Column:
    """low <= c <= high; passes if either bound is missing, fails on null."""
    if low is None or high is None:
        return F.lit(True)
    return F.coalesce(c.between(F.lit(low), F.lit(high)), F.lit(False))


def one_of(c: Column, values: Iterable[Any] | None) -> Column:
    """c is one of the values; passes without values, fails on null."""
    return F.lit(True) if values is None else F.coalesce(c.isin(list(values)), F.lit(False))


def any_of(c: Column, values: Iterable[Any] | None) -> Column:
    """The array c holds one of the values; passes without values, fails on null."""
    if values is None:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])), F.lit(False))


def equals(c: Column, value: Any | None) -> Column:
    """c is the value; passes without a value, fails on null."""
    return F.lit(True) if value is None else F.coalesce(c == F.lit(value), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded half up to two digits, in integers; null where whole is 0."""
    twice = F.lit(2) * whole
    hundredths = F.floor(F.try_divide((F.lit(200) * part + whole).cast("decimal(38,0)"), twice.cast("decimal(38,0)")))
    return hundredths.cast("double") / F.lit(100.0)


def round_half_up(c: Column, digits: int) -> Column:
    """A double rounded half up from its shortest decimal form."""
    return F.round(c, digits)
