"""Scalar expressions of the models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_key(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def guarded_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null for a zero or null divisor."""
    return _col(a).cast("double") / F.nullif(_col(b).cast("double"), F.lit(0.0))


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end), _col(start)).cast("bigint")


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "MM")


def annualised(ratio: Column, days: Column) -> Column:
    """(ratio) ** (365 / days) - 1, null for zero days."""
    return F.pow(ratio, F.lit(365.0) / F.nullif(days.cast("double"), F.lit(0.0))) - 1
