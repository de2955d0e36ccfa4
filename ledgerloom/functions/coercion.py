"""Typed reading of text fields with one reason code per failure.

Each function gives (value, reason): reason is null where the field is fine, blanks are null values.
Patterns stand before every cast because casts accept more than the contract does (``1d``, Unicode digits).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"^(?i)[+-]?(nan|inf|infinity)$"
DAY_FIRST = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
POSTCODE = r"^[0-9]{3,4}$"
EARLIEST = dt.date(1900, 1, 1)


def _reason(name: str, what: str) -> Column:
    return F.lit(f"{name}_{what}")


def to_int(text: Column, name: str) -> tuple[Column, Column]:
    value = F.when(text.rlike(INTEGER), text.try_cast("int"))
    reason = F.when(text == "", None).when(~text.rlike(INTEGER), _reason(name, "not_integer")).when(value.isNull(), _reason(name, "out_of_range"))
    return value, reason


def to_double(text: Column, name: str) -> tuple[Column, Column]:
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    endless = text.rlike(NOT_FINITE) | F.abs(value).isin(float("inf"))
    reason = F.when(text == "", None).when(F.coalesce(endless, F.lit(False)), _reason(name, "not_finite")).when(value.isNull(), _reason(name, "not_numeric"))
    return value, reason


def to_date(text: Column, name: str, today: dt.date) -> tuple[Column, Column]:
    value = F.when(text.rlike(DAY_FIRST) & ~text.endswith("/0000"), F.try_to_date(text, "d/M/yyyy"))
    reason = F.when(value.isNull(), _reason(name, "not_parseable")).when(value > F.lit(today), _reason(name, "in_future")).when(value < F.lit(EARLIEST), _reason(name, "implausible"))
    return value, reason


def to_postcode(text: Column, name: str) -> tuple[Column, Column]:
    return text, F.when(~text.rlike(POSTCODE), _reason(name, "invalid"))
