"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u0001"
NULL = "\u0002null\u0002"


def key_part(c: Column | str, kind: str | None = None) -> Column:
    """One value as text; doubles go through decimal(18,2), since engines print them differently."""
    c = F.col(c) if isinstance(c, str) else c
    if kind == "double":
        c = c.cast("decimal(18,2)")
    return F.coalesce(c.cast("string"), F.lit(NULL))


def surrogate_key(*columns: Column | str, doubles: tuple[str, ...] = ()) -> Column:
    """MD5 over the columns' texts; nulls compare equal, so two rows agree exactly if all their values do."""
    return F.md5(F.concat_ws(SEPARATOR, *[key_part(c, "double" if c in doubles else None) if isinstance(c, str) else key_part(c) for c in columns]))
