"""Dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import surrogate_key
from ..functions.scalars import month_start


def canonical_name(rows: DataFrame, keys: str | Sequence[str], name: str, into: str | None = None) -> DataFrame:
    """The most frequent spelling per key, the first in binary order among equals.

    Two aggregations that combine before their shuffles; no window has to sort a hot key's rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    counted = rows.groupBy(*keys, name).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(name).isNull().alias("none"), F.col(name).alias("name")))
    return counted.groupBy(*keys).agg(best.getField("name").alias(into or name))


def dim_suburb(deduped: DataFrame) -> DataFrame:
    """One row per suburb: canonical name and the least of each attribute (A8, J7), in one pass: by spelling, then by suburb."""
    attributes = ("postcode", "region_name", "council_area", "cbd_distance_km", "property_count")
    spelled = deduped.groupBy("suburb_key", "suburb_name").agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in attributes])
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("suburb_name").isNull().alias("none"), F.col("suburb_name").alias("name")))
    return spelled.groupBy("suburb_key").agg(best.getField("name").alias("suburb_name"), *[F.min(c).alias(c) for c in attributes])


def dim_property(deduped: DataFrame) -> DataFrame:
    named = canonical_name(deduped, ("suburb_key", "street_address_key"), "street_address")
    return named.select(surrogate_key("suburb_key", "street_address_key").alias("property_key"), "suburb_key", "street_address_key", "street_address")


def dim_agent(deduped: DataFrame) -> DataFrame:
    return canonical_name(deduped, "agent_key", "agent_name").select("agent_key", "agent_name")


def dim_date(rows: DataFrame, date_column: str = "event_date") -> DataFrame:
    """Every day from the first of the first month to the end of the last."""
    ends = rows.agg(month_start(F.min(date_column)).alias("a"), F.last_day(F.max(date_column)).alias("b")).filter("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date_day"))
    dow = (F.dayofweek("date_day") - 1).cast("bigint")
    return days.select(
        "date_day", F.year("date_day").cast("bigint").alias("calendar_year"), F.month("date_day").cast("bigint").alias("calendar_month"),
        month_start("date_day").alias("month_start"), F.date_format("date_day", "yyyy-MM").alias("year_month"), dow.alias("day_of_week"),
        F.date_format("date_day", "EEEE").alias("day_name"), (dow == 6).alias("is_saturday"),
    )


def dim_sale_method(methods: DataFrame) -> DataFrame:
    return methods.select("method_code", "method_description", "is_sold", "is_auction")


def dim_property_type(types: DataFrame) -> DataFrame:
    return types.select("type_code", "type_description")
