"""Staging and measures (C1, C2): names of the domain, keys and lineage; no row is dropped or merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_key


def unstaged(landing: DataFrame, staged: DataFrame, load_column: str = "_load_id") -> DataFrame:
    """Landing rows of loads that the log doesn't have (J2): an anti join, so null load ids on either side hide nothing.

    The side to look up is one row per load, far smaller than the log it is taken from.
    """
    have = staged.select(F.col("load_id").alias("__have")).distinct()
    return landing.join(have, F.col(load_column) == F.col("__have"), "left_anti")


def stage(landing: DataFrame, receipts: DataFrame) -> DataFrame:
    """Landing rows in the domain's vocabulary, with the time of their load."""
    shown = lambda c: F.trim(F.col(c))
    loads = receipts.select(F.col("load_id").alias("_load_id"), F.col("started_at").alias("load_started_at"))
    return landing.join(loads, "_load_id", "left").select(
        name_key("suburb").alias("suburb_key"), shown("suburb").alias("suburb_name"), shown("postcode").alias("postcode"),
        shown("regionname").alias("region_name"), shown("councilarea").alias("council_area"),
        F.col("distance").alias("cbd_distance_km"), F.col("propertycount").alias("property_count"),
        shown("address").alias("street_address"), name_key("address").alias("street_address_key"),
        "rooms", name_key("type").alias("type_code"), F.upper(shown("method")).alias("method_code"), F.col("date").alias("event_date"),
        name_key("sellerg").alias("agent_key"), shown("sellerg").alias("agent_name"), F.col("price").alias("reported_price"),
        F.col("_load_id").alias("load_id"), F.col("_source_row").alias("source_row"), "load_started_at",
    )


def derive_measures(staged: DataFrame, methods: DataFrame) -> DataFrame:
    """Split the reported price by what the method says happened.

    An unknown method drops its row, as the contract has it; check the codes first (``quality.orphans``).
    """
    flags = methods.select("method_code", "is_sold", "is_auction")
    price, sold = F.col("reported_price"), F.col("is_sold")
    return (
        staged.join(flags, "method_code")
        .withColumn("sale_price", F.when(sold, price)).withColumn("bid_amount", F.when(~sold, price))
        .withColumn("sale_price_is_disclosed", F.coalesce(sold & price.isNotNull(), F.lit(False)))
        .select(*[c for c in staged.columns if c != "reported_price"], "is_sold", "is_auction", "sale_price", "bid_amount", "sale_price_is_disclosed")
    )
