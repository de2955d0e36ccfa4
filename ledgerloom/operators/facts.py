"""The fact table (C10): keys are computed from the row, not joined from dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.keys import surrogate_key


def fact_listing_outcome(deduped: DataFrame) -> DataFrame:
    return deduped.select(
        surrogate_key("business_signature", "event_date").alias("listing_outcome_key"), surrogate_key("suburb_key", "street_address_key").alias("property_key"),
        "suburb_key", "agent_key", "event_date", "method_code", "type_code", "rooms", "sale_price", "bid_amount", "sale_price_is_disclosed", "is_sold", "is_auction", "load_id", "source_row",
    )
