"""The contract on built tables, as data: what is filled, unique, refers to what, has which values, and is true of rows.

``checks`` gives each rule's violations.  What can be seen in a row alone (nulls, values, expressions) is counted
in one pass per table, however many rules it has; uniqueness and references take an aggregation or an anti join each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..operators import duplicates, quality
from .incremental import PROPERTY

FILLED = {
    "stg_listing_outcome": ("suburb_key", "suburb_name", "street_address_key", "method_code", "type_code", "event_date", "agent_key", "postcode", "load_id", "source_row", "load_started_at"),
    "int_listing_outcome": ("is_sold", "sale_price_is_disclosed"),
    "int_listing_outcome_clustered": ("dq_status", "business_signature", "surviving_event_date"),
    "int_listing_outcome_deduped": ("event_date", "is_sold"),
    "quarantined_listing_outcome": ("quarantine_key", "reason", "surviving_event_date"),
    "dim_suburb": ("suburb_key", "suburb_name", "postcode", "region_name", "council_area"),
    "dim_property": ("property_key", "suburb_key"),
    "dim_agent": ("agent_key", "agent_name"),
    "dim_date": ("date_day", "month_start", "is_saturday"),
    "dim_sale_method": ("method_code", "is_sold", "is_auction"),
    "dim_property_type": ("type_code",),
    "fact_listing_outcome": ("listing_outcome_key", "property_key", "suburb_key", "agent_key", "event_date", "method_code", "type_code", "is_sold"),
    "analytics_suburb_monthly_market": ("suburb_key", "month_start", "listings"),
    "analytics_agent_performance": ("agent_key", "month_start"),
    "analytics_repeat_sales": ("property_key", "days_held"),
    "analytics_vendor_expectation_gap": ("property_key", "bid_amount", "eventual_sale_price"),
}

VALUES = {
    "int_listing_outcome_clustered": {"dq_status": (duplicates.OK, duplicates.EXACT, duplicates.RESTATED, duplicates.RECAPTURED)},
    "quarantined_listing_outcome": {"reason": (duplicates.EXACT, duplicates.RESTATED, duplicates.RECAPTURED)},
}

TRUE = {
    "int_listing_outcome": {"one price at most": "not (sale_price is not null and bid_amount is not null)"},
    "fact_listing_outcome": {
        "one price at most": "not (sale_price is not null and bid_amount is not null)",
        "no bid on a sold row": "not (is_sold and bid_amount is not null)",
        "no sale price on an unsold row": "not (not is_sold and sale_price is not null)",
    },
    "analytics_suburb_monthly_market": {"clearance_rate within 0..1": "clearance_rate is null or clearance_rate between 0 and 1", "sales within listings": "sales <= listings"},
    "analytics_repeat_sales": {"days_held above 0": "days_held > 0"},
}

UNIQUE = (
    ("stg_listing_outcome", "load_id", "source_row"), ("int_listing_outcome_clustered", "load_id", "source_row"), ("quarantined_listing_outcome", "quarantine_key"),
    ("dim_suburb", "suburb_key"), ("dim_property", "property_key"), ("dim_agent", "agent_key"), ("dim_date", "date_day"), ("dim_sale_method", "method_code"),
    ("dim_property_type", "type_code"), ("fact_listing_outcome", "listing_outcome_key"), ("analytics_suburb_monthly_market", "suburb_key", "month_start"),
    ("analytics_agent_performance", "agent_key", "region_name", "month_start"),
)

#: Table, column, table it refers to, column there.
REFERENCES = (
    ("stg_listing_outcome", "method_code", "dim_sale_method", "method_code"), ("stg_listing_outcome", "type_code", "dim_property_type", "type_code"),
    ("dim_property", "suburb_key", "dim_suburb", "suburb_key"), ("fact_listing_outcome", "property_key", "dim_property", "property_key"),
    ("fact_listing_outcome", "suburb_key", "dim_suburb", "suburb_key"), ("fact_listing_outcome", "agent_key", "dim_agent", "agent_key"),
    ("fact_listing_outcome", "event_date", "dim_date", "date_day"), ("fact_listing_outcome", "method_code", "dim_sale_method", "method_code"),
    ("fact_listing_outcome", "type_code", "dim_property_type", "type_code"), ("analytics_suburb_monthly_market", "suburb_key", "dim_suburb", "suburb_key"),
    ("analytics_agent_performance", "agent_key", "dim_agent", "agent_key"), ("analytics_repeat_sales", "property_key", "dim_property", "property_key"),
    ("analytics_vendor_expectation_gap", "property_key", "dim_property", "property_key"),
)


def row_rules(name: str) -> dict[str, Column]:
    """The rules of a table that a row alone can break."""
    rules = {f"{c} is filled": F.col(c).isNotNull() for c in FILLED.get(name, ())}
    rules |= {f"{c} is known": F.col(c).isin(*values) for c, values in VALUES.get(name, {}).items()}
    return rules | {what: F.expr(e) for what, e in TRUE.get(name, {}).items()}


def checks(table: Callable[[str], DataFrame], config: Config = DEFAULTS, changed: Callable[[str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Name of each check to its violations, none if the tables are sound.

    ``changed`` gives what a run wrote of a table, if that isn't all.  What a row alone can break, and what can only
    be broken inside a property or a load, is looked for there; references and counts take whole tables, of which
    they read key columns.
    """
    new = changed or table
    clustered = new("int_listing_outcome_clustered")
    out = {"row ledger": quality.ledger(table("stg_listing_outcome"), table("fact_listing_outcome"), table("quarantined_listing_outcome"))}
    out |= {f"rules of {name}": quality.broken(new(name), row_rules(name)) for name in FILLED}
    out |= {f"repeated {', '.join(key)} in {name}": quality.repeated(new(name), *key) for name, *key in UNIQUE}
    out |= {f"{column} of {name} not in {other}": quality.orphans(table(name), column, table(other), key) for name, column, other, key in REFERENCES}
    out["suburb attributes vary"] = quality.undetermined(table("int_listing_outcome_deduped"), "suburb_key", ["postcode", "region_name", "council_area", "cbd_distance_km", "property_count"])
    out["fact and property disagree on suburb"] = quality.disagreeing(new("fact_listing_outcome"), new("dim_property"), "property_key", "suburb_key")
    out["duplicate group spans properties"] = quality.spanning(clustered, PROPERTY)
    out["chain beyond lookback"] = quality.overlong(clustered, config.incremental_lookback_days)
    return out
