"""Questions asked of the star (C11-C14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.scalars import annualised, days_between, guarded_ratio


def _sold(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("is_sold") & F.col("sale_price").isNotNull())


def suburb_monthly_market(fact: DataFrame, dim_date: DataFrame, dim_suburb: DataFrame) -> DataFrame:
    """A row for every suburb and month of the calendar that has events anywhere, also months without listings.

    The grid crosses two dimensions, whose sizes don't follow the events; events are aggregated before
    they meet it, so windows run over suburbs times months.
    """
    monthly = fact.join(dim_date.select(F.col("date_day").alias("event_date"), "month_start"), "event_date")
    measured = monthly.groupBy("suburb_key", "month_start").agg(
        F.count("*").alias("listings"), F.count_if("is_sold").alias("sales"), F.count("sale_price").alias("disclosed_sales"),
        F.median("sale_price").alias("median_sale_price"), F.avg("sale_price").alias("avg_sale_price"), F.avg(guarded_ratio("sale_price", "rooms")).alias("avg_price_per_room"),
    )
    grid = dim_suburb.select("suburb_key", "suburb_name", "region_name").crossJoin(dim_date.select("month_start").distinct())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    joined = grid.join(measured, ["suburb_key", "month_start"], "left").select(
        "suburb_key", "suburb_name", "region_name", "month_start", zero("listings"), zero("sales"), zero("disclosed_sales"),
        "median_sale_price", "avg_sale_price", "avg_price_per_room", guarded_ratio("sales", "listings").alias("clearance_rate"),
    )
    over = Window.partitionBy("suburb_key").orderBy("month_start")
    before = F.lag("median_sale_price").over(over)
    ranked = Window.partitionBy("month_start", "region_name").orderBy(F.col("listings").desc())
    return joined.select(
        "*", before.alias("prev_month_median_sale_price"), (F.col("median_sale_price") - before).alias("median_sale_price_mom_change"),
        F.avg("median_sale_price").over(over.rowsBetween(-2, 0)).alias("median_sale_price_3m_avg"), F.lag("clearance_rate").over(over).alias("prev_month_clearance_rate"),
        F.dense_rank().over(ranked).cast("bigint").alias("rank_by_listings_in_region"),
    )


def agent_performance(fact: DataFrame, dim_agent: DataFrame, dim_suburb: DataFrame, dim_date: DataFrame) -> DataFrame:
    rows = (
        fact.join(dim_agent, "agent_key").join(dim_suburb.select("suburb_key", "region_name"), "suburb_key")
        .join(dim_date.select(F.col("date_day").alias("event_date"), "month_start"), "event_date")
    )
    per = rows.groupBy("agent_key", "agent_name", "region_name", "month_start").agg(
        F.count("*").alias("listings"), F.count_if("is_sold").alias("sales"), F.count_if("is_auction").alias("auction_listings"),
        F.coalesce(F.sum("sale_price"), F.lit(0.0)).alias("gmv"), F.median("sale_price").alias("median_sale_price"),
    )
    place = Window.partitionBy("month_start", "region_name")
    return per.select(
        "*", guarded_ratio("sales", "listings").alias("clearance_rate"), guarded_ratio("auction_listings", "listings").alias("auction_share"),
        guarded_ratio(F.col("gmv"), F.sum("gmv").over(place)).alias("region_gmv_share"),
        F.dense_rank().over(place.orderBy(F.col("gmv").desc())).cast("bigint").alias("rank_by_gmv_in_region"),
    )


def repeat_sales(fact: DataFrame, dim_property: DataFrame, dim_suburb: DataFrame, window_days: int = DEFAULTS.recapture_window_days) -> DataFrame:
    """Pairs of successive priced sales of a property more than ``window_days`` apart."""
    over = Window.partitionBy("property_key").orderBy("event_date", "sale_price")
    pairs = _sold(fact).select("property_key", "suburb_key", "event_date", "sale_price", F.lag("event_date").over(over).alias("previous_sale_date"), F.lag("sale_price").over(over).alias("previous_sale_price"))
    pairs = pairs.withColumn("days_held", days_between("previous_sale_date", "event_date")).filter(F.col("days_held") > window_days)
    ratio = guarded_ratio("sale_price", "previous_sale_price")
    return _labelled(pairs, dim_property, dim_suburb).select(
        "property_key", "street_address", "suburb_name", "region_name", "previous_sale_date", "previous_sale_price", F.col("event_date").alias("sale_date"), "sale_price", "days_held",
        (F.col("sale_price") - F.col("previous_sale_price")).alias("gain_amount"), (ratio - 1).alias("gain_pct"), annualised(ratio, F.col("days_held")).alias("annualised_return"),
    )


def _labelled(rows: DataFrame, dim_property: DataFrame, dim_suburb: DataFrame) -> DataFrame:
    return rows.join(dim_property.select("property_key", "street_address"), "property_key").join(dim_suburb.select("suburb_key", "suburb_name", "region_name"), "suburb_key")


def vendor_expectation_gap(fact: DataFrame, dim_property: DataFrame, dim_suburb: DataFrame) -> DataFrame:
    """Each distinct bid with the first later day on which the property sold; a row for every priced sale of that day.

    Bids and sales stand in one window per property, in order of day: the first sale day after a bid is
    the least day of a sale in the range that follows.  So no pair of a bid and a sale is ever formed but
    those returned, where an inequality join would make all of them.
    """
    bids = fact.filter(~F.col("is_sold") & F.col("bid_amount").isNotNull()).select("property_key", "suburb_key", F.col("event_date").alias("bid_date"), "bid_amount").distinct()
    sales = _sold(fact).select("property_key", F.col("event_date").alias("sale_date"), F.col("sale_price").alias("eventual_sale_price"))
    day = F.unix_date("day")
    both = bids.select("property_key", F.col("bid_date").alias("day"), "suburb_key", "bid_amount", F.lit(False).alias("sale")).unionByName(
        sales.select("property_key", F.col("sale_date").alias("day"), F.lit(True).alias("sale")).distinct(), allowMissingColumns=True)
    later = Window.partitionBy("property_key").orderBy(day).rangeBetween(1, Window.unboundedFollowing)
    paired = both.withColumn("eventual_sale_date", F.min(F.when(F.col("sale"), F.col("day"))).over(later)).filter(~F.col("sale") & F.col("eventual_sale_date").isNotNull())
    out = paired.withColumnRenamed("day", "bid_date").join(sales.withColumnRenamed("sale_date", "eventual_sale_date"), ["property_key", "eventual_sale_date"])
    return _labelled(out, dim_property, dim_suburb).select(
        "property_key", "street_address", "suburb_name", "region_name", "bid_date", "bid_amount", "eventual_sale_date", "eventual_sale_price",
        (F.col("eventual_sale_price") - F.col("bid_amount")).alias("gap_amount"), (guarded_ratio("eventual_sale_price", "bid_amount") - 1).alias("gap_pct"),
        days_between("bid_date", "eventual_sale_date").alias("days_to_sale"),
    )
