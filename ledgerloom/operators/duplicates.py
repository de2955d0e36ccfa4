"""Duplicate classification (C3, C4): every row is ``ok`` or says why it isn't, in one shuffle.

Entities with more rows than a task should hold are classified apart (``classify_hot``), by the same rules.

All keys hold the entity's columns, so rows are dealt by entity once and every window below names the
entity in its partition: Catalyst adds no other exchange, and two sorts.  The number of tasks follows the number of
rows, so what a task sorts doesn't grow.  What isn't the current row of its restatement
group stays out of the recapture chain by being a window partition of its own, not by a filter and a join
back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.keys import surrogate_key
from ..sources.scratch import settle
from .pieces import chains


@dataclass(frozen=True)
class Roles:
    """Which columns play which part."""

    entity: Sequence[str] = ("suburb_key", "street_address_key")
    event: Sequence[str] = ("event_date", "method_code", "agent_key")  # with the entity: one event, perhaps stated twice
    content: Sequence[str] = ("rooms", "type_code", "sale_price", "bid_amount")
    offer: Sequence[str] = ("rooms", "type_code", "method_code", "agent_key", "sale_price", "bid_amount")  # with the entity: what is republished
    amounts: Sequence[str] = ("sale_price", "bid_amount")
    date: str = "event_date"
    loaded_at: str = "load_started_at"
    row: Sequence[str] = ("load_id", "source_row")


DEFAULT_ROLES = Roles()
OK, EXACT, RESTATED, RECAPTURED = "ok", "exact_duplicate", "suspected_restatement", "suspected_recapture"
#: Rows that a task of the classification holds while it sorts them; the shuffle has as many partitions as that takes.
ROWS_A_TASK = 100_000


def _ascending(*names: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in names]


def classify_duplicates(rows: DataFrame, roles: Roles = DEFAULT_ROLES, window_days: int = DEFAULTS.recapture_window_days, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """Append ``business_signature``, the chain's columns and ``dq_status``.

    * Restatements: of rows with the same entity and event the latest load stands, then one that has an
      amount, then the first row of the source (then the load id, so that no tie is left open).
    * Recaptures: of standing rows with the same offer, those at most ``window_days`` after the one before
      form a chain; the first stands.  Nulls compare equal.

    With ``hot_rows``, entities of more rows than that, counted first, go through ``classify_hot``; ``rows`` is
    then read twice and should be a table.  There are at most one in ``hot_rows`` rows of them.

    ``at_most``: how many rows there may be, from which follows over how many tasks they are dealt; they are counted
    if it isn't given.
    """
    parts = tasks_for(rows, rows.count() if at_most is None else at_most)
    if hot_rows is None:
        return _classify_by_entity(rows, roles, window_days, parts)
    entity = list(roles.entity)
    hot = settle(rows.groupBy(*entity).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select(*[F.col(c).alias(f"__hot_{c}") for c in entity]), "hot-entities")
    if hot.isEmpty():
        return _classify_by_entity(rows, roles, window_days, parts)
    same = F.lit(True)
    for c in entity:
        same = same & F.col(c).eqNullSafe(F.col(f"__hot_{c}"))
    even = _classify_by_entity(rows.join(hot, same, "left_anti"), roles, window_days, parts)
    return even.unionByName(classify_hot(rows.join(hot, same, "left_semi"), roles, window_days))


def tasks_for(rows: DataFrame, n: int) -> int:
    """Partitions for ``n`` rows: one for each ``ROWS_A_TASK``, and one for each core at least.

    Neither a fixed number of partitions nor the merging of small ones bounds what a task sorts when the rows grow.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_TASK))


def _signature(rows: DataFrame, roles: Roles) -> Column:
    return surrogate_key(*roles.entity, *roles.offer, doubles=tuple(c for c, kind in rows.dtypes if kind == "double"))


def classify_hot(rows: DataFrame, roles: Roles = DEFAULT_ROLES, window_days: int = DEFAULTS.recapture_window_days) -> DataFrame:
    """``classify_duplicates`` for entities of any number of rows: no task holds an entity, an event or an offer.

    The row of an event that stands is a minimum, combined before its shuffle, that the event's rows are joined to;
    chains are found over pieces of an offer's order.
    """
    r = roles
    load, source_row = r.row
    nulls_last = lambda c: (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(f"of_{c}"))
    present = F.when(F.coalesce(*[F.col(c) for c in r.amounts]).isNotNull(), 0).otherwise(1)
    keyed = rows.select("*", surrogate_key(*r.entity, *r.event).alias("__event"), _signature(rows, r).alias("business_signature"), surrogate_key(*r.entity, *r.offer).alias("__offer"), F.monotonically_increasing_id().alias("__n"))
    keyed = settle(keyed, "hot-keyed")
    stated = F.col(r.loaded_at).cast("timestamp")
    order = F.struct(stated.isNull().alias("never"), (-F.unix_micros(stated)).alias("ago"), present.alias("present"), *nulls_last(source_row), *nulls_last(load), "__n", F.struct(*r.content).alias("content"))
    first = keyed.groupBy("__event").agg(F.min(order).alias("f")).select("__event", F.col("f.__n").alias("__stands"), F.col("f.content").alias("__current"))
    both = settle(keyed.join(first, "__event"), "hot-events")
    chained = chains(both.filter("__n = __stands"), "__offer", r.date, [source_row, load, "__n"], window_days)
    stands = chained.select(
        *rows.columns, "business_signature", F.col("__gap").cast("bigint").alias("days_since_previous_appearance"), F.col("__chain").cast("bigint").alias("recapture_cluster"),
        F.col("__place").cast("bigint").alias("recapture_rank"), F.col("__first").alias("surviving_event_date"), F.when(F.col("__place") == 1, OK).otherwise(RECAPTURED).alias("dq_status"),
    )
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    again = both.filter("__n != __stands").select(
        *rows.columns, "business_signature", none("days_since_previous_appearance"), none("recapture_cluster"), none("recapture_rank"), F.col(r.date).alias("surviving_event_date"),
        F.when(F.struct(*r.content).eqNullSafe(F.col("__current")), EXACT).otherwise(RESTATED).alias("dq_status"),
    )
    return stands.unionByName(again)


def _classify_by_entity(rows: DataFrame, roles: Roles, window_days: int, parts: int) -> DataFrame:
    r, entity = roles, list(roles.entity)
    load, source_row = r.row
    present = F.when(F.coalesce(*[F.col(c) for c in r.amounts]).isNotNull(), 0).otherwise(1)
    group = Window.partitionBy(*entity, *r.event).orderBy(F.col(r.loaded_at).desc_nulls_last(), "__present", *_ascending(source_row, load))
    content = F.struct(*r.content)
    dated = Window.partitionBy(*entity, *r.offer, "__stands").orderBy(*_ascending(r.date, source_row, load))
    so_far = dated.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.repartition(parts, *[F.col(c) for c in entity]).withColumn("__present", present)  # a column, so that both windows over it share a sort
    out = out.withColumn("__rank", F.row_number().over(group)).withColumn("__current", F.first(content).over(group))
    out = out.withColumn("__stands", F.col("__rank") == 1)
    out = out.withColumn("__gap", F.datediff(r.date, F.lag(r.date).over(dated))).withColumn("__nth", F.row_number().over(dated))
    opens = F.col("__gap").isNull() | (F.col("__gap") > window_days)
    # a chain's first row, also the one of its least date, is the last that opened one: no sort by chains is needed
    opener = F.struct(F.col("__nth").alias("nth"), F.col(r.date).alias("date"))
    out = out.withColumn("__chain", F.sum(F.when(opens, 1).otherwise(0)).over(so_far)).withColumn("__opener", F.last(F.when(opens, opener), ignorenulls=True).over(so_far))
    out = out.withColumn("__place", F.col("__nth") - F.col("__opener.nth") + 1).withColumn("__first", F.col("__opener.date"))
    stands = lambda c, kind: F.when(F.col("__stands"), F.col(c)).cast(kind)
    status = (
        F.when(~F.col("__stands") & content.eqNullSafe(F.col("__current")), EXACT).when(~F.col("__stands"), RESTATED)
        .when(F.col("__place") == 1, OK).otherwise(RECAPTURED)
    )
    return out.select(
        *rows.columns, _signature(rows, r).alias("business_signature"),
        stands("__gap", "bigint").alias("days_since_previous_appearance"), stands("__chain", "bigint").alias("recapture_cluster"),
        stands("__place", "bigint").alias("recapture_rank"), F.when(F.col("__stands"), F.col("__first")).otherwise(F.col(r.date)).alias("surviving_event_date"),
        status.alias("dq_status"),
    )


DEDUPED_COLUMNS = (
    "business_signature", "suburb_key", "suburb_name", "postcode", "region_name", "council_area", "cbd_distance_km", "property_count",
    "street_address", "street_address_key", "rooms", "type_code", "method_code", "event_date", "agent_key", "agent_name",
    "is_sold", "is_auction", "sale_price", "bid_amount", "sale_price_is_disclosed", "load_id", "source_row",
)
QUARANTINE_COLUMNS = (
    "business_signature", "surviving_event_date", "days_since_previous_appearance", "event_date", "suburb_key", "suburb_name", "street_address",
    "rooms", "type_code", "method_code", "agent_key", "agent_name", "is_sold", "sale_price", "bid_amount", "load_id", "source_row",
)


def _there(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def deduped(classified: DataFrame, columns: Sequence[str] = DEDUPED_COLUMNS) -> DataFrame:
    return classified.filter(F.col("dq_status") == OK).select(*_there(classified, columns))


def quarantine(classified: DataFrame, columns: Sequence[str] = QUARANTINE_COLUMNS, row: Sequence[str] = DEFAULT_ROLES.row) -> DataFrame:
    """What isn't ok, with the reason: with ``deduped``, every classified row once."""
    return classified.filter(F.col("dq_status") != OK).select(surrogate_key(*row).alias("quarantine_key"), F.col("dq_status").alias("reason"), *_there(classified, columns))
