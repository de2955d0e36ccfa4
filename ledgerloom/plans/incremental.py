"""Entity-scoped rebuilding (N1-N6): what a delivery touches is derived again from its whole history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import surrogate_key

PROPERTY = ("suburb_key", "street_address_key")


def is_scoped(exists: bool, load_ids: Sequence[str] | None) -> bool:
    return exists and bool(load_ids)


def part_of(parts: int, property_key: Column | None = None) -> Column:
    """The part (from 0) that a property's rows are kept in, from its key or the columns that make it."""
    return F.pmod(F.xxhash64(surrogate_key(*PROPERTY) if property_key is None else property_key), F.lit(parts)).cast("int")


def touched_parts(rows: DataFrame, parts: int) -> list[int]:
    """The parts that ``rows`` are in: at most ``parts`` numbers."""
    return sorted(r[0] for r in rows.select(part_of(parts).alias("part")).distinct().collect())


def affected(staged: DataFrame, load_ids: Sequence[str], entity: Sequence[str] = PROPERTY) -> DataFrame:
    """The entities that the named loads mention, once each."""
    return staged.filter(F.col("load_id").isin(list(load_ids))).select(*entity).distinct()


def affected_keys(staged: DataFrame, load_ids: Sequence[str]) -> DataFrame:
    return affected(staged, load_ids).select(surrogate_key(*PROPERTY).alias("property_key"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which nulls are equal."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(named, on, how)


def in_scope(rows: DataFrame, scope: DataFrame, keys: Sequence[str] = PROPERTY) -> DataFrame:
    return _same(rows, scope, keys, "left_semi")


def replace_affected(current: DataFrame, scope: DataFrame, recomputed: DataFrame, keys: Sequence[str] = PROPERTY) -> DataFrame:
    """``current`` with all rows of the scope's entities exchanged for ``recomputed``; other rows are copied, not shuffled by history."""
    kept = _same(current, scope, keys, "left_anti")
    return kept.unionByName(recomputed, allowMissingColumns=True)


def rebuild(source: DataFrame, derive: Callable[[DataFrame], DataFrame], current: DataFrame | None, scope: DataFrame | None, keys: Sequence[str] = PROPERTY) -> DataFrame:
    """``derive(source)`` in full, or only for the scope where a current table is there to take the rest from."""
    if current is None or scope is None:
        return derive(source)
    return replace_affected(current, scope, derive(in_scope(source, scope, keys)), keys)
