"""Data-quality checks (Q1-Q11, Q13): each gives the rows that violate it, so a sound table gives none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Values (or combinations) that stand more than once; a single column's nulls don't count."""
    rows = df.filter(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")).distinct(), F.col(column) == F.col("__key"), "left_anti")


def unaccepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def untrue(df: DataFrame, expression: str | Column) -> DataFrame:
    """Rows where the expression is false; null passes."""
    return df.filter(~(F.expr(expression) if isinstance(expression, str) else expression))


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule`` and ``n`` for each of ``rules`` that ``n`` rows break (its condition is false; null passes): one pass for all of them."""
    counts = df.agg(*[F.count_if(~holds).alias(f"r{i}") for i, holds in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n")) for i, rule in enumerate(rules)])
    return counts.select(F.explode(each).alias("x")).select("x.*").filter("n > 0")


def ledger(staged: DataFrame, fact: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The three counts, if fact and quarantine don't add up to what was staged."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = count(staged, "staged_rows").crossJoin(count(fact, "fact_rows")).crossJoin(count(quarantine, "quarantined_rows"))
    return rows.filter("fact_rows + quarantined_rows != staged_rows")


def undetermined(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys that don't determine their attributes, with the number of distinct values of each (nulls don't count).

    The least and the greatest value of each attribute, combined before the shuffle, say which keys these are; only
    their rows are counted, one row per distinct value, so no row is expanded by the number of attributes before that.
    """
    ends = df.groupBy(key).agg(*[f(c).alias(f"__{side}_{i}") for i, c in enumerate(attributes) for side, f in (("least", F.min), ("most", F.max))])
    vary = " OR ".join(f"__least_{i} != __most_{i}" for i in range(len(attributes)))
    wrong = ends.filter(vary).select(F.col(key).alias("__key"))
    rows = df.join(wrong, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    each = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v"), F.col(c).isNotNull().alias("there")) for i, c in enumerate(attributes)])).alias("x"))
    values = each.filter("x.there").groupBy(key, "x.i", "x.v").agg(F.lit(1).alias("one"))
    return values.groupBy(key).agg(*[F.count_if(F.col("i") == i).alias(c) for i, c in enumerate(attributes)])


def disagreeing(fact: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose own copy of a dimension's column differs from the dimension's."""
    return fact.join(dimension.select(key, F.col(column).alias("__theirs")), key).filter(F.col(column) != F.col("__theirs"))


def spanning(classified: DataFrame, entity: Sequence[str], group: str = "business_signature") -> DataFrame:
    """Duplicate groups that hold more than one entity."""
    one = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in entity])
    return classified.groupBy(group).agg(F.count_distinct(one).alias("entities")).filter("entities > 1")


def overlong(classified: DataFrame, days: int = DEFAULTS.incremental_lookback_days) -> DataFrame:
    """Recapture chains that span more days than the lookback."""
    spans = classified.filter(F.col("recapture_cluster").isNotNull()).groupBy("business_signature", "recapture_cluster")
    out = spans.agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    return out.withColumn("span_days", F.datediff("last_date", "first_date").cast("bigint")).filter(F.col("span_days") > days)


LINEAGE = ("load_id", "load_started_at", "source_row")


def difference(a: DataFrame, b: DataFrame, without: Sequence[str] = LINEAGE, digits: int = 6) -> DataFrame:
    """Rows, with counts, that the two tables don't have equally often; doubles are compared rounded.

    One grouped sum instead of two set differences, so each table is shuffled once.
    """
    a, b = (_compared(df, a.columns, without, digits) for df in (a, b))
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__side").alias("surplus")).filter("surplus != 0")


def _compared(df: DataFrame, columns: Sequence[str], without: Sequence[str], digits: int) -> DataFrame:
    kinds = df.select(*[c for c in columns if c not in without]).dtypes
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in kinds])


def digests(df: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``n`` and two sums of 64-bit hashes of the rows that fall in it: equal for equal multisets in any order.

    Rows are summed before the shuffle, which carries at most ``buckets`` rows from a task.
    """
    rows = df.select(F.xxhash64(*df.columns).alias("x"), F.hash(*df.columns).alias("y"), F.xxhash64(F.lit(1), *df.columns).alias("z"))
    bucket = F.pmod(F.col("y"), F.lit(buckets)).alias("bucket")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(bucket).agg(F.count("*").alias("n"), wide("x").alias("x"), wide("z").alias("z"))


def difference_by_digest(a: DataFrame, b: DataFrame, without: Sequence[str] = LINEAGE, digits: int = 6, buckets: int = 4096) -> DataFrame:
    """``difference``, comparing rows only in buckets whose digests differ, so equal tables are scanned and not shuffled.

    A difference is missed if both 64-bit sums of a bucket agree by chance.  The numbers of the buckets that differ, at
    most ``buckets``, go to the driver.  Map columns can't be hashed.
    """
    a, b = (_compared(df, a.columns, without, digits) for df in (a, b))
    ours, theirs = digests(a, buckets), digests(b, buckets).select(*[F.col(c).alias(f"their_{c}") for c in ("bucket", "n", "x", "z")])
    same = F.lit(True)
    for c in ("n", "x", "z"):
        same = same & F.col(c).eqNullSafe(F.col(f"their_{c}"))
    unlike = ours.join(theirs, F.col("bucket") == F.col("their_bucket"), "full").filter(~same)
    wrong = [r[0] for r in unlike.select(F.coalesce("bucket", "their_bucket")).collect()]
    inside = F.pmod(F.hash(*a.columns), F.lit(buckets)).isin(wrong)
    return difference(a.filter(inside), b.filter(inside), (), digits)
