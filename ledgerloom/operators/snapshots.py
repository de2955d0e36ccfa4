"""What changed between two full snapshots, by digests of their rows: the delta that a scoped build needs.

A feed that sends everything each day is turned into deliveries: rows are digested, and rows of one key meet once, in
one exchange, where counts of equal digests on both sides say what is the same, new, changed or gone.

Defined results: nulls compare equal; rows that stand several times are counted; an empty snapshot is one without rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame, columns: Sequence[str]):
    """SHA-256 over the columns as JSON, in which a null can't look like any value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _by_digest(previous: DataFrame, current: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``before`` and ``now`` (how often) of each digest of each key.  Rows are dealt by key, which all further grouping uses."""
    side = lambda df, before: df.select(*key, row_digest(df, columns).alias("digest"), F.lit(before).alias("before"))
    both = side(previous, 1).unionByName(side(current, 0)).repartition(*[F.col(k) for k in key])
    return both.groupBy(*key, "digest").agg(F.sum("before").alias("before"), F.count_if(F.col("before") == 0).alias("now"))


def snapshot_changes(previous: DataFrame, current: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Per key how many rows are ``same``, ``changed``, ``new`` and ``vanished``; what stands on both sides with other content is changed."""
    columns = columns or current.columns
    per = _by_digest(previous, current, key, columns).groupBy(*key).agg(
        F.sum(F.least("before", "now")).alias("same"), F.sum(F.greatest(F.col("before") - F.col("now"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("now") - F.col("before"), F.lit(0))).alias("gained"),
    )
    changed = F.least("lost", "gained")
    return per.select(*key, "same", changed.alias("changed"), (F.col("gained") - changed).alias("new"), (F.col("lost") - changed).alias("vanished"))


def delta_rows(previous: DataFrame, current: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``current`` that ``previous`` doesn't have as often: what a full snapshot delivers."""
    columns = list(columns or current.columns)
    side = lambda df, now: df.select(*columns, F.lit(now).alias("__now"))
    counts = side(previous, -1).unionByName(side(current, 1)).groupBy(*columns).agg(F.sum("__now").alias("__more")).filter("__more > 0")
    return counts.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__more").cast("int"))).alias("__k")).drop("__k")
