"""Ordered work on keys that no one task can hold: pieces of the order, each summed up, composed, and applied.

Rows are dealt by ranges of key and order, so a large key is cut and small keys lie whole in a piece.  A piece says of
each of its keys in one row what the following pieces must know; these rows (a key has at most one for each piece) are
composed by windows, and each row gets its result from its place in the piece and what came before.

Defined results: null keys and null dates compare equal, dates after all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle


def in_pieces(df: DataFrame, order: Sequence[str], tag: str = "pieces") -> DataFrame:
    """``df`` with ``__piece``: rows of one piece are neighbours in ``order`` (nulls last), and pieces are numbered in that order.

    Ranges come from a sample, so a second run might cut elsewhere: the rows are written with their pieces.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    return settle(dealt.withColumn("__piece", F.spark_partition_id()), tag)


def chains(rows: DataFrame, key: str, date: str, order: Sequence[str], window_days: int) -> DataFrame:
    """``rows`` with ``__gap`` (days since the row before, of one ``key``), ``__chain`` (its number, from 1), ``__place`` in it and its ``__first`` date.

    A row opens a chain if it is its key's first or over ``window_days`` after the row before.  ``order`` makes the
    order of rows of one date total.
    """
    cut = in_pieces(rows, [key, date, *order], "chain-pieces")
    in_time = [F.col(c).asc_nulls_last() for c in (date, *order)]
    inside = Window.partitionBy("__piece", key).orderBy(*in_time)
    late = lambda gap: F.when(gap.isNull() | (gap > window_days), 1).otherwise(0)
    local = cut.withColumn("__nth", F.row_number().over(inside)).withColumn("__gap", F.datediff(date, F.lag(date).over(inside)))
    local = local.withColumn("__opened", F.sum(F.when(F.col("__nth") == 1, 0).otherwise(late(F.col("__gap")))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("__piece", key, "__opened")
    local = settle(local.withColumn("__at", F.row_number().over(since.orderBy(*in_time))).withColumn("__since", F.min(date).over(since)), "chain-local")
    ends = local.groupBy(key, "__piece").agg(F.min(F.struct("__nth", F.col(date).alias("date"))).alias("a"), F.max(F.struct("__nth", F.col(date).alias("date"), "__opened", "__at", "__since")).alias("z"))
    by = Window.partitionBy(key).orderBy("__piece")
    gap = F.datediff("a.date", F.lag("z.date").over(by))
    ends = ends.select(F.col(key).alias("__of"), "__piece", "z", gap.alias("__gap0"), late(gap).alias("__opens0")).withColumn("__all", F.col("__opens0") + F.col("z.__opened"))
    by = Window.partitionBy("__of").orderBy("__piece")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__before", F.sum("__all").over(so_far) - F.col("__all")).withColumn("__run", F.count_if(F.col("__all") > 0).over(so_far))
    run = Window.partitionBy("__of", "__run").orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__rows", F.sum("z.__at").over(run)).withColumn("__from", F.first("z.__since").over(run))
    ends = ends.select("__of", F.col("__piece").alias("__p"), "__gap0", "__opens0", "__before", F.lag("__rows").over(by).alias("__rows"), F.lag("__from").over(by).alias("__from"))
    whole = local.join(ends, (F.col("__piece") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__of")))
    goes_on = (F.col("__opened") == 0) & (F.col("__opens0") == 0)
    return whole.select(
        *rows.columns, F.when(F.col("__nth") == 1, F.col("__gap0")).otherwise(F.col("__gap")).alias("__gap"), (F.col("__before") + F.col("__opens0") + F.col("__opened")).alias("__chain"),
        (F.col("__at") + F.when(goes_on, F.col("__rows")).otherwise(0)).alias("__place"), F.when(goes_on, F.col("__from")).otherwise(F.col("__since")).alias("__first"),
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, into: str = "median") -> DataFrame:
    """The exact median of each group's non-null values (of an even number the mean of the middle two); groups without any have none.

    Values are counted first, before the shuffle too.  Sums of counts by piece tell which piece holds a group's middle,
    and only there do running counts find the value; so neither a group's rows nor its distinct values meet in a task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    cut = in_pieces(counted, [*keys, "__value"], "median-pieces")
    by = Window.partitionBy(*keys)
    sums = cut.groupBy(*keys, "__piece").agg(F.sum("__n").alias("__in"))
    sums = sums.withColumn("__all", F.sum("__in").over(by)).withColumn("__until", F.sum("__in").over(by.orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    reaches = lambda before, until, at: (before <= at) & (at < until)
    before = F.col("__until") - F.col("__in")
    middle = sums.filter(reaches(before, F.col("__until"), low) | reaches(before, F.col("__until"), high))
    middle = middle.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"), before.alias("__before"), "__all")
    same = F.col("__piece") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = cut.join(middle, same).withColumn("__end", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__piece").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("__end") - F.col("__n")
    at = lambda place: F.max(F.when(reaches(begin, F.col("__end"), place), F.col("__value")))
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(into))
