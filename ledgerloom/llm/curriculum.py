"""Mixing sources to target weights along a curriculum.

Sizes are words.  Sources, by code point with null last, take weights in turn and share the words of the
whole corpus by weight; a target stops at ``most_epochs`` times its source's size and the excess is shared
again by weight.  (Sources in ascending order of cap per weight: one is capped if its cap is below what the
water level would otherwise give it, so running sums give the fixed point in one pass over the sources.)

Inside a source documents stand in the order of a digest of their ids and texts, and that order is repeated.
Copies are laid end to end on the source's axis of words: copy k of a document spans the words from (k - 1)
times the source's size plus the words before it, and the axis ends at the target, rounded; what lies beyond
isn't taken.  So each source takes its target to the word, and the one copy at the border is taken in part.
The running sum is over buckets of the order: sums per bucket first, then inside each bucket, so no source is
ordered in one task.

Each source has a schedule: weights at knots of training time 0..1, linear between them, scaled to integrate
to its target.  A copy starts when the source's cumulative demand reaches the words before it: the integral
is a quadratic in each span and is inverted in closed form.  ``mix`` gives each document's copies with their
positions; ``training_order`` gives one row per copy, sorted by position (a range sort).

Defined results: a null text has size 0 and is taken 0 times; null sources form one source, the last;
repeated rows are separate documents (equal in id and text, they share a bucket and are interchangeable); null
ids are spread by their texts; ties of position are ordered by id, copy and text; empty tables give no rows;
columns of the input may have any names: ``mix`` returns only its own, ``training_order`` only the input's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

KNOTS = (0.0, 0.5, 1.0)
#: Schedule of the sources in turn at the knots: even, rising, falling.
SHAPES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
_OF_BUCKET = 1 << 11


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """Add ``rank`` (from 0), ``weight`` and ``target`` to ``totals``: one row per source (``no_source``, ``source``, ``source_size``).

    The windows have no partition: they run over one row per source, not over documents.
    """
    turn = F.row_number().over(Window.orderBy("no_source", "source")) - 1
    ranked = totals.withColumn("rank", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("words_left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", F.col("words_left") / F.col("weight_left"))
    level = level.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "words_left", "weight_left"))).over(every)
    at = level.withColumn("first_open", first)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("first_open.words_left") * F.col("weight") / F.col("first_open.weight_left"))
    return at.select("no_source", "source", "source_size", "rank", "weight", target.alias("target"))


def _spans(rank: Column, knots: Sequence[float], shapes: Sequence[Sequence[float]]) -> Column:
    """Spans of the schedule of a source as structs: start, length, weight at both ends, integral before; all scaled to a whole of 1."""
    choices = []
    for shape in shapes:
        areas = [(b - a) * (u + v) / 2 for a, b, u, v in zip(knots, knots[1:], shape, shape[1:], strict=False)]
        whole, done, spans = sum(areas), 0.0, []
        for a, b, u, v, area in zip(knots, knots[1:], shape, shape[1:], areas, strict=False):
            spans.append(F.struct(*[F.lit(x).alias(n) for n, x in (("t", a), ("d", b - a), ("u", u / whole), ("v", v / whole), ("before", done / whole), ("area", area / whole))]))
            done += area
        choices.append(F.array(*spans))
    return F.element_at(F.array(*choices), (rank % len(shapes) + 1).cast("int"))


def when_reached(spans: Column, share: Column) -> Column:
    """Training time at which the cumulative demand of the schedule is ``share`` of its whole."""

    def inside(s: Column) -> Column:
        need, slope = F.greatest(share - s["before"], F.lit(0.0)), (s["v"] - s["u"]) / s["d"]
        root = F.sqrt(F.greatest(s["u"] * s["u"] + 2 * slope * need, F.lit(0.0)))
        return s["t"] + F.least(s["d"], F.coalesce(F.try_divide(2 * need, s["u"] + root), F.lit(0.0)))

    at = F.filter(spans, lambda s: share >= s["before"])
    return inside(F.element_at(at, -1))


def _sizes(docs: DataFrame, carry: Sequence[Column], id_column: str, text_column: str, source_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    salted = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select(
        *carry, F.col(id_column).alias("__id"), F.col(source_column).isNull().alias("__no_source"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("__source"),
        word_count(text).alias("__size"), F.md5(salted.cast("binary")).alias("__order"),
    )


def _placed(docs: DataFrame, carry: Sequence[Column], id_column: str, text_column: str, source_column: str, weights: Sequence[int], most_epochs: int, knots: Sequence[float], shapes: Sequence[Sequence[float]]) -> DataFrame:
    """Columns ``carry`` of ``docs`` with ``__id``, ``__order``, ``__size``, ``__source_size``, ``__target`` and ``__copies``: of each copy that is begun its position and its words.

    The sums come from a narrow table.  The rows are then dealt by source and bucket, which both the
    running sum and the join to the buckets' offsets use, so they are shuffled once.
    """
    key = ["__no_source", "__source"]
    narrow = settle(_sizes(docs, [], id_column, text_column, source_column), "mix-sizes")
    buckets = max(1, -(-narrow.count() // _OF_BUCKET))
    bucket = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(1 << 32)).cast("bigint")
    per_bucket = narrow.groupBy(*key, bucket.alias("__bucket")).agg(F.sum("__size").alias("words"))
    totals = per_bucket.groupBy(F.col("__no_source").alias("no_source"), F.col("__source").alias("source")).agg(F.sum("words").alias("source_size"))
    of_source = source_targets(totals, weights, most_epochs).select(
        F.col("no_source").alias("__no_source"), F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "rank",
        F.floor(F.col("target") + 0.5).cast("bigint").alias("end"),
    )
    earlier = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(per_bucket.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(of_source, key), "mix-offsets")
    rows = _sizes(docs, carry, id_column, text_column, source_column) if carry else narrow
    inside = Window.partitionBy(*key, "__bucket").orderBy("__order", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__bucket", bucket).withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = rows.join(offsets, [*key, "__bucket"]).withColumn("__ahead", F.col("base") + F.col("__inside"))
    spans, begins = _spans(F.col("rank"), knots, shapes), lambda k: k * F.col("__source_size") + F.col("__ahead")
    # one more than the whole epochs at least, so the copy at the border is among them
    begun = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(most_epochs).cast("bigint")), lambda k: (F.col("__size") > 0) & (begins(k) < F.col("end")))
    copies = F.transform(begun, lambda k: F.struct(when_reached(spans, begins(k) / F.col("__target")).alias("at"), F.least(F.col("__size"), F.col("end") - begins(k)).alias("words")))
    return rows.withColumn("__copies", copies)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[int] = (1, 2, 3),
        most_epochs: int = 3, knots: Sequence[float] = KNOTS, shapes: Sequence[Sequence[float]] = SHAPES) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken`` (words of all its copies) and ``positions`` (one for each copy begun)."""
    rows = _placed(docs, [], id_column, text_column, source_column, weights, most_epochs, knots, shapes)
    taken = F.aggregate("__copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    positions = F.transform("__copies", lambda c: c["at"])
    return rows.select(F.col("__id").alias(id_column), *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target")], taken.alias("taken"), positions.alias("positions"))


def training_order(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: Sequence[int] = (1, 2, 3),
                   most_epochs: int = 3, knots: Sequence[float] = KNOTS, shapes: Sequence[Sequence[float]] = SHAPES, whole_texts: bool = False) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each copy, in order of training position.

    The copy at the border of its source has only the words that the mix takes, with single blanks.  With
    ``whole_texts`` no text is cut: that copy is there as a whole if at least half of its words are taken,
    else it is left out, so a source is off its target by at most half of that text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = _placed(docs, [row], id_column, text_column, source_column, weights, most_epochs, knots, shapes)
    copy = rows.select("__row", "__id", "__order", "__size", F.posexplode("__copies").alias("__k", "__copy"))
    words = F.col("__copy.words")
    if whole_texts:
        copy = copy.filter(2 * words >= F.col("__size"))
    copy = copy.orderBy("__copy.at", "__id", "__k", "__order")
    text = F.col("__row").getField(text_column)
    cut = F.when(words < F.col("__size"), F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")).otherwise(text)
    return copy.select(*[(cut if c == text_column and not whole_texts else F.col("__row").getField(c)).alias(c) for c in docs.columns])
