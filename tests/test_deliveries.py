import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.operators import duplicates, quality
from ledgerloom.plans import deliveries, incremental
from ledgerloom.sources import csv_feed
from ledgerloom.sources.scratch import settle

from test_pieces import listings
from test_runs import TODAY, write
from test_runs import listings as fed


def test_parts_sum_to_the_whole(spark):
    rows = listings(spark, 600)
    sent = settle(deliveries.delivery_sequence(rows, 5, 11, resent=2, corrections={"sale_price": F.lit(1.0)}, correctable=F.col("sale_price").isNull(), corrected_share=0.2), "sent")
    first = sent.filter("kind = 'first'")
    assert quality.difference(first.select(*rows.columns), rows, ()).isEmpty()
    assert {r[0] for r in first.select("delivery").distinct().collect()} == set(range(5))
    again = sent.filter("kind = 'resent'")
    assert {r[0] for r in again.select("delivery").distinct().collect()} == {5, 6}
    for d in (5, 6):
        a = again.filter(F.col("delivery") == d).drop("delivery", "kind")
        assert any(quality.difference(a, first.filter(F.col("delivery") == k).drop("delivery", "kind"), ()).isEmpty() for k in range(5))
    late = sent.filter("kind = 'corrected'")
    assert 0 < late.count() < rows.count() and late.filter("delivery != 7 or sale_price != 1.0").isEmpty()
    # rows of one property, few days apart, are on both sides of a cut
    near = first.alias("a").join(first.alias("b"), F.expr("a.suburb_key = b.suburb_key and a.street_address_key = b.street_address_key and a.event_date < b.event_date and datediff(b.event_date, a.event_date) <= 21 and a.delivery > b.delivery"))
    assert not near.isEmpty()
    assert deliveries.delivery_sequence(rows.limit(0), 5, 1).isEmpty()


def test_twenty_random_splits_add_up(spark):
    """Scoped rebuilds after each delivery equal one full build; all splits go at once, the split being part of the property."""
    rows, roles = listings(spark, 240), duplicates.Roles(entity=("split", "suburb_key", "street_address_key"))
    entity, parts = roles.entity, []
    for seed in range(20):
        sent = deliveries.delivery_sequence(rows, 4, seed, resent=0, corrections={"sale_price": F.lit(7.0), "load_started_at": F.lit(dt.datetime(2022, 1, 1)), "load_id": F.lit("late")},
                                            correctable=F.coalesce("sale_price", "bid_amount").isNull(), corrected_share=0.3)
        parts.append(sent.withColumn("split", F.lit(seed)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = settle(whole, "splits")
    current, classify = None, lambda df: duplicates.classify_duplicates(df.drop("delivery", "kind"), roles)
    for d in range(5):
        known = whole.filter(F.col("delivery") <= d)
        scope = known.filter(F.col("delivery") == d).select(*entity).distinct()
        current = settle(incremental.rebuild(known, classify, current, scope if current is not None else None, entity), "splits-now")
    assert quality.difference(current, classify(whole), ()).isEmpty()


def test_replay(spark, tmp_path):
    """A delivery, the same again, and late prices, each built when it comes, against one build of all."""
    landing = str(tmp_path / "landing")
    csv_feed.load_csv(spark, write(tmp_path / "a.csv", fed(60)), landing, today=TODAY)
    assert deliveries.replay(spark, landing, str(tmp_path / "work"), n=2, seed=3, config=Config(min_rows_loaded=1, property_parts=3), check=False) == []


def test_command(spark, monkeypatch, capsys):
    assert deliveries.main(["a"], spark) == 2 == deliveries.main(["a", "b", "c"], spark)
    for unlike in ([], ["dim_date"]):
        monkeypatch.setattr(deliveries, "replay", lambda *a, seed, config: unlike if seed == 5 else None)  # noqa: B023
        assert deliveries.main(["a", "b", "5"], spark) == len(unlike)


def test_rows_change_seed_by_seed(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(300))) for i in range(200)], "i int, event_date date")
    cut = lambda seed: [r["delivery"] for r in deliveries.delivery_sequence(rows, 5, seed, row=["i"], resent=0).orderBy("i").collect()]
    assert cut(1) == cut(1) != cut(2)
