import datetime as dt
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import duplicates, pieces, quality, snapshots

ROWS = "suburb_key string, street_address_key string, event_date date, method_code string, agent_key string, rooms int, type_code string, sale_price double, bid_amount double, load_started_at timestamp, load_id string, source_row int"


def listings(spark, n=1500, seed=3):
    """A third of all rows in one property; nulls, ties and repeated events."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        price = rng.choice([None, 100.0, 200.0])
        sold = rng.random() < 0.6
        load = rng.randrange(4)
        rows.append((
            "s" if hot else rng.choice(["a", "b", None]), "p" if hot else f"p{rng.randrange(60)}", None if rng.random() < 0.02 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(700)),
            rng.choice("SP"), rng.choice(["x", "x", None]), rng.choice([2, None]), "h", price if sold else None, None if sold else price,
            None if load == 3 else dt.datetime(2021, 1, 1 + load), f"l{load}", i,
        ))
    return spark.createDataFrame(rows, ROWS)


def test_hot_properties_are_classified_by_the_same_rules(spark):
    rows = listings(spark)
    want = duplicates.classify_duplicates(rows)
    for hot in (1, 100, 10**9):  # all properties, the one with a third of all rows, none
        got = duplicates.classify_duplicates(rows, hot_rows=hot)
        assert got.columns == want.columns and quality.difference(got, want, ()).isEmpty(), hot
    assert {r[0] for r in want.select("dq_status").distinct().collect()} == {"ok", "exact_duplicate", "suspected_restatement", "suspected_recapture"}
    assert duplicates.classify_hot(rows.limit(0)).isEmpty()


def test_an_offer_is_cut_into_pieces(spark):
    """Ten thousand rows of one key: chains equal those found in one pass, and no piece holds more than its share."""
    rng = random.Random(5)
    days = [rng.randrange(40_000) for _ in range(10_000)] + [None] * 5
    start = dt.date(1950, 1, 1)
    rows = spark.createDataFrame([("k", None if d is None else start + dt.timedelta(days=d), i) for i, d in enumerate(days)] + [(None, start, -1), (None, None, -2)], "key string, day date, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = pieces.in_pieces(rows, ["key", "day", "n"])
        sizes = [r["count"] for r in cut.groupBy("__piece").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * len(days) / len(sizes)
        got = {r["n"]: (r["__gap"], r["__chain"], r["__place"], r["__first"]) for r in pieces.chains(rows, "key", "day", ["n"], 5).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before, chain, place, first = None, 0, 0, None
    for d, i in sorted(((d, i) for i, d in enumerate(days)), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        gap = None if d is None or before is None else d - before
        if gap is None or gap > 5:
            chain, place, first = chain + 1, 0, d
        place += 1
        assert got[i] == (gap, chain, place, None if first is None else start + dt.timedelta(days=first))
        before = d
    assert got[-1] == (None, 1, 1, start) and got[-2] == (None, 2, 1, None)


def test_exact_median(spark):
    rng = random.Random(6)
    rows = [("hot", float(rng.randrange(5000)), i) for i in range(3000)] + [(k, rng.choice([1.5, 2.0, None]), 0) for k in ("a", "b", None) for _ in range(rng.randrange(1, 6))] + [("none", None, 1), ("one", 7.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    groups = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            groups[k].append(v)
    assert {r["k"]: r["median"] for r in pieces.exact_median(df, ["k"], "v").collect()} == {k: statistics.median(v) for k, v in groups.items()}
    assert pieces.exact_median(df.limit(0), ["k"], "v").isEmpty()


def test_snapshots(spark):
    rng = random.Random(7)
    make = lambda: [(rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for _ in range(60)]
    a, b = make(), make()
    before, now = (spark.createDataFrame(x, "k int, v string") for x in (a, b))
    got = {r["k"]: tuple(r)[1:] for r in snapshots.snapshot_changes(before, now, ["k"]).collect()}
    for k in {x[0] for x in a + b}:
        ca, cb = Counter(x for x in a if x[0] == k), Counter(x for x in b if x[0] == k)
        lost, gained = sum((ca - cb).values()), sum((cb - ca).values())
        assert got[k] == (sum((ca & cb).values()), min(lost, gained), gained - min(lost, gained), lost - min(lost, gained))
    assert Counter(map(tuple, snapshots.delta_rows(before, now).collect())) == Counter(b) - Counter(a)
    plan = spark._jvm.PythonSQLUtils.explainString(snapshots.snapshot_changes(before, now, ["k"])._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1
    assert snapshots.delta_rows(before, now.limit(0)).isEmpty() and snapshots.delta_rows(before.limit(0), now).count() == 60


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_difference_by_digest(spark, buckets):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.choice([1.0000001, 1.0, None, -0.0, 0.0]), i % 9, "l") for i in range(300)]
    a = spark.createDataFrame(rows, "x string, y double, z int, load_id string")
    b = spark.createDataFrame([*rows[5:], ("new", 2.0, 1, "m"), rows[7]], a.schema)
    want = Counter({tuple(r)[:-1]: r["surplus"] for r in quality.difference(a, b).collect()})
    assert want and Counter({tuple(r)[:-1]: r["surplus"] for r in quality.difference_by_digest(a, b, buckets=buckets).collect()}) == want
    assert quality.difference_by_digest(a, a.orderBy("z").withColumn("load_id", F.lit("other")), buckets=buckets).isEmpty()
    assert quality.difference_by_digest(a.limit(0), a.limit(0)).isEmpty() and quality.difference_by_digest(a, a.limit(0)).count() == quality.difference(a, a.limit(0)).count()


def test_dependencies_are_found_without_expanding(spark):
    rows = [(1, "a", 1.0, None), (1, "b", 1.0, None), (2, "a", None, 3), (2, "a", 5.0, 3), (None, "x", 1.0, 1), (None, "y", 2.0, 2), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, d double, i int")
    got = quality.undetermined(df, "k", ["s", "d", "i"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, 1, 0), (None, 2, 2, 2)]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Expand" not in plan
