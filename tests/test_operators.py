import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.operators import analytics, dimensions, duplicates, facts, gate, quality, staging
from ledgerloom.sources import seeds

D = dt.date.fromisoformat
LANDING = "suburb string, address string, rooms int, type string, price double, method string, sellerg string, date date, postcode string, regionname string, propertycount int, distance double, councilarea string, _load_id string, _source_row int"
ROWS = "suburb_key string, street_address_key string, rooms int, type_code string, method_code string, agent_key string, sale_price double, bid_amount double, event_date date, source_row int, load_id string, load_started_at timestamp"


def land(spark, *rows):
    base = dict(suburb="Croydon", address="1 A St", rooms=2, type="h", price=1.0, method="S", sellerg="Ray", date=D("2017-01-01"), postcode="3136", regionname="East", propertycount=5, distance=1.5, councilarea="M", _load_id="x", _source_row=1)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], LANDING)


def no_receipts(spark):
    return spark.createDataFrame([], "load_id string, started_at timestamp")


def test_staging_keys_and_no_row_dropped(spark):
    s = staging.stage(land(spark, {}, {}, {"suburb": "croydon", "method": "s", "type": "H", "sellerg": "RAY", "price": None}), no_receipts(spark)).collect()
    assert len(s) == 3 and {r["suburb_key"] for r in s} == {"croydon"} and {r["suburb_name"] for r in s} == {"Croydon", "croydon"}
    assert {(r["method_code"], r["type_code"], r["agent_key"]) for r in s} == {("S", "h", "ray")} and s[2]["reported_price"] is None and s[0]["load_started_at"] is None


def test_unstaged_survives_null_load_ids(spark):
    landing = land(spark, {"_load_id": "a"}, {"_load_id": "b"}, {"_load_id": None})
    have = spark.createDataFrame([("a",), (None,)], "load_id string")
    assert {r["_load_id"] for r in staging.unstaged(landing, have).collect()} == {"b", None}


@pytest.mark.parametrize("method,price,want", [
    ("S", 1490000.0, (True, 1490000.0, None, True)), ("PI", 2700000.0, (False, None, 2700000.0, False)), ("VB", 790000.0, (False, None, 790000.0, False)),
    ("SN", None, (True, None, None, False)), ("S", None, (True, None, None, False)), ("W", None, (False, None, None, False)),
])
def test_measures(spark, method, price, want):
    s = staging.stage(land(spark, {"method": method, "price": price}), no_receipts(spark))
    r = staging.derive_measures(s, seeds.sale_methods(spark)).first()
    assert (r["is_sold"], r["sale_price"], r["bid_amount"], r["sale_price_is_disclosed"]) == want


def test_measures_keep_rows_and_drop_unknown_methods(spark):
    s = staging.stage(land(spark, {"price": 100.0}, {"price": 100.0}, {"method": "PI"}, {"method": "??"}), no_receipts(spark))
    assert staging.derive_measures(s, seeds.sale_methods(spark)).count() == 3
    assert quality.orphans(s, "method_code", seeds.sale_methods(spark), "method_code").count() == 1


def classify(spark, *rows):
    base = dict(suburb_key="a", street_address_key="1", rooms=2, type_code="h", method_code="VB", agent_key="g", sale_price=None, bid_amount=None, event_date=None, source_row=None, load_id=None, load_started_at=None)
    made = []
    for i, r in enumerate(rows):
        r = dict(r)
        r["event_date"] = D(r["event_date"])
        made.append(tuple((base | {"source_row": i} | r).values()))
    return duplicates.classify_duplicates(spark.createDataFrame(made, ROWS)).orderBy("source_row")


def status(df):
    return [r["dq_status"] for r in df.collect()]


def test_chain_of_five_weeks(spark):
    out = classify(spark, *[{"bid_amount": 750000.0, "event_date": d} for d in ("2017-12-16", "2017-12-23", "2017-12-30", "2018-01-06", "2018-01-08")]).collect()
    assert [r["recapture_rank"] for r in out] == [1, 2, 3, 4, 5] and {r["surviving_event_date"] for r in out} == {D("2017-12-16")}
    assert [r["dq_status"] for r in out] == ["ok"] + ["suspected_recapture"] * 4


@pytest.mark.parametrize("second,want", [("2017-04-22", [1, 2]), ("2017-04-23", [1, 1]), ("2017-07-01", [1, 1])])
def test_window_boundary(spark, second, want):
    out = classify(spark, {"bid_amount": 1.0, "event_date": "2017-04-01"}, {"bid_amount": 1.0, "event_date": second}).collect()
    assert [r["recapture_rank"] for r in out] == want


@pytest.mark.parametrize("change", [{"bid_amount": 1.3}, {"agent_key": "other"}, {"street_address_key": "2"}])
def test_different_offers_dont_chain(spark, change):
    out = classify(spark, {"bid_amount": 1.25, "event_date": "2017-04-01"}, {"bid_amount": 1.25, "event_date": "2017-04-08"} | change).collect()
    assert [r["recapture_rank"] for r in out] == [1, 1]


def test_restatements(spark):
    s = lambda **k: {"method_code": "S", "event_date": "2017-12-16"} | k
    assert status(classify(spark, s(sale_price=900000.0), s(sale_price=900000.0))) == ["ok", "exact_duplicate"]
    assert status(classify(spark, s(), s(sale_price=851000.0))) == ["suspected_restatement", "ok"]
    assert status(classify(spark, s(sale_price=1405000.0), s())) == ["ok", "suspected_restatement"]
    assert status(classify(spark, s(sale_price=900000.0), s(sale_price=910000.0))) == ["ok", "suspected_restatement"]
    old, new = dt.datetime(2001, 1, 1), dt.datetime(2026, 1, 1)
    assert status(classify(spark, s(load_started_at=old), s(sale_price=450000.0, load_started_at=new))) == ["suspected_restatement", "ok"]
    assert status(classify(spark, s(sale_price=450000.0, load_started_at=old), s(load_started_at=new))) == ["suspected_restatement", "ok"]
    # a re-delivered row makes the older copy the duplicate
    assert status(classify(spark, s(sale_price=1.0, load_started_at=old), s(sale_price=1.0, load_started_at=new))) == ["exact_duplicate", "ok"]


def test_null_prices_chain_and_restatements_dont_anchor(spark):
    out = classify(spark, {"method_code": "SN", "event_date": "2017-04-01"}, {"method_code": "SN", "event_date": "2017-04-08"}).collect()
    assert [r["recapture_rank"] for r in out] == [1, 2]
    out = classify(spark, {"bid_amount": 750000.0, "event_date": "2017-12-16"}, {"event_date": "2017-12-16"}, {"bid_amount": 750000.0, "event_date": "2017-12-23"}).collect()
    assert [(r["dq_status"], r["recapture_rank"]) for r in out] == [("ok", 1), ("suspected_restatement", None), ("suspected_recapture", 2)]


def test_classification_needs_one_shuffle(spark):
    df = classify(spark, {"event_date": "2017-01-01"})
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(duplicates.classify_duplicates(spark.createDataFrame([], ROWS))._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_tasks_of_the_classification_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "ROWS_A_TASK", 100)
    rows = spark.range(3000).selectExpr("cast(id as string) as suburb_key", "'1' as street_address_key", "2 as rooms", "'h' as type_code", "'VB' as method_code", "'g' as agent_key", "1.0D as sale_price", "cast(null as double) as bid_amount",
                                        "date'2017-01-01' as event_date", "cast(id as int) as source_row", "'x' as load_id", "cast(null as timestamp) as load_started_at")
    for given in ({}, {"at_most": 3000}):
        sizes = duplicates.classify_duplicates(rows, **given).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) < 200


def test_chains_in_one_sort_and_rows_without_date(spark):
    base = ("a", "1", 2, "h", "VB", "g", 1.0, None)
    days = ["2017-01-01", "2017-01-20", "2017-03-01", "2017-03-05", "2017-03-26", None]
    rows = spark.createDataFrame([(*base, d and D(d), i, "x", None) for i, d in enumerate(days)], ROWS)
    got = [(r["recapture_cluster"], r["recapture_rank"], r["surviving_event_date"]) for r in duplicates.classify_duplicates(rows).orderBy("source_row").collect()]
    first, second = D("2017-01-01"), D("2017-03-01")
    assert got == [(1, 1, first), (1, 2, first), (2, 1, second), (2, 2, second), (2, 3, second), (3, 1, None)]
    plan = spark._jvm.PythonSQLUtils.explainString(duplicates.classify_duplicates(rows)._jdf.queryExecution(), "simple")
    assert plan.count("Sort [") == 2


def test_deduped_and_quarantine_are_complements(spark):
    c = classify(spark, {"bid_amount": 1.0, "event_date": "2017-04-01"}, {"bid_amount": 1.0, "event_date": "2017-04-02"}, {"event_date": "2017-06-02"})
    good, bad = duplicates.deduped(c), duplicates.quarantine(c)
    assert (good.count(), bad.count()) == (2, 1) and bad.first()["reason"] == "suspected_recapture"
    assert quality.ledger(c, good, bad).isEmpty() and not quality.ledger(c, good, bad.limit(0)).isEmpty()
    assert duplicates.classify_duplicates(spark.createDataFrame([], ROWS)).isEmpty()


def test_canonical_names(spark):
    g = spark.createDataFrame([("c", "Croydon"), ("c", "Croydon"), ("c", "croydon"), ("m", "MacLeod"), ("m", "Macleod")], "k string, n string")
    assert {r["k"]: r["n"] for r in dimensions.canonical_name(g, "k", "n").collect()} == {"c": "Croydon", "m": "MacLeod"}
    p = spark.createDataFrame([("a", "1 x st", "1 X St"), ("b", "1 x st", "1 X St")], "suburb_key string, street_address_key string, street_address string")
    assert dimensions.dim_property(p).select("property_key").distinct().count() == 2


def test_calendar(spark):
    d = dimensions.dim_date(spark.createDataFrame([(D("2017-01-30"),), (D("2017-02-02"),)], "event_date date"))
    rows = d.orderBy("date_day").collect()
    assert len(rows) == 59 and rows[0]["date_day"] == D("2017-01-01") and rows[-1]["date_day"] == D("2017-02-28")
    assert [r["date_day"].day for r in rows if r["is_saturday"]][:2] == [7, 14] and rows[0]["day_of_week"] == 0
    assert dimensions.dim_date(spark.createDataFrame([], "event_date date")).isEmpty()


FACT = "property_key string, suburb_key string, agent_key string, event_date date, is_sold boolean, is_auction boolean, sale_price double, bid_amount double, rooms int"


def fact(spark, *rows):
    base = dict(property_key="p1", suburb_key="s", agent_key="a", event_date=None, is_sold=True, is_auction=True, sale_price=None, bid_amount=None, rooms=2)
    return spark.createDataFrame([tuple((base | r | {"event_date": D(r["event_date"])}).values()) for r in rows], FACT)


def dims(spark, f):
    suburb = spark.createDataFrame([("s", "S", "R")], "suburb_key string, suburb_name string, region_name string")
    prop = f.select("property_key").distinct().withColumn("street_address", F.lit("x"))
    return suburb, prop, spark.createDataFrame([("a", "A")], "agent_key string, agent_name string"), dimensions.dim_date(f)


def test_monthly_market(spark):
    f = fact(spark, {"event_date": "2017-03-01", "sale_price": 900000.0}, {"event_date": "2017-03-02"}, {"event_date": "2017-03-02", "is_sold": False}, {"event_date": "2017-05-02", "sale_price": 990000.0})
    suburb, _, _, dates = dims(spark, f)
    m = {r["month_start"].month: r for r in analytics.suburb_monthly_market(f, dates, suburb).collect()}
    assert m[3]["clearance_rate"] == pytest.approx(2 / 3) and m[3]["avg_price_per_room"] == 450000 and m[3]["median_sale_price_mom_change"] is None
    assert (m[4]["listings"], m[4]["sales"], m[4]["clearance_rate"], m[4]["median_sale_price_mom_change"]) == (0, 0, None, None)
    assert m[5]["median_sale_price_3m_avg"] == 945000 and m[5]["prev_month_clearance_rate"] is None
    f = fact(spark, {"event_date": "2017-04-01", "sale_price": 900000.0}, {"event_date": "2017-05-02", "sale_price": 990000.0})
    m = {r["month_start"].month: r for r in analytics.suburb_monthly_market(f, dims(spark, f)[3], suburb).collect()}
    assert m[5]["median_sale_price_mom_change"] == 90000


def test_agents(spark):
    f = fact(spark, {"event_date": "2017-03-01", "sale_price": 900000.0}, {"event_date": "2017-03-02", "sale_price": 800000.0, "is_auction": False}, {"event_date": "2017-03-03", "is_sold": False})
    suburb, _, agent, dates = dims(spark, f)
    r = analytics.agent_performance(f, agent, suburb, dates).first()
    assert (r["gmv"], r["region_gmv_share"], r["rank_by_gmv_in_region"]) == (1700000, 1.0, 1) and r["auction_share"] == pytest.approx(2 / 3)


def test_repeat_sales(spark):
    f = fact(spark, {"event_date": "2016-04-02", "sale_price": 1e6}, {"event_date": "2018-04-07", "sale_price": 1.25e6}, {"property_key": "p2", "event_date": "2018-04-07", "sale_price": 5.0},
             {"property_key": "p3", "event_date": "2016-04-07", "sale_price": 5.0}, {"property_key": "p3", "event_date": "2018-04-07", "is_sold": False}, {"property_key": "p4", "event_date": "2018-04-01", "sale_price": 5.0},
             {"property_key": "p4", "event_date": "2018-04-08", "sale_price": 5.0})
    suburb, prop, _, _ = dims(spark, f)
    (r,) = analytics.repeat_sales(f, prop, suburb).collect()
    assert (r["property_key"], r["days_held"], r["gain_amount"]) == ("p1", 735, 250000) and r["annualised_return"] == pytest.approx(1.25 ** (365 / 735) - 1)


def test_expectation_gap(spark):
    bid = {"event_date": "2017-04-01", "is_sold": False, "bid_amount": 2.7e6}
    f = fact(spark, bid, bid, {"event_date": "2017-04-01", "sale_price": 1.0}, {"event_date": "2017-07-01", "sale_price": 2.9e6}, {"event_date": "2017-07-01", "sale_price": 3.0e6}, {"event_date": "2018-07-01", "sale_price": 9e6},
             {"property_key": "p2", "event_date": "2017-01-01", "sale_price": 5.0}, bid | {"property_key": "p2"})
    suburb, prop, _, _ = dims(spark, f)
    out = analytics.vendor_expectation_gap(f, prop, suburb).orderBy("gap_amount").collect()
    assert [(r["property_key"], r["gap_amount"], r["days_to_sale"]) for r in out] == [("p1", 200000, 91), ("p1", 300000, 91)]


def test_checks(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (None, "c", -1.0), (2, "z", 2.0)], "k int, v string, x double")
    assert quality.nulls(t, "k").count() == 1 and quality.repeated(t, "k").count() == 1 and quality.repeated(t, "k", "v").count() == 0
    assert quality.unaccepted(t, "v", ["a", "b", "c"]).count() == 1 and quality.untrue(t, "x > 0").count() == 1
    assert quality.orphans(t, "k", t.filter("k = 2"), "k").count() == 2 and quality.undetermined(t, "k", ["v"]).count() == 1
    rules = {"k": F.col("k").isNotNull(), "v": F.col("v").isin("a", "b", "c"), "x": F.expr("x > -2"), "both": F.expr("k < 2 and x > 0")}
    assert {r["rule"]: r["n"] for r in quality.broken(t, rules).collect()} == {"k": 1, "v": 1, "both": 2} and quality.broken(t.limit(0), rules).isEmpty()
    assert quality.difference(t, t.filter("v != 'z'")).count() == 1 and quality.difference(t, t).isEmpty()
    a = spark.createDataFrame([(1, 0.1 + 0.2, "l1")], "a int, x double, load_id string")
    assert quality.difference(a, spark.createDataFrame([(1, 0.3, "l2")], a.schema)).isEmpty()


BASE = {"load_id": "x", "rows_read": 63023, "rows_loaded": 63023, "rows_rejected": 0, "reject_reasons": {}}


@pytest.mark.parametrize("change,said", [
    ({}, []), ({"rows_loaded": 60000}, ["ledger"]), ({"rows_loaded": 63023 - 629, "rows_rejected": 629}, []), ({"rows_loaded": 63023 - 631, "rows_rejected": 631, "reject_reasons": {"price_not_numeric": 631}}, ["reject rate"]),
    ({"rows_read": 49999, "rows_loaded": 49999}, ["outside the expected"]), ({"rows_read": 200001, "rows_loaded": 200001}, ["outside the expected"]), ({"rows_read": 0, "rows_loaded": 0}, ["outside the expected"]),
    ({"rows_read": 100, "rows_loaded": 50, "rows_rejected": 10}, ["ledger", "reject rate", "outside"]),
])
def test_gate(change, said):
    found = gate.evaluate_receipt(BASE | change)
    assert len(found) == len(said) and all(any(s in f for f in found) for s in said)


def test_gate_needs_its_counts(spark):
    for k in ("rows_read", "rows_loaded", "rows_rejected"):
        with pytest.raises(KeyError):
            gate.evaluate_receipt({a: b for a, b in BASE.items() if a != k})
    r = spark.createDataFrame([("a", 10, 9, 0), ("b", 10, 10, 0)], "load_id string, rows_read long, rows_loaded long, rows_rejected long")
    got = {x["load_id"]: x["problems"] for x in gate.evaluate_receipts(r, Config(min_rows_loaded=1)).collect()}
    assert got == {"a": ["ledger"], "b": []}


def test_fact_keys(spark):
    c = classify(spark, {"event_date": "2017-01-01"}).withColumns({c: F.lit(True) for c in ("is_sold", "is_auction", "sale_price_is_disclosed")})
    row = facts.fact_listing_outcome(duplicates.deduped(c)).first()
    assert len(row["listing_outcome_key"]) == 32 and row["rooms"] == 2
