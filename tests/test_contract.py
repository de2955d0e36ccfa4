import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.plans import contract
from ledgerloom.plans.pipeline import MATERIALISATION, build
from ledgerloom.plans.versions import Warehouse
from ledgerloom.sources import csv_feed
from test_runs import SMALL, TODAY, listings, write


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("contract")
    csv_feed.load_csv(spark, write(at / "a.csv", listings(60)), str(at / "l"), today=TODAY)
    build(spark, str(at / "l"), str(at / "w"), None, SMALL, check=False)
    return Warehouse(spark, str(at / "w")).table


def test_sound_tables_break_nothing(tables):
    assert set(contract.FILLED) == set(MATERIALISATION)
    assert [what for what, rows in contract.checks(tables, Config()).items() if not rows.isEmpty()] == []


def spoilt(tables, **changed):
    return contract.checks(lambda name: changed[name](tables(name)) if name in changed else tables(name), Config())


def test_broken_tables_are_told(tables):
    first = lambda c: F.col(c) == F.lit(tables("fact_listing_outcome").agg(F.min(c)).first()[0])
    found = spoilt(
        tables, fact_listing_outcome=lambda df: df.withColumn("type_code", F.when(first("listing_outcome_key"), "?").otherwise(F.col("type_code"))).withColumn("is_sold", F.when(~first("listing_outcome_key"), F.col("is_sold"))),
        dim_agent=lambda df: df.unionByName(df), quarantined_listing_outcome=lambda df: df.withColumn("reason", F.lit("other")),
    )
    told = lambda what: {r["rule"]: r["n"] for r in found[what].collect()}
    assert told("rules of fact_listing_outcome") == {"is_sold is filled": 1}
    assert told("rules of quarantined_listing_outcome") == {"reason is known": tables("quarantined_listing_outcome").count()}
    assert found["type_code of fact_listing_outcome not in dim_property_type"].count() == 1
    assert found["repeated agent_key in dim_agent"].count() == tables("dim_agent").count()
    assert found["row ledger"].isEmpty() and found["rules of dim_agent"].isEmpty()
