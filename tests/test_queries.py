import os

import duckdb
import pytest

import __spark_entry__
from ledgerloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


def canon(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(bool(v))
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return str(v)[:19].removesuffix(" 00:00:00")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(tuple(map(canon, r)) for r in cursor.fetchall())
    got = sorted(tuple(canon(r[c]) for c in columns) for r in found.collect())
    assert got == want


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        assert {"ok", "suspected_recapture"} <= {r["dq_status"] for r in __spark_entry__.entry(spark).collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_relationships_check_reads_the_whole_parent_table(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(queries.QUERIES["dq_relationships"](spark, SF)._jdf.queryExecution(), "simple")
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert not any("% 10) = 3" in x and "CASE" not in x and "if" not in x for x in filters)
