"""The warehouse's operators as registered queries, each with the same question in SQL.

The driver's tables play the parts of listings: an order is a listing, its customer the property, the
customer's nation and market segment the suburb, the order's status the sale method.  Prices are coarse and
some are withheld, by rules of the order key, so that every kind of duplicate occurs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import coercion, scalars
from .functions.keys import NULL, SEPARATOR, surrogate_key
from .operators import analytics, dimensions, duplicates, facts, gate, pieces, quality, snapshots, staging
from .plans import deliveries, incremental
from .sources import csv_feed, seeds
from .sources.scratch import settle, shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the listings

METHODS = [("F", "filled", True, True), ("O", "open", True, False), ("P", "pending", False, True)]
_METHODS_SQL = "methods AS (SELECT * FROM (VALUES ('F','filled',true,true),('O','open',true,false),('P','pending',false,true)) m(method_code, method_description, is_sold, is_auction))"


def _methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "method_code string, method_description string, is_sold boolean, is_auction boolean")


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed rows: spellings vary with the key, with blanks around."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    spelled = lambda x: F.when(k % 5 == 0, F.concat(F.lit(" "), F.upper(x))).when(k % 5 == 1, F.lower(x)).otherwise(x)
    suburb = F.concat_ws("-", F.lower("n_name"), F.lower("c_mktsegment"))
    return rows.select(
        spelled(suburb).alias("suburb"), spelled(F.concat(F.lit("Lot "), F.col("o_custkey"))).alias("address"), (k % 2 + 1).cast("int").alias("rooms"),
        F.substring("o_orderpriority", 1, 1).alias("type"), F.when(k % 7 != 0, (F.floor(F.col("o_totalprice") / 100000) + 1) * 100000.0).cast("double").alias("price"),
        F.when(k % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("method"), spelled(F.concat(F.lit("Agent "), F.col("o_custkey") % 3)).alias("sellerg"),
        F.expr("date_sub(to_date(o_orderdate), (day(o_orderdate) - 1) % 10)").alias("date"), F.lpad((F.col("c_nationkey") + 100).cast("string"), 4, "0").alias("postcode"), F.col("r_name").alias("regionname"),
        F.col("c_nationkey").cast("int").alias("propertycount"), (F.col("c_nationkey") / 2).cast("double").alias("distance"), F.col("n_name").alias("councilarea"),
        F.concat(F.lit("load"), (k % 5).cast("string")).alias("_load_id"), k.cast("int").alias("_source_row"),
    )


_LANDING = """landing AS (
  SELECT CASE WHEN k % 5 = 0 THEN ' ' || upper(sub) WHEN k % 5 = 1 THEN lower(sub) ELSE sub END AS suburb,
    CASE WHEN k % 5 = 0 THEN ' ' || upper(lot) WHEN k % 5 = 1 THEN lower(lot) ELSE lot END AS address,
    (k % 2 + 1)::int AS rooms, substr(o_orderpriority, 1, 1) AS type,
    CASE WHEN k % 7 <> 0 THEN ((floor(o_totalprice / 100000) + 1) * 100000.0)::double END AS price,
    CASE WHEN k % 3 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS method,
    CASE WHEN k % 5 = 0 THEN ' ' || upper(ag) WHEN k % 5 = 1 THEN lower(ag) ELSE ag END AS sellerg,
    (o_orderdate::date - ((day(o_orderdate) - 1) % 10)::int)::date AS date, lpad((c_nationkey + 100)::varchar, 4, '0') AS postcode, r_name AS regionname,
    c_nationkey::int AS propertycount, (c_nationkey / 2.0)::double AS distance, n_name AS councilarea,
    'load' || (k % 5) AS _load_id, k::int AS _source_row
  FROM (SELECT *, o_orderkey AS k, lower(n_name) || '-' || lower(c_mktsegment) AS sub, 'Lot ' || o_custkey AS lot, 'Agent ' || (o_custkey % 3) AS ag
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""

_LOADS = [(f"load{i}", i) for i in range(4)]  # load4 has no receipt


def receipts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LOADS, "load_id string, i int").select("load_id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, i)").alias("started_at"))


_RECEIPTS = "receipts AS (SELECT 'load' || i AS load_id, TIMESTAMP '2024-01-01' + to_days(i::int) AS started_at FROM range(4) t(i))"
_STAGED = """staged AS (
  SELECT lower(trim(suburb)) AS suburb_key, trim(suburb) AS suburb_name, trim(postcode) AS postcode, trim(regionname) AS region_name, trim(councilarea) AS council_area,
    distance AS cbd_distance_km, propertycount AS property_count, trim(address) AS street_address, lower(trim(address)) AS street_address_key, rooms,
    lower(trim(type)) AS type_code, upper(trim(method)) AS method_code, date AS event_date, lower(trim(sellerg)) AS agent_key, trim(sellerg) AS agent_name,
    price AS reported_price, _load_id AS load_id, _source_row AS source_row, started_at AS load_started_at
  FROM landing LEFT JOIN receipts ON _load_id = load_id)"""
_MEASURED = """measured AS (
  SELECT s.* EXCLUDE (reported_price), is_sold, is_auction, CASE WHEN is_sold THEN reported_price END AS sale_price, CASE WHEN NOT is_sold THEN reported_price END AS bid_amount,
    coalesce(is_sold AND reported_price IS NOT NULL, false) AS sale_price_is_disclosed
  FROM staged s JOIN methods USING (method_code))"""


def _key_sql(*parts: str) -> str:
    return "md5(concat_ws(chr(1), " + ", ".join(f"coalesce({p}, chr(2) || 'null' || chr(2))" for p in parts) + "))"


_SIGNATURE = _key_sql("suburb_key", "street_address_key", "rooms::varchar", "type_code", "method_code", "agent_key", "sale_price::decimal(18,2)::varchar", "bid_amount::decimal(18,2)::varchar")
_PROPERTY = _key_sql("suburb_key", "street_address_key")
_CLASSIFIED = f"""ranked AS (
  SELECT *, {_SIGNATURE} AS business_signature, md5(concat_ws('|', rooms, type_code, coalesce(sale_price::varchar,'-'), coalesce(bid_amount::varchar,'-'))) AS content,
    row_number() OVER g AS rk, first_value(md5(concat_ws('|', rooms, type_code, coalesce(sale_price::varchar,'-'), coalesce(bid_amount::varchar,'-')))) OVER g AS content0
  FROM measured
  WINDOW g AS (PARTITION BY suburb_key, street_address_key, event_date, method_code, agent_key
    ORDER BY load_started_at DESC NULLS LAST, CASE WHEN coalesce(sale_price, bid_amount) IS NOT NULL THEN 0 ELSE 1 END, source_row, load_id)),
gapped AS (SELECT load_id, source_row, business_signature, event_date,
    date_diff('day', lag(event_date) OVER (PARTITION BY business_signature ORDER BY event_date, source_row, load_id), event_date) AS gap FROM ranked WHERE rk = 1),
chained AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21 THEN 1 ELSE 0 END) OVER (PARTITION BY business_signature ORDER BY event_date, source_row, load_id ROWS UNBOUNDED PRECEDING)::bigint AS cluster FROM gapped),
placed AS (SELECT *, row_number() OVER (PARTITION BY business_signature, cluster ORDER BY event_date, source_row, load_id) AS place, min(event_date) OVER (PARTITION BY business_signature, cluster) AS first_date FROM chained),
classified AS (
  SELECT r.* EXCLUDE (content, content0, rk), gap::bigint AS days_since_previous_appearance, cluster AS recapture_cluster, place AS recapture_rank,
    coalesce(first_date, r.event_date) AS surviving_event_date,
    CASE WHEN rk > 1 AND content = content0 THEN 'exact_duplicate' WHEN rk > 1 THEN 'suspected_restatement' WHEN place = 1 THEN 'ok' ELSE 'suspected_recapture' END AS dq_status
  FROM ranked r LEFT JOIN placed p ON r.load_id = p.load_id AND r.source_row = p.source_row)"""
_GOOD = f"good AS (SELECT {', '.join(duplicates.DEDUPED_COLUMNS)} FROM classified WHERE dq_status = 'ok')"
_QUARANTINE = f"quarantine AS (SELECT {_key_sql('load_id', 'source_row::varchar')} AS quarantine_key, dq_status AS reason, {', '.join(duplicates.QUARANTINE_COLUMNS)} FROM classified WHERE dq_status <> 'ok')"
_FACT = f"""fact AS (SELECT {_key_sql('business_signature', 'event_date::varchar')} AS listing_outcome_key, {_PROPERTY} AS property_key, suburb_key, agent_key, event_date, method_code, type_code,
    rooms, sale_price, bid_amount, sale_price_is_disclosed, is_sold, is_auction, load_id, source_row FROM good)"""


def _canonical_sql(keys: str, name: str) -> str:
    return f"(SELECT {keys}, {name} FROM (SELECT {keys}, {name}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {name}) AS rn FROM good GROUP BY {keys}, {name}) WHERE rn = 1)"


_DIMS = f"""dim_suburb AS (SELECT suburb_key, suburb_name, postcode, region_name, council_area, cbd_distance_km, property_count FROM {_canonical_sql('suburb_key', 'suburb_name')}
    JOIN (SELECT suburb_key, min(postcode) AS postcode, min(region_name) AS region_name, min(council_area) AS council_area, min(cbd_distance_km) AS cbd_distance_km, min(property_count) AS property_count FROM good GROUP BY 1) USING (suburb_key)),
dim_property AS (SELECT {_PROPERTY} AS property_key, suburb_key, street_address_key, street_address FROM {_canonical_sql('suburb_key, street_address_key', 'street_address')}),
dim_agent AS (SELECT agent_key, agent_name FROM {_canonical_sql('agent_key', 'agent_name')}),
dim_date AS (SELECT d AS date_day, year(d)::bigint AS calendar_year, month(d)::bigint AS calendar_month, date_trunc('month', d)::date AS month_start, strftime(d, '%Y-%m') AS year_month,
    dayofweek(d)::bigint AS day_of_week, strftime(d, '%A') AS day_name, dayofweek(d) = 6 AS is_saturday
  FROM (SELECT unnest(generate_series(date_trunc('month', min(event_date)), last_day(max(event_date)), INTERVAL 1 DAY))::date AS d FROM good))"""

_TO_STAGED = ",\n".join([_LANDING, _RECEIPTS, _STAGED])
_TO_MEASURED = ",\n".join([_TO_STAGED, _METHODS_SQL, _MEASURED])
_TO_CLASSIFIED = ",\n".join([_TO_MEASURED, _CLASSIFIED])
_TO_FACT = ",\n".join([_TO_CLASSIFIED, _GOOD, _QUARANTINE, _FACT, _DIMS])


def _with(prefix: str, body: str) -> str:
    return f"WITH {prefix}\n{body}"


def staged(spark, sf_dir) -> DataFrame:
    return staging.stage(landing(spark, sf_dir), receipts(spark))


def measured(spark, sf_dir) -> DataFrame:
    return staging.derive_measures(staged(spark, sf_dir), _methods(spark))


def classified(spark, sf_dir) -> DataFrame:
    """An order is at most one row, and counting orders reads no column."""
    return duplicates.classify_duplicates(measured(spark, sf_dir), at_most=_table(spark, sf_dir, "orders").count())


def good(spark, sf_dir) -> DataFrame:
    return duplicates.deduped(classified(spark, sf_dir))


def star(spark, sf_dir) -> dict[str, DataFrame]:
    """Fact and dimensions over the same outcomes, which are classified once."""
    g = settle(good(spark, sf_dir), "good")
    fact, suburb = settle(facts.fact_listing_outcome(g), "fact"), settle(dimensions.dim_suburb(g), "suburb")
    return {"good": g, "fact": fact, "suburb": suburb, "property": dimensions.dim_property(g), "agent": dimensions.dim_agent(g), "date": dimensions.dim_date(g)}


# ---------------------------------------------------------------- staging and measures


@_register(_with(_TO_STAGED, "SELECT * FROM staged"))
def stage_listings(spark, sf_dir):
    """P1-P3, J1."""
    return staged(spark, sf_dir)


@_register(_with(_TO_STAGED, "SELECT load_id, count(*) AS n FROM staged WHERE load_id NOT IN ('load1', 'load3') GROUP BY 1"))
def skip_staged_loads(spark, sf_dir):
    """Loads that the log has are not taken again."""
    log = staged(spark, sf_dir).filter(F.col("load_id").isin("load1", "load3"))
    new = staging.stage(staging.unstaged(landing(spark, sf_dir), log), receipts(spark))
    return new.groupBy("load_id").agg(F.count("*").alias("n"))


@_register(_with(_TO_MEASURED, "SELECT load_id, source_row, method_code, is_sold, is_auction, sale_price, bid_amount, sale_price_is_disclosed FROM measured"))
def split_measures(spark, sf_dir):
    """P4, P5, J3."""
    return measured(spark, sf_dir).select("load_id", "source_row", "method_code", "is_sold", "is_auction", "sale_price", "bid_amount", "sale_price_is_disclosed")


@_register(f"SELECT c_custkey, {_key_sql('c_name', 'c_nationkey::varchar', 'nullif(c_acctbal, c_acctbal)::varchar', 'c_acctbal::decimal(18,2)::varchar')} AS customer_key FROM customer")
def surrogate_keys(spark, sf_dir):
    """Nulls compare equal, doubles as decimals."""
    nothing = F.lit(None).cast("string")
    return _table(spark, sf_dir, "customer").select("c_custkey", surrogate_key(F.col("c_name"), F.col("c_nationkey"), nothing, F.col("c_acctbal").cast("decimal(18,2)")).alias("customer_key"))


@_register("""SELECT o_orderkey, date_diff('day', o_orderdate::date, DATE '1999-01-01')::bigint AS days_left, date_trunc('month', o_orderdate)::date AS month_start,
  last_day(o_orderdate::date) AS month_end, year(o_orderdate)::bigint AS y, month(o_orderdate)::bigint AS m, dayofweek(o_orderdate)::bigint AS dow, strftime(o_orderdate, '%A') AS day_name FROM orders""")
def date_parts(spark, sf_dir):
    """P7-P11."""
    d = F.to_date("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.days_between(d, F.lit("1999-01-01").cast("date")).alias("days_left"), scalars.month_start(d).alias("month_start"), F.last_day(d).alias("month_end"),
        F.year(d).cast("bigint").alias("y"), F.month(d).cast("bigint").alias("m"), (F.dayofweek(d) - 1).cast("bigint").alias("dow"), F.date_format(d, "EEEE").alias("day_name"),
    )


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_linenumber - 1, 0), 6) AS ratio,
  round(power(1 + l_discount, 365.0 / nullif(l_linenumber - 1, 0)) - 1, 6) AS yearly, coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem""")
def guarded_ratios(spark, sf_dir):
    """No division by zero, zero filled, rounded for comparison."""
    n = F.col("l_linenumber") - 1
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scalars.guarded_ratio("l_extendedprice", n), 6).alias("ratio"),
        F.round(scalars.annualised(1 + F.col("l_discount"), n), 6).alias("yearly"), F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("tax"),
    )


# ---------------------------------------------------------------- duplicates


@_register(_with(_TO_CLASSIFIED, "SELECT * FROM classified"))
def classify_listings(spark, sf_dir):
    """P6, P21, W1-W6; every row with its status."""
    return classified(spark, sf_dir)


@_register(_with(_TO_CLASSIFIED, "SELECT dq_status, count(*) AS n, count(recapture_cluster) AS in_chains, max(recapture_rank)::bigint AS longest_chain FROM classified GROUP BY 1"))
def duplicate_status_counts(spark, sf_dir):
    """The flagship."""
    return classified(spark, sf_dir).groupBy("dq_status").agg(F.count("*").alias("n"), F.count("recapture_cluster").alias("in_chains"), F.max("recapture_rank").alias("longest_chain"))


@_register(_with(",\n".join([_TO_CLASSIFIED, _GOOD]), "SELECT * FROM good"))
def deduped_listings(spark, sf_dir):
    """C4."""
    return good(spark, sf_dir)


@_register(_with(",\n".join([_TO_CLASSIFIED, _QUARANTINE]), "SELECT * FROM quarantine"))
def quarantined_listings(spark, sf_dir):
    """C4."""
    return duplicates.quarantine(classified(spark, sf_dir))


@_register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE rn = 1""")
def latest_statement(spark, sf_dir):
    """The current row of each restated order line.  A minimum over structs, so no window is needed."""
    li = _table(spark, sf_dir, "lineitem")
    order = F.struct(F.expr("-timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))").alias("o"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    kept = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(order).alias("s"), F.count("*").alias("n"))
    return kept.select("l_orderkey", "l_linenumber", "s.l_partkey", "s.l_suppkey", "s.l_shipdate", "n")


_HOT = """measured AS (SELECT * REPLACE (CASE WHEN source_row % 3 = 1 THEN 'everywhere' ELSE suburb_key END AS suburb_key, CASE WHEN source_row % 3 = 1 THEN 'lot 0' ELSE street_address_key END AS street_address_key) FROM even)"""
_TO_HOT = ",\n".join([_TO_STAGED, _METHODS_SQL, _MEASURED.replace("measured AS", "even AS", 1), _HOT, _CLASSIFIED])


@_register(_with(_TO_HOT, "SELECT load_id, source_row, business_signature, days_since_previous_appearance, recapture_cluster, recapture_rank, surviving_event_date, dq_status FROM classified"))
def classify_hot_listings(spark, sf_dir):
    """C3, W1-W6 where one property has a third of all rows: it is classified over pieces of its order."""
    rows, hot = measured(spark, sf_dir), F.col("source_row") % 3 == 1
    rows = rows.withColumns({"suburb_key": F.when(hot, "everywhere").otherwise(F.col("suburb_key")), "street_address_key": F.when(hot, "lot 0").otherwise(F.col("street_address_key"))})
    out = duplicates.classify_duplicates(settle(rows, "hot-listings"), hot_rows=300)
    return out.select("load_id", "source_row", "business_signature", "days_since_previous_appearance", "recapture_cluster", "recapture_rank", "surviving_event_date", "dq_status")


_SESSIONS = """SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 DAY THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)))
  GROUP BY user_id, event_type, chain"""


@_register(_SESSIONS)
def event_chains(spark, sf_dir):
    """Gaps and islands by lag and running sum."""
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = _table(spark, sf_dir, "events")
    e = e.withColumn("before", F.lag("ts").over(by)).withColumn("gap", F.expr("timestampdiff(MICROSECOND, before, ts)"))
    e = e.withColumn("chain", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 2 * 86_400_000_000), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "event_type", "chain").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("chain")


@_register(_SESSIONS)
def event_sessions(spark, sf_dir):
    """W4's twin: the engine's own session windows merge at the same inclusive boundary."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.session_window("ts", "2 days").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("w")


# ---------------------------------------------------------------- star schema


@_register("""SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
  FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def canonical_priority(spark, sf_dir):
    """The mode with binary order among equals."""
    return dimensions.canonical_name(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@_register(_with(_TO_FACT, "SELECT * FROM dim_suburb"))
def dim_suburb(spark, sf_dir):
    """A8, J7."""
    return dimensions.dim_suburb(good(spark, sf_dir))


@_register(_with(_TO_FACT, "SELECT * FROM dim_property"))
def dim_property(spark, sf_dir):
    """C6."""
    return dimensions.dim_property(good(spark, sf_dir))


@_register(_with(_TO_FACT, "SELECT * FROM dim_agent"))
def dim_agent(spark, sf_dir):
    """C7."""
    return dimensions.dim_agent(good(spark, sf_dir))


@_register(_with(_TO_FACT, "SELECT * FROM dim_date"))
def dim_date(spark, sf_dir):
    """A7, P8-P12."""
    return dimensions.dim_date(good(spark, sf_dir))


def _values(rows) -> str:
    say = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v + "'"
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def _code_listings_sql(rows, columns: str) -> str:
    return f"""SELECT {columns}, count(o_orderkey) AS listings FROM (VALUES {_values(rows)}) t({columns}) JOIN (SELECT row_number() OVER (ORDER BY {columns.partition(",")[0]}) - 1 AS i, {columns.partition(",")[0]} FROM (VALUES {_values(rows)}) t({columns})) p USING ({columns.partition(",")[0]})
  LEFT JOIN orders ON o_orderkey % {len(rows) + 1} = i GROUP BY ALL"""


def _code_listings(spark, sf_dir, codes: DataFrame, code: str, n: int) -> DataFrame:
    """Each code with the orders that have it; one in n + 1 orders has a code that isn't known."""
    names = sorted(r[0] for r in codes.select(code).collect())
    used = _table(spark, sf_dir, "orders").select(F.try_element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % (n + 1) + 1).cast("int")).alias(code))
    return codes.join(used.groupBy(code).agg(F.count("*").alias("listings")), code, "left").withColumn("listings", F.coalesce("listings", F.lit(0).cast("bigint")))


@_register(_code_listings_sql(seeds.SALE_METHODS, "method_code, method_description, is_sold, is_auction"))
def dim_sale_method(spark, sf_dir):
    """C9, I21."""
    return _code_listings(spark, sf_dir, dimensions.dim_sale_method(seeds.sale_methods(spark)), "method_code", len(seeds.SALE_METHODS))


@_register(_code_listings_sql(seeds.PROPERTY_TYPES, "type_code, type_description"))
def dim_property_type(spark, sf_dir):
    """C9, I21."""
    return _code_listings(spark, sf_dir, dimensions.dim_property_type(seeds.property_types(spark)), "type_code", len(seeds.PROPERTY_TYPES))


@_register(_with(_TO_FACT, "SELECT * FROM fact"))
def fact_listing_outcome(spark, sf_dir):
    """C10."""
    return facts.fact_listing_outcome(good(spark, sf_dir))


# ---------------------------------------------------------------- analytics


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@_register(_with(_TO_FACT, """, measured_month AS (SELECT suburb_key, month_start, count(*) AS listings, count(*) FILTER (WHERE is_sold) AS sales, count(sale_price) AS disclosed_sales,
    median(sale_price) AS median_sale_price, avg(sale_price) AS avg_sale_price, avg(sale_price / nullif(rooms, 0)) AS avg_price_per_room
  FROM fact JOIN dim_date ON event_date = date_day GROUP BY 1, 2),
grid AS (SELECT suburb_key, suburb_name, region_name, month_start FROM dim_suburb CROSS JOIN (SELECT DISTINCT month_start FROM dim_date)),
j AS (SELECT suburb_key, suburb_name, region_name, month_start, coalesce(listings, 0) AS listings, coalesce(sales, 0) AS sales, coalesce(disclosed_sales, 0) AS disclosed_sales, median_sale_price,
    avg_sale_price, avg_price_per_room, sales::double / nullif(listings, 0) AS clearance_rate FROM grid LEFT JOIN measured_month USING (suburb_key, month_start))
SELECT suburb_key, suburb_name, region_name, month_start, listings, sales, disclosed_sales, round(median_sale_price, 6) AS median_sale_price, round(avg_sale_price, 6) AS avg_sale_price,
  round(avg_price_per_room, 6) AS avg_price_per_room, round(clearance_rate, 6) AS clearance_rate, round(lag(median_sale_price) OVER w, 6) AS prev_month_median_sale_price,
  round(median_sale_price - lag(median_sale_price) OVER w, 6) AS median_sale_price_mom_change, round(avg(median_sale_price) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS median_sale_price_3m_avg,
  round(lag(clearance_rate) OVER w, 6) AS prev_month_clearance_rate, dense_rank() OVER (PARTITION BY month_start, region_name ORDER BY listings DESC) AS rank_by_listings_in_region
FROM j WINDOW w AS (PARTITION BY suburb_key ORDER BY month_start)""").replace("\n, measured_month", ", measured_month"))
def suburb_monthly_market(spark, sf_dir):
    """C11: J8-J10, A1-A5, W8-W10, with months without listings."""
    s = star(spark, sf_dir)
    return _rounded(analytics.suburb_monthly_market(s["fact"], s["date"], s["suburb"]))


@_register(_with(_TO_FACT, """, per AS (SELECT agent_key, agent_name, region_name, month_start, count(*) AS listings, count(*) FILTER (WHERE is_sold) AS sales, count(*) FILTER (WHERE is_auction) AS auction_listings,
    coalesce(sum(sale_price), 0) AS gmv, median(sale_price) AS median_sale_price
  FROM fact JOIN dim_agent USING (agent_key) JOIN dim_suburb USING (suburb_key) JOIN dim_date ON event_date = date_day GROUP BY 1, 2, 3, 4)
SELECT agent_key, agent_name, region_name, month_start, listings, sales, auction_listings, round(gmv, 6) AS gmv, round(median_sale_price, 6) AS median_sale_price,
  round(sales::double / nullif(listings, 0), 6) AS clearance_rate, round(auction_listings::double / nullif(listings, 0), 6) AS auction_share,
  round(gmv / nullif(sum(gmv) OVER (PARTITION BY month_start, region_name), 0), 6) AS region_gmv_share,
  dense_rank() OVER (PARTITION BY month_start, region_name ORDER BY gmv DESC) AS rank_by_gmv_in_region FROM per""").replace("\n, per", ", per"))
def agent_performance(spark, sf_dir):
    """J10, A1-A6, W10, W11."""
    s = star(spark, sf_dir)
    return _rounded(analytics.agent_performance(s["fact"], s["agent"], s["suburb"], s["date"]))


@_register(_with(_TO_FACT, """, seq AS (SELECT *, lag(event_date) OVER w AS d0, lag(sale_price) OVER w AS p0 FROM fact WHERE is_sold AND sale_price IS NOT NULL
  WINDOW w AS (PARTITION BY property_key ORDER BY event_date, sale_price))
SELECT seq.property_key, street_address, suburb_name, region_name, d0 AS previous_sale_date, p0 AS previous_sale_price, event_date AS sale_date, sale_price, date_diff('day', d0, event_date) AS days_held,
  round(sale_price - p0, 6) AS gain_amount, round(sale_price / nullif(p0, 0) - 1, 6) AS gain_pct, round(power(sale_price / nullif(p0, 0), 365.0 / nullif(date_diff('day', d0, event_date), 0)) - 1, 6) AS annualised_return
FROM seq JOIN dim_property p ON seq.property_key = p.property_key JOIN dim_suburb s ON seq.suburb_key = s.suburb_key WHERE d0 IS NOT NULL AND date_diff('day', d0, event_date) > 21""").replace("\n, seq", ", seq"))
def repeat_sales(spark, sf_dir):
    """W7, P13, P15, J11."""
    s = star(spark, sf_dir)
    return _rounded(analytics.repeat_sales(s["fact"], s["property"], s["suburb"]))


@_register(_with(_TO_FACT, """, bids AS (SELECT property_key, suburb_key, event_date AS bid_date, bid_amount FROM fact WHERE NOT is_sold AND bid_amount IS NOT NULL),
sales AS (SELECT property_key, event_date AS sale_date, sale_price FROM fact WHERE is_sold AND sale_price IS NOT NULL),
paired AS (SELECT b.property_key, suburb_key, bid_date, bid_amount, min(sale_date) AS first_at FROM bids b JOIN sales s ON b.property_key = s.property_key AND sale_date > bid_date GROUP BY 1, 2, 3, 4)
SELECT paired.property_key, street_address, suburb_name, region_name, bid_date, bid_amount, first_at AS eventual_sale_date, sale_price AS eventual_sale_price, round(sale_price - bid_amount, 6) AS gap_amount,
  round(sale_price / nullif(bid_amount, 0) - 1, 6) AS gap_pct, date_diff('day', bid_date, first_at) AS days_to_sale
FROM paired JOIN sales ON paired.property_key = sales.property_key AND first_at = sale_date JOIN dim_property p ON paired.property_key = p.property_key JOIN dim_suburb s ON paired.suburb_key = s.suburb_key""").replace("\n, bids", ", bids"))
def vendor_expectation_gap(spark, sf_dir):
    """C14: J12, J13, A9, J11."""
    s = star(spark, sf_dir)
    return _rounded(analytics.vendor_expectation_gap(s["fact"], s["property"], s["suburb"]))


# ---------------------------------------------------------------- data quality


@_register("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def dq_not_null(spark, sf_dir):
    """Q1, on prices withheld by rule."""
    o = _table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return quality.nulls(o, "price").select("o_orderkey")


@_register("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_unique(spark, sf_dir):
    """Q2."""
    return quality.repeated(_table(spark, sf_dir, "lineitem"), "l_orderkey")


@_register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_combination(spark, sf_dir):
    """Q3."""
    return quality.repeated(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_register("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_custkey % 10 <> 3)")
def dq_relationships(spark, sf_dir):
    """Orders of customers that are missing as parents, as some customers' keys are blank."""
    parent = _table(spark, sf_dir, "customer").withColumn("c_custkey", F.when(F.col("c_custkey") % 10 != 3, F.col("c_custkey")))
    return quality.orphans(_table(spark, sf_dir, "orders"), "o_custkey", parent, "c_custkey").select("o_orderkey")


@_register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def dq_accepted_values(spark, sf_dir):
    """Q5."""
    return quality.unaccepted(_table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@_register("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE NOT (l_discount <= 0.05)")
def dq_expression(spark, sf_dir):
    """Q6."""
    return quality.untrue(_table(spark, sf_dir, "lineitem"), "l_discount <= 0.05").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@_register(_with(_TO_FACT, "SELECT (SELECT count(*) FROM staged) AS staged_rows, (SELECT count(*) FROM fact) - 1 AS fact_rows, (SELECT count(*) FROM quarantine) AS quarantined_rows"))
def dq_ledger(spark, sf_dir):
    """One fact row is taken away, so that the ledger is open and shows its counts."""
    c = settle(classified(spark, sf_dir), "classified")
    g = facts.fact_listing_outcome(duplicates.deduped(c))
    first = g.agg(F.min("source_row").alias("__least"))
    return quality.ledger(staged(spark, sf_dir), g.join(F.broadcast(first), F.col("source_row") == F.col("__least"), "left_anti"), duplicates.quarantine(c))


@_register("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def dq_functional_dependency(spark, sf_dir):
    """Q8, A10."""
    return quality.undetermined(_table(spark, sf_dir, "customer"), "c_nationkey", ["c_mktsegment"])


@_register("SELECT s_suppkey, s_nationkey FROM supplier JOIN (SELECT c_custkey, c_nationkey FROM customer) ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey")
def dq_agreement(spark, sf_dir):
    """Q9: two tables' own copies of an attribute."""
    theirs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    return quality.disagreeing(_table(spark, sf_dir, "supplier"), theirs, "s_suppkey", "s_nationkey").select("s_suppkey", "s_nationkey")


@_register("SELECT o_orderpriority AS business_signature, count(DISTINCT o_custkey || chr(1) || o_orderstatus) AS entities FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey || chr(1) || o_orderstatus) > 1")
def dq_group_spans(spark, sf_dir):
    """Q10, P17."""
    rows = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "business_signature")
    return quality.spanning(rows, ["o_custkey", "o_orderstatus"])


@_register(_with(_TO_CLASSIFIED, "SELECT business_signature, recapture_cluster, min(event_date) AS first_date, max(event_date) AS last_date, date_diff('day', min(event_date), max(event_date)) AS span_days FROM classified WHERE recapture_cluster IS NOT NULL GROUP BY 1, 2 HAVING date_diff('day', min(event_date), max(event_date)) > 5"))
def dq_overlong_chains(spark, sf_dir):
    """Q11, with a lookback short enough to find some."""
    return quality.overlong(classified(spark, sf_dir), 5)


_DIFFERENCE = """SELECT o_orderstatus, o_custkey, price, sum(s)::bigint AS surplus FROM (
  SELECT o_orderstatus, o_custkey, round(o_totalprice + (o_orderkey % 11 = 0)::int, 6) AS price, 1 AS s FROM orders
  UNION ALL SELECT o_orderstatus, o_custkey, round(o_totalprice + (o_orderkey % 13 = 0)::int, 6), -1 FROM orders) GROUP BY 1, 2, 3 HAVING sum(s) <> 0"""


def _two_builds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o, changed = _table(spark, sf_dir, "orders"), lambda n: F.col("o_totalprice") + F.when(F.col("o_orderkey") % n == 0, 1.0).otherwise(0.0)
    build = lambda n: o.select("o_orderstatus", "o_custkey", changed(n).alias("price"), F.lit("x").alias("load_id"))
    return build(11), build(13)


@_register(_DIFFERENCE)
def dq_table_difference(spark, sf_dir):
    """Q13, O1: rows that two builds don't have equally often."""
    return quality.difference(*_two_builds(spark, sf_dir))


@_register(_DIFFERENCE)
def dq_difference_by_digest(spark, sf_dir):
    """Q13, O1: the same by sums of hashes, so that only rows of buckets that differ are shuffled."""
    return quality.difference_by_digest(*_two_builds(spark, sf_dir))


@_register("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1, 2")
def hot_group_medians(spark, sf_dir):
    """A4 where a group has a large share of all rows: counts of values over pieces of their order."""
    li, keys = _table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]
    return pieces.exact_median(li, keys, "l_extendedprice", "median_price").join(pieces.exact_median(li, keys, "l_quantity", "median_quantity"), keys)


@_register("""WITH r AS (SELECT o_custkey AS load_id, count(*) AS rows_read, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS rows_loaded, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0) AS rows_rejected FROM orders GROUP BY 1)
SELECT load_id, concat_ws(',', CASE WHEN rows_read <> rows_loaded + rows_rejected THEN 'ledger' END, CASE WHEN rows_read > 0 AND rows_rejected > rows_read * 0.01 THEN 'reject rate' END,
  CASE WHEN rows_loaded < 5 OR rows_loaded > 12 THEN 'volume' END) AS problems FROM r""")
def dq_receipt_gate(spark, sf_dir):
    """Q12, over a table of receipts."""
    k = F.col("o_orderkey")
    r = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("load_id")).agg(
        F.count("*").alias("rows_read"), F.count_if(k % 7 != 0).alias("rows_loaded"), F.count_if((k % 7 == 0) & (k % 3 != 0)).alias("rows_rejected"))
    return gate.evaluate_receipts(r, Config(min_rows_loaded=5, max_rows_loaded=12)).select("load_id", F.array_join("problems", ",").alias("problems"))


# ---------------------------------------------------------------- incremental


@_register(_with(_TO_STAGED, f"SELECT DISTINCT {_PROPERTY} AS property_key FROM staged WHERE load_id IN ('load2')"))
def affected_properties(spark, sf_dir):
    """N1-N4, A12."""
    return incremental.affected_keys(staged(spark, sf_dir), ["load2"])


@_register(_with(_TO_CLASSIFIED, "SELECT dq_status, load_id, count(*) AS n, sum(recapture_rank)::bigint AS ranks FROM classified GROUP BY 1, 2"))
def scoped_overwrite(spark, sf_dir):
    """Classify without one load, then replace what that load touches; equal to a full build."""
    rows = measured(spark, sf_dir)
    before = duplicates.classify_duplicates(rows.filter("load_id != 'load2'"))
    scope = incremental.affected(rows, ["load2"])
    after = incremental.rebuild(rows, duplicates.classify_duplicates, before, scope)
    return after.groupBy("dq_status", "load_id").agg(F.count("*").alias("n"), F.sum("recapture_rank").alias("ranks"))


_SNAPSHOTS = """previous AS (SELECT o_custkey, o_orderstatus, round(o_totalprice + (o_orderkey % 11 = 0)::int, 2) AS price FROM orders WHERE o_orderkey % 17 <> 0
  UNION ALL SELECT o_custkey, o_orderstatus, round(o_totalprice + (o_orderkey % 11 = 0)::int, 2) FROM orders WHERE o_orderkey % 19 = 0),
current AS (SELECT o_custkey, o_orderstatus, round(o_totalprice + (o_orderkey % 13 = 0)::int, 2) AS price FROM orders WHERE o_orderkey % 23 <> 0),
counts AS (SELECT o_custkey, o_orderstatus, price, sum(b)::bigint AS b, sum(n)::bigint AS n FROM (SELECT *, 1 AS b, 0 AS n FROM previous UNION ALL SELECT *, 0, 1 FROM current) GROUP BY ALL)"""


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as two full snapshots: some rows only in one, some with another price, some twice."""
    k, o = F.col("o_orderkey"), _table(spark, sf_dir, "orders")
    rows = lambda df, n: df.select("o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") + F.when(k % n == 0, 1.0).otherwise(0.0), 2).alias("price"))
    return rows(o.filter(k % 17 != 0), 11).unionByName(rows(o.filter(k % 19 == 0), 11)), rows(o.filter(k % 23 != 0), 13)


@_register(f"""WITH {_SNAPSHOTS}, sums AS (SELECT o_custkey, sum(least(b, n))::bigint AS same, sum(greatest(b - n, 0))::bigint AS lost, sum(greatest(n - b, 0))::bigint AS gained FROM counts GROUP BY 1)
SELECT o_custkey, same, least(lost, gained) AS changed, gained - least(lost, gained) AS new, lost - least(lost, gained) AS vanished FROM sums""")
def snapshot_changes(spark, sf_dir):
    """What changed per customer between two full snapshots, by row digests in one exchange."""
    return snapshots.snapshot_changes(*_snapshots(spark, sf_dir), ["o_custkey"])


@_register(f"WITH {_SNAPSHOTS} SELECT o_custkey, o_orderstatus, price FROM counts, range(4) r(i) WHERE i < n - b")
def snapshot_delta(spark, sf_dir):
    """The rows that a full snapshot has more of than the last one: its delivery."""
    return snapshots.delta_rows(*_snapshots(spark, sf_dir))


_CHANCE = "('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0"
_BEYOND = " + ".join(f"(moved >= floor(span * ({i} + {_CHANCE.format(repr(f'7:cut {i}'))} - 0.5) / 6))::int" for i in range(1, 6))


@_register(f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate::date AS day, min(o_orderdate::date) OVER () AS a, date_diff('day', min(o_orderdate::date) OVER (), max(o_orderdate::date) OVER ()) + 1 AS span FROM orders),
first AS (SELECT *, {_BEYOND} AS delivery FROM (SELECT *, date_diff('day', a, day) + floor({_CHANCE.format("'7:' || o_orderkey")} * 43) - 21 AS moved FROM o)),
sent AS (SELECT day, o_totalprice, delivery, 'first' AS kind FROM first UNION ALL SELECT day, o_totalprice, 6, 'resent' FROM first WHERE delivery = floor({_CHANCE.format("'7:again 0'")} * 6)
  UNION ALL SELECT day, o_totalprice + 1, 7, 'corrected' FROM first WHERE o_orderstatus = 'P' AND {_CHANCE.format("'8:' || o_orderkey")} < 0.5)
SELECT delivery::int AS delivery, kind, count(*) AS n, min(day) AS first_day, max(day) AS last_day, round(sum(o_totalprice), 2) AS price FROM sent GROUP BY 1, 2""")
def delivery_split(spark, sf_dir):
    """O2: a history as six deliveries cut at seeded days, one sent again, some rows corrected late; those sent first are the whole."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("event_date"))
    sent = deliveries.delivery_sequence(rows, 6, 7, row=["o_orderkey"], corrections={"o_totalprice": F.col("o_totalprice") + 1}, correctable=F.col("o_orderstatus") == "P", corrected_share=0.5)
    return sent.groupBy("delivery", "kind").agg(F.count("*").alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"), F.round(F.sum("o_totalprice"), 2).alias("price"))


# ---------------------------------------------------------------- typed reading of text

_TEXTS = """texts AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN event_id::varchar WHEN 2 THEN '99999999999' || event_id WHEN 3 THEN '1_' || event_id WHEN 4 THEN event_id || '.5' WHEN 5 THEN 'nan'
  WHEN 6 THEN '1e400' WHEN 7 THEN '+' || event_id ELSE '-' || event_id || 'e-2' END AS t, CASE event_id % 7 WHEN 0 THEN '31/31/2017' WHEN 1 THEN '1/04/2087' WHEN 2 THEN '001/04/2017' WHEN 3 THEN '9/9/1887' WHEN 4 THEN '' ELSE
  (1 + event_id % 28) || '/' || (1 + event_id % 12) || '/2017' END AS d, CASE event_id % 3 WHEN 0 THEN '0' || (100 + event_id % 900) WHEN 1 THEN (event_id % 30)::varchar ELSE '3067 ' END AS p FROM events)"""


@_register(f"""WITH {_TEXTS} SELECT event_id,
  CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN try_cast(ltrim(t, '+') AS int) END AS i,
  CASE WHEN t = '' THEN NULL WHEN NOT regexp_matches(t, '^[+-]?[0-9]+$') THEN 'rooms_not_integer' WHEN try_cast(ltrim(t, '+') AS int) IS NULL THEN 'rooms_out_of_range' END AS i_reason,
  CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AND t <> '1e400' THEN try_cast(t AS double) END AS x,
  CASE WHEN t = '' THEN NULL WHEN t IN ('nan', '1e400') THEN 'price_not_finite' WHEN NOT regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'price_not_numeric' END AS x_reason,
  CASE WHEN regexp_matches(d, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN try_strptime(d, '%d/%m/%Y')::date END AS day,
  CASE WHEN NOT regexp_matches(d, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') OR try_strptime(d, '%d/%m/%Y') IS NULL THEN 'date_not_parseable' WHEN try_strptime(d, '%d/%m/%Y') > DATE '2018-10-13' THEN 'date_in_future'
    WHEN try_strptime(d, '%d/%m/%Y') < DATE '1900-01-01' THEN 'date_implausible' END AS day_reason,
  CASE WHEN NOT regexp_matches(p, '^[0-9]{{3,4}}$') THEN 'postcode_invalid' END AS p_reason FROM texts""")
def typed_fields(spark, sf_dir):
    """Values and reasons of text fields."""
    k = F.col("event_id")
    s = k.cast("string")
    t = (
        F.when(k % 9 == 0, "").when(k % 9 == 1, s).when(k % 9 == 2, F.concat(F.lit("99999999999"), s)).when(k % 9 == 3, F.concat(F.lit("1_"), s)).when(k % 9 == 4, F.concat(s, F.lit(".5")))
        .when(k % 9 == 5, "nan").when(k % 9 == 6, "1e400").when(k % 9 == 7, F.concat(F.lit("+"), s)).otherwise(F.concat(F.lit("-"), s, F.lit("e-2")))
    )
    d = F.when(k % 7 == 0, "31/31/2017").when(k % 7 == 1, "1/04/2087").when(k % 7 == 2, "001/04/2017").when(k % 7 == 3, "9/9/1887").when(k % 7 == 4, "").otherwise(F.concat((k % 28 + 1).cast("string"), F.lit("/"), (k % 12 + 1).cast("string"), F.lit("/2017")))
    p = F.when(k % 3 == 0, F.concat(F.lit("0"), (k % 900 + 100).cast("string"))).when(k % 3 == 1, (k % 30).cast("string")).otherwise("3067 ")
    e = _table(spark, sf_dir, "events").select("event_id", t.alias("t"), d.alias("d"), p.alias("p"))
    (i, ir), (x, xr) = coercion.to_int(F.col("t"), "rooms"), coercion.to_double(F.col("t"), "price")
    (day, dr), (_, pr) = coercion.to_date(F.col("d"), "date", dt.date(2018, 10, 13)), coercion.to_postcode(F.col("p"), "postcode")
    return e.select("event_id", i.alias("i"), ir.alias("i_reason"), F.when(xr.isNull(), x).alias("x"), xr.alias("x_reason"), day.alias("day"), dr.alias("day_reason"), pr.alias("p_reason"))


# ---------------------------------------------------------------- the feed


def _feed_fields():
    """An order as the 13 fields of the feed, spoilt by rules of its key."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    fields = F.array(
        F.concat(F.lit("Suburb "), k % 9), F.concat(F.lit('Lot "'), s, F.lit('", A St')), F.when(k % 17 == 0, "two").otherwise((k % 5).cast("string")), F.lit("h"),
        F.when(k % 13 == 0, "1_000").when(k % 5 == 0, "").otherwise((k * 10).cast("string")), F.lit("S"), F.concat(F.lit(" Agent "), k % 4), F.when(k % 19 == 0, "31/02/2017").otherwise(F.concat((k % 28 + 1).cast("string"), F.lit("/6/2017"))),
        F.when(k % 23 == 0, "30 67").otherwise("0800"), F.lit("East"), F.when(k % 29 == 0, "99999999999").otherwise("12"), F.when(k % 31 == 0, "inf").otherwise("2.5"), F.lit("Hill\nCouncil"),
    )
    return F.when(k % 11 == 0, F.slice(fields, 1, 12)).when(k % 37 == 0, F.array().cast("array<string>")).otherwise(fields)


_FEED_SQL = """SELECT outcome, count(*) AS n, sum(CASE WHEN outcome = 'loaded' AND k % 5 > 0 THEN k * 10 END)::double AS prices
FROM (SELECT o_orderkey AS k, CASE WHEN k % 11 = 0 THEN 'wrong_field_count' WHEN k % 37 = 0 THEN 'blank' WHEN k % 17 = 0 THEN 'rooms_not_integer' WHEN k % 13 = 0 THEN 'price_not_numeric' WHEN k % 19 = 0 THEN 'date_not_parseable'
    WHEN k % 23 = 0 THEN 'postcode_invalid' WHEN k % 29 = 0 THEN 'propertycount_out_of_range' WHEN k % 31 = 0 THEN 'distance_not_finite' ELSE 'loaded' END AS outcome FROM orders) GROUP BY 1"""


def _outcomes(typed: DataFrame) -> DataFrame:
    return typed.groupBy(F.when(F.col("blank"), "blank").otherwise(F.coalesce("reason", F.lit("loaded"))).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.when(~F.col("blank") & F.col("reason").isNull(), F.col("price"))).alias("prices"))


@_register(_FEED_SQL)
def feed_outcomes(spark, sf_dir):
    """What becomes of each record."""
    records = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("record"), _feed_fields().alias("fields"))
    return _outcomes(csv_feed.type_fields(records, "load", dt.date(2018, 10, 13)))


@_register(_FEED_SQL)
def feed_from_file(spark, sf_dir):
    """The same records written as CSV in many files, with line ends and quotes in fields, and read back in their order by many tasks."""
    folder = shared_folder(spark, "feed")
    lines = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.size(_feed_fields()) > 0, csv_feed.quote_line(_feed_fields())).otherwise("").alias("value"))
    head = spark.range(1).select((F.col("id") - 1).alias("k"), F.lit(",".join(csv_feed.HEADER)).alias("value"))
    head.unionByName(lines).orderBy("k").select("value").write.text(folder)
    texts = csv_feed.read_records(spark, folder)
    csv_feed.check_header(csv_feed.split_fields(texts.filter("record = 0")).first()["fields"])
    records = csv_feed.split_fields(texts)
    return _outcomes(csv_feed.type_fields(records, "load", dt.date(2018, 10, 13)))


assert (SEPARATOR, NULL) == (chr(1), chr(2) + "null" + chr(2))  # as _key_sql has them
