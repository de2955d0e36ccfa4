"""The delivery run (C1-C14, N6-N10): ingest, build, gate.

Layers and how they change (``MATERIALISATION``, which ``build`` goes by): the staged log has a part for each load, so
which loads it has is known from folder names and a delivery adds its own part.  Everything that holds properties
is in parts by property: a scoped build reads and writes the parts that the delivery's properties are in, and no file
of another part is opened or changed.  Everything whose size is bounded by dimensions is rebuilt from the facts.
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions.keys import surrogate_key
from ..functions.scalars import name_key
from ..operators import analytics, dimensions, duplicates, facts, quality, staging
from ..operators.gate import evaluate_receipt
from ..sources import seeds
from ..sources.csv_feed import FeedError, LoadResult, landed_loads, load_csv, read_landing, read_receipts
from .contract import checks
from .incremental import is_scoped, part_of, touched_parts
from .versions import Entry, Warehouse

#: Layer policy (N7): how ``build`` changes each table when a delivery arrives.
APPEND, BY_PROPERTY, TABLE = "append", "replace by property", "table"
CHECKS_AT_ONCE = 8
#: What the pointer says of the number of parts by property.
PARTS = "_property_parts"
MATERIALISATION = {
    "stg_listing_outcome": APPEND, "int_listing_outcome": BY_PROPERTY, "int_listing_outcome_clustered": BY_PROPERTY,
    "int_listing_outcome_deduped": BY_PROPERTY, "quarantined_listing_outcome": BY_PROPERTY,
    "dim_suburb": TABLE, "dim_property": BY_PROPERTY, "dim_agent": TABLE, "dim_date": TABLE, "dim_sale_method": TABLE, "dim_property_type": TABLE,
    "fact_listing_outcome": BY_PROPERTY, "analytics_suburb_monthly_market": TABLE, "analytics_agent_performance": TABLE,
    "analytics_repeat_sales": TABLE, "analytics_vendor_expectation_gap": TABLE,
}


class QualityError(Exception):
    """A check found rows, or the gate found problems."""


def build(spark: SparkSession, landing_root: str, warehouse_root: str, load_ids: Sequence[str] | None = None, config: Config = DEFAULTS, check: bool = True) -> dict[str, Entry]:
    """Bring the warehouse up to what has landed.

    With ``load_ids`` only the parts that those loads, and any other load not yet staged, touch are derived again;
    without, or if the number of parts is another than when the warehouse was built, all are.
    """
    home = Warehouse(spark, warehouse_root)
    run = home.begin()
    methods, types = seeds.sale_methods(spark), seeds.property_types(spark)
    have = home.parts("stg_listing_outcome")
    new = [x for x in landed_loads(spark, landing_root) if have is None or x not in have]  # J2: names, no data
    scoped = is_scoped(home.live().get(PARTS) == config.property_parts, load_ids)
    loads = sorted({*(x for x in load_ids or [] if x in (have or [])), *new}) if scoped else None
    staged_new = staging.stage(read_landing(spark, landing_root, new), read_receipts(spark, landing_root))
    if new or have is None:
        run.put_parts("stg_listing_outcome", staged_new, F.col("load_id"), None if have is None else new)
    staged = run.table("stg_listing_outcome", loads)
    if check:
        _none("unknown sale methods", quality.orphans(staged, "method_code", methods, "method_code"))
        _none("repeated rows in staging", quality.repeated(staged, "load_id", "source_row"))
    touched = touched_parts(staged, config.property_parts) if scoped else None

    def put(name: str, rows: DataFrame, key: Column | None = None) -> DataFrame:
        """Write a table by its policy; what is given back is what this run wrote."""
        if MATERIALISATION[name] == BY_PROPERTY:
            run.put_parts(name, rows, part_of(config.property_parts, key), touched)
            return run.table(name, touched)
        return run.write(name, rows)

    measured = staging.derive_measures(run.table("stg_listing_outcome", new) if scoped else staged, methods)
    measured = put("int_listing_outcome", home.table("int_listing_outcome", touched).unionByName(measured) if scoped else measured)
    clustered = put("int_listing_outcome_clustered", duplicates.classify_duplicates(measured, window_days=config.recapture_window_days, hot_rows=config.hot_property_rows))
    good = put("int_listing_outcome_deduped", duplicates.deduped(clustered))
    put("quarantined_listing_outcome", duplicates.quarantine(clustered), surrogate_key(F.col("suburb_key"), name_key("street_address")))
    put("dim_property", dimensions.dim_property(good), F.col("property_key"))
    put("fact_listing_outcome", facts.fact_listing_outcome(good), F.col("property_key"))
    all_good, fact, properties = (run.table(name) for name in ("int_listing_outcome_deduped", "fact_listing_outcome", "dim_property"))
    suburbs, agents, dates = put("dim_suburb", dimensions.dim_suburb(all_good)), put("dim_agent", dimensions.dim_agent(all_good)), put("dim_date", dimensions.dim_date(all_good))
    put("dim_sale_method", dimensions.dim_sale_method(methods))
    put("dim_property_type", dimensions.dim_property_type(types))
    put("analytics_suburb_monthly_market", analytics.suburb_monthly_market(fact, dates, suburbs))
    put("analytics_agent_performance", analytics.agent_performance(fact, agents, suburbs, dates))
    put("analytics_repeat_sales", analytics.repeat_sales(fact, properties, suburbs, config.recapture_window_days))
    put("analytics_vendor_expectation_gap", analytics.vendor_expectation_gap(fact, properties, suburbs))
    if check:
        only = {APPEND: loads, BY_PROPERTY: touched}
        changed = lambda name: run.table(name, only.get(MATERIALISATION[name]))
        with ThreadPoolExecutor(CHECKS_AT_ONCE) as several:  # most are a small job each
            for done in [several.submit(_none, *check) for check in checks(run.table, config, changed).items()]:
                done.result()
    run.written[PARTS] = config.property_parts
    live = dict(run.commit())
    home.drop_old(keep=1)  # who reads the state before this one can finish
    return live


def _none(what: str, rows: DataFrame) -> None:
    if not rows.isEmpty():
        raise QualityError(f"{what}: {rows.limit(3).collect()}")


def deliver(spark: SparkSession, source: str, landing_root: str, warehouse_root: str, *, today: dt.date | None = None, config: Config = DEFAULTS,
            retries: int = 2, wait: Callable[[int], None] = lambda attempt: time.sleep(min(600, 60 * 2**attempt)), on_failure: Callable[[str, Exception], None] | None = None) -> LoadResult:
    """Ingest, scoped build, gate (N8-N10).  A phase is tried again after a growing wait; contract and quality errors are final.

    ``on_failure`` is told the phase and the error; what it raises itself is ignored.
    """

    def phase(name: str, work: Callable):
        for attempt in range(retries + 1):
            try:
                return work()
            except Exception as error:
                final = isinstance(error, (FeedError, QualityError, ValueError)) or attempt == retries
                if final:
                    if on_failure is not None:
                        try:
                            on_failure(name, error)
                        except Exception as ignored:  # noqa: BLE001
                            print(f"the failure hook failed: {ignored}")
                    raise
                wait(attempt)

    result = phase("ingest", lambda: load_csv(spark, source, landing_root, today=today))

    def scoped() -> dict[str, Entry]:
        if not result.load_id:
            raise ValueError("ingest named no load")
        return build(spark, landing_root, warehouse_root, [result.load_id], config)

    phase("build", scoped)

    def gate() -> None:
        problems = evaluate_receipt(result.receipt, config)
        if problems:
            raise QualityError("; ".join(problems))

    phase("gate", gate)
    return result


def restage(spark: SparkSession, warehouse_root: str, load_id: str) -> None:
    """Take a load out of the staged log, so that the next build stages it as it now stands in landing; follow with an unscoped build."""
    run = Warehouse(spark, warehouse_root).begin()
    run.drop_parts("stg_listing_outcome", [load_id])
    run.commit()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, config: Config = DEFAULTS) -> int:
    """``python -m ledgerloom.plans.pipeline build LANDING WAREHOUSE`` rebuilds all; ``deliver SOURCE LANDING WAREHOUSE`` takes one file in.

    1 if the run fails, 2 if called wrongly.
    """
    given = list(sys.argv[1:] if argv is None else argv)
    if (given[:1], len(given)) not in ((["build"], 3), (["deliver"], 4)):
        print(main.__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if given[0] == "build":
            build(spark, given[1], given[2], None, config)
        else:
            print(deliver(spark, *given[1:], config=config).load_id)
    except (FeedError, QualityError) as error:
        print(f"{given[0]} failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
