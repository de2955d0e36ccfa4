"""A history cut into deliveries as a feed would send them, and the proof that they add up to it (O2).

Cuts fall at seeded days; rows near a cut go to either side, so chains and restatements straddle it.  Some deliveries
come again, and some rows come later a second time with corrected values.

``replay`` sends a landing's rows through scoped builds, one delivery after another, builds the same landing at once
beside it, and names the tables that differ.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..operators.quality import difference_by_digest
from ..sources.csv_feed import READER_VERSION, read_landing
from ..sources.store import Store
from .versions import Warehouse


def chance(seed: int, *of: Column | str) -> Column:
    """A number from 0 to 1 that the seed and the values decide."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)


def delivery_sequence(rows: DataFrame, n: int, seed: int, *, date: str = "event_date", row: Sequence[str] = ("load_id", "source_row"), straddle_days: int = 21, resent: int = 1,
                      corrections: Mapping[str, Column] | None = None, correctable: Column | None = None, corrected_share: float = 0.01) -> DataFrame:
    """``rows`` with ``delivery`` (from 0) and ``kind``: each row ``first`` once, in one of ``n`` deliveries by date.

    ``resent`` deliveries after these repeat one of them; in a last one, a share of the ``correctable`` rows come as
    ``corrected``.  Rows without a date come in the first delivery.
    """
    ends = rows.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    span = (ends["b"] - ends["a"]).days + 1 if ends["a"] is not None else 1
    moved = F.datediff(F.col(date), F.lit(ends["a"]).cast("date")) + F.floor(chance(seed, *row) * (2 * straddle_days + 1)) - straddle_days
    cut = lambda i: F.floor(F.lit(span) * (i + chance(seed, F.lit(f"cut {i}")) - 0.5) / F.lit(n))
    delivery = sum((F.when(moved >= cut(i), 1).otherwise(0) for i in range(1, n)), F.lit(0))
    first = rows.select("*", F.coalesce(delivery, F.lit(0)).cast("int").alias("delivery"), F.lit("first").alias("kind"))
    out = first
    for k in range(resent):
        chosen = F.floor(chance(seed, F.lit(f"again {k}")) * n).cast("int")
        out = out.unionByName(first.filter(F.col("delivery") == chosen).withColumns({"delivery": F.lit(n + k), "kind": F.lit("resent")}))
    if corrections:
        late = first.filter((correctable if correctable is not None else F.lit(True)) & (chance(seed + 1, *row) < corrected_share))
        out = out.unionByName(late.withColumns({**corrections, "delivery": F.lit(n + resent), "kind": F.lit("corrected")}))
    return out


def replay(spark: SparkSession, landing_root: str, work: str, *, n: int = 5, seed: int = 1, config: Config = DEFAULTS, check: bool = True) -> list[str]:
    """Names of the tables in which builds after each of ``n`` deliveries (one sent again, then late prices) differ from one full build."""
    from .pipeline import MATERIALISATION, build

    rows = read_landing(spark, landing_root)
    sequence = delivery_sequence(
        rows, n, seed, date="date", row=("_load_id", "_source_row"), corrections={"price": F.lit(1_234_567.0), "_source_row": F.col("_source_row") + (1 << 20)}, correctable=F.col("price").isNull(),
    )
    store, landing, house = Store(spark, work), f"{work}/landing_root", f"{work}/scoped"
    sent, load_id = f"{work}/sent", ""
    sequence.write.partitionBy("delivery").parquet(sent)
    for folder in sorted(store.names("sent"), key=lambda f: int(f.rpartition("=")[2]) if "=" in f else -1):
        if "=" not in folder:
            continue
        given = spark.read.schema(sequence.drop("delivery").schema).parquet(f"{sent}/{folder}")
        if not given.filter("kind != 'resent'").isEmpty():  # what comes again is known by its bytes: it lands nothing
            load_id = f"{seed:06d}d{int(folder.rpartition('=')[2]):05d}"
            given.drop("kind").withColumn("_load_id", F.lit(load_id)).write.parquet(f"{landing}/landing/listing_outcome/load_id={load_id}")
            began = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=int(folder.rpartition("=")[2]))
            store.write_text(f"landing_root/ingest_receipt/{load_id}.json", json.dumps({"load_id": load_id, "loader_version": READER_VERSION, "started_at": began.strftime("%Y-%m-%dT%H:%M:%SZ")}))
        build(spark, landing, house, [load_id], config, check)
    build(spark, landing, f"{work}/full", None, config, check)
    ours, whole = Warehouse(spark, house), Warehouse(spark, f"{work}/full")
    return [name for name in MATERIALISATION if not difference_by_digest(ours.table(name), whole.table(name)).isEmpty()]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, config: Config = DEFAULTS) -> int:
    """``python -m ledgerloom.plans.deliveries LANDING WORK [SEED]``: 0 if the deliveries add up, 1 if tables differ, 2 if called wrongly."""
    given = list(sys.argv[1:] if argv is None else argv)
    if len(given) not in (2, 3) or not given[2:3] in ([], [x for x in given[2:3] if x.isdigit()]):
        print(main.__doc__, file=sys.stderr)
        return 2
    unlike = replay(spark or SparkSession.builder.getOrCreate(), given[0], given[1], seed=int(given[2]) if given[2:] else 1, config=config)
    print(f"differ: {', '.join(unlike)}" if unlike else "the deliveries add up to the whole")
    return int(bool(unlike))


if __name__ == "__main__":
    raise SystemExit(main())
