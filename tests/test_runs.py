import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.operators import quality
from ledgerloom.plans.incremental import touched_parts
from ledgerloom.plans.pipeline import MATERIALISATION, QualityError, build, deliver, restage
from ledgerloom.plans.versions import Warehouse, folders
from ledgerloom.sources import csv_feed
from ledgerloom.streaming.staging_stream import stage_available

TODAY = dt.date(2018, 10, 13)
SMALL = Config(min_rows_loaded=1, property_parts=4)


def listings(n=400):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        day = dt.date(2017, 1, 1) + dt.timedelta(days=rng.randrange(300))
        suburb = rng.choice(["Croydon", "croydon", "Macleod", "Riverton"])
        at = {"croydon": 3136, "macleod": 3085, "riverton": 3067}[suburb.lower()]
        row = [suburb, f"{rng.randrange(40)} A St", 2, "h", rng.choice(["", 900000, 950000]), rng.choice(["S", "SN", "PI", "VB"]), rng.choice(["Ray", "RAY"]), day, at, "East", 10, 1.5, "M"]
        rows.append(row)
        for _ in range(rng.choice([0, 0, 1, 2])):  # republished, or stated again
            rows.append([*row[:4], rng.choice([row[4], 910000]), *row[5:7], day + dt.timedelta(days=rng.choice([0, 7, 14])), *row[8:]])
    return sorted(rows, key=lambda r: r[7])


def write(path, rows):
    lines = [",".join(csv_feed.HEADER)] + [",".join(f"{x.day}/{x.month}/{x.year}" if isinstance(x, dt.date) else str(x) for x in r) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_deliveries_equal_a_full_rebuild(spark, tmp_path):
    rows = listings()
    step = len(rows) // 3
    files = [write(tmp_path / f"d{i}.csv", rows[i * step : (i + 1) * step if i < 2 else None]) for i in range(3)]
    files.insert(2, files[1])  # one is sent again
    old = next(r for r in rows if r[4] == "")
    files.append(write(tmp_path / "late.csv", [[*old[:4], 1234567, *old[5:]]]))
    landing, house = str(tmp_path / "landing"), str(tmp_path / "house")
    told = []
    for f in files:
        deliver(spark, f, landing, house, today=TODAY, config=SMALL, retries=0, on_failure=lambda *x: told.append(x))
    build(spark, landing, str(tmp_path / "full"), None, SMALL)
    a, b = Warehouse(spark, house), Warehouse(spark, str(tmp_path / "full"))
    for name in MATERIALISATION:
        assert quality.difference(a.table(name), b.table(name)).isEmpty(), name
    assert {r[0] for r in a.table("int_listing_outcome_clustered").select("dq_status").distinct().collect()} == {"ok", "exact_duplicate", "suspected_restatement", "suspected_recapture"}
    assert not told and a.table("stg_listing_outcome").count() == len(rows) + 1
    a.drop_old()
    assert a.table("fact_listing_outcome").count() == b.table("fact_listing_outcome").count()


def test_a_failing_gate_tells_the_hook(spark, tmp_path):
    told = []

    def hook(phase, error):
        told.append((phase, str(error)))
        raise OSError("no network")

    with pytest.raises(QualityError, match="outside the expected"):
        deliver(spark, write(tmp_path / "a.csv", listings(5)), str(tmp_path / "l"), str(tmp_path / "w"), today=TODAY, on_failure=hook)
    assert told[0][0] == "gate"


def test_contract_errors_are_final(spark, tmp_path):
    (tmp_path / "a.csv").write_text("not,the,header\n")
    waits, told = [], []
    with pytest.raises(csv_feed.HeaderError):
        deliver(spark, str(tmp_path / "a.csv"), str(tmp_path / "l"), str(tmp_path / "w"), today=TODAY, wait=waits.append, on_failure=lambda *x: told.append(x[0]))
    assert waits == [] and told == ["ingest"]


def test_commands(spark, tmp_path, capsys):
    from ledgerloom.plans import pipeline

    landing, house = str(tmp_path / "l"), str(tmp_path / "w")
    assert pipeline.main(["deliver"], spark) == 2
    assert pipeline.main(["deliver", write(tmp_path / "a.csv", listings(5)), landing, house], spark, SMALL) == 0
    assert pipeline.main(["build", landing, str(tmp_path / "full")], spark, SMALL) == 0
    assert Warehouse(spark, house).table("fact_listing_outcome").count() == Warehouse(spark, str(tmp_path / "full")).table("fact_listing_outcome").count() > 0
    both = [Warehouse(spark, house).table(t).count() for t in ("int_listing_outcome_deduped", "quarantined_listing_outcome", "stg_listing_outcome")]
    assert both[0] + both[1] == both[2]
    assert pipeline.main(["deliver", write(tmp_path / "b.csv", listings(5)[:1]), landing, house], spark) == 1


def test_transient_failures_are_tried_again(spark, tmp_path, monkeypatch):
    from ledgerloom.plans import pipeline

    calls, waits = [], []

    def flaky(*a, **k):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return csv_feed.load_csv(*a, **k)

    monkeypatch.setattr(pipeline, "load_csv", flaky)
    deliver(spark, write(tmp_path / "a.csv", listings(5)), str(tmp_path / "l"), str(tmp_path / "w"), today=TODAY, config=SMALL, wait=waits.append)
    assert len(calls) == 3 and waits == [0, 1]


def test_nothing_is_live_before_commit(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path / "h"))
    run = home.begin()
    run.write("t", spark.range(3))
    assert home.live() == {}
    run.commit()
    other = home.begin()
    other.write("t", spark.range(9))
    assert home.table("t").count() == 3
    late = home.begin()
    other.commit()
    late.write("t", spark.range(1))
    with pytest.raises(RuntimeError):
        late.commit()
    assert home.table("t").count() == 9


def test_appending_leaves_what_is_there(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path / "h"))
    for n in (3, 0, 5):
        run = home.begin()
        assert run.append("log", spark.range(n)).count() == run.table("log").count()
        run.commit()
    folders = home.live()["log"]
    assert len(folders) == 3 and home.table("log").count() == 8
    home.drop_old()
    assert home.table("log").count() == 8 and set(home.store.names("log")) == {f"v={v}" for v in folders}
    run = home.begin()
    run.write("log", home.table("log").filter("id > 0"))
    run.commit()
    home.drop_old()
    assert home.table("log").count() == 6 and len(home.store.names("log")) == 1


def test_streamed_staging_takes_new_files_only(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("l", "s", "c"))
    csv_feed.load_csv(spark, write(tmp_path / "a.csv", listings(4)), landing, today=TODAY)
    stage_available(spark, landing, out, check)
    first = spark.read.parquet(out).count()
    stage_available(spark, landing, out, check)
    assert spark.read.parquet(out).count() == first
    csv_feed.load_csv(spark, write(tmp_path / "b.csv", listings(4)[:2]), landing, today=TODAY)
    stage_available(spark, landing, out, check)
    assert spark.read.parquet(out).count() == first + 2


def files_of(house, name):
    """Path and time of every data file that the table's live parts have."""
    found = {}
    for folder in folders(house.live()[name]):
        for f in (pathlib.Path(house.store.root) / name / folder).glob("*.parquet"):
            found[str(f)] = f.stat().st_mtime_ns
    return found


def test_a_delivery_leaves_the_files_of_untouched_parts(spark, tmp_path):
    rows, landing, house = listings(), str(tmp_path / "l"), Warehouse(spark, str(tmp_path / "h"))
    many = Config(min_rows_loaded=1, property_parts=14)
    deliver(spark, write(tmp_path / "a.csv", rows), landing, house.store.root, today=TODAY, config=many)
    tables = [t for t, how in MATERIALISATION.items() if how == "replace by property"]
    before, log = {t: files_of(house, t) for t in tables}, files_of(house, "stg_listing_outcome")
    deliver(spark, write(tmp_path / "b.csv", [[*rows[0][:4], 1234567, *rows[0][5:]]]), landing, house.store.root, today=TODAY, config=many)
    touched = touched_parts(house.table("stg_listing_outcome").filter("reported_price = 1234567"), 14)
    assert len(touched) == 1
    for t in tables:
        now = files_of(house, t)
        of_part = lambda files: {f: m for f, m in files.items() if f"part={touched[0]}/" in f}  # noqa: B023, E731
        kept = {f: m for f, m in before[t].items() if f not in of_part(before[t])}
        assert len(kept) > 10 and kept == {f: m for f, m in now.items() if f not in of_part(now)}, t
        assert not of_part(now).keys() & of_part(before[t]).keys()
    assert log.items() <= files_of(house, "stg_listing_outcome").items()
    build(spark, landing, str(tmp_path / "full"), None, many)
    full = Warehouse(spark, str(tmp_path / "full"))
    for t in MATERIALISATION:
        assert quality.difference(house.table(t), full.table(t)).isEmpty(), t


def test_new_loads_are_found_without_reading_the_log(spark, tmp_path):
    landing, house = str(tmp_path / "l"), Warehouse(spark, str(tmp_path / "h"))
    a = deliver(spark, write(tmp_path / "a.csv", listings(30)), landing, house.store.root, today=TODAY, config=SMALL).load_id
    assert house.parts("stg_listing_outcome") == [a] == csv_feed.landed_loads(spark, landing)
    b = csv_feed.load_csv(spark, write(tmp_path / "b.csv", listings(30)[:3]), landing, today=TODAY).load_id
    assert sorted(csv_feed.landed_loads(spark, landing)) == sorted([a, b])
    assert all(f"load_id={b}" in f for f in csv_feed.read_landing(spark, landing, [b]).inputFiles())  # the other load's files aren't in the plan
    assert all(f"part={a}/" in f for f in house.table("stg_listing_outcome", [a]).inputFiles())
    for n in (1, 2):  # nothing new the second time: no folder is made
        build(spark, landing, house.store.root, [b], SMALL)
        assert sorted(house.parts("stg_listing_outcome")) == sorted([a, b]) and len(house.store.names("stg_listing_outcome")) == 2
    restage(spark, house.store.root, b)
    assert house.parts("stg_listing_outcome") == [a]
    build(spark, landing, house.store.root, None, SMALL)
    assert sorted(house.parts("stg_listing_outcome")) == sorted([a, b])


def test_parts(spark, tmp_path):
    home = Warehouse(spark, str(tmp_path / "h"))
    rows = spark.range(100).selectExpr("id", "id % 5 AS p", "cast(null as string) AS nothing")
    run = home.begin()
    run.put_parts("t", rows, F.col("p"))
    run.commit()
    assert home.parts("t") == ["0", "1", "2", "3", "4"] and home.table("t").count() == 100 and home.table("t").columns == ["id", "p", "nothing"]
    run = home.begin()
    run.put_parts("t", rows.filter("p = 1 and id < 50"), F.col("p"), [1, 2])
    assert home.table("t").count() == 100 and run.table("t").count() == 70 and run.table("t", [1, 2]).count() == 10
    run.commit()
    assert home.parts("t") == ["0", "1", "3", "4"]
    home.drop_old(keep=1)
    assert home.read("t", home.live(1)["t"]).count() == 100
    home.drop_old()
    assert home.table("t").count() == 70 and sum(len(home.store.names(f"t/{v}")) for v in home.store.names("t")) <= 4 + 2  # parts and success marks
    run = home.begin()
    with pytest.raises(ValueError, match="not replaced"):
        run.put_parts("t", rows, F.col("p"), [1])
    run = home.begin()
    run.put_parts("t", rows.limit(0), F.col("p"))
    run.commit()
    assert home.parts("t") == [] and home.table("t").isEmpty() and home.table("t").schema == rows.schema


def test_another_number_of_parts_is_a_full_build(spark, tmp_path):
    landing, house = str(tmp_path / "l"), Warehouse(spark, str(tmp_path / "h"))
    for name, n, parts in (("a.csv", 40, 8), ("b.csv", 30, 3)):
        deliver(spark, write(tmp_path / name, listings(40)[:n]), landing, house.store.root, today=TODAY, config=Config(min_rows_loaded=1, property_parts=parts))
    assert set(house.parts("fact_listing_outcome")) <= {"0", "1", "2"} and house.table("stg_listing_outcome").count() > 40


def test_a_build_without_a_load_fails(spark, tmp_path, monkeypatch):
    """An ingest that names no load is an error, not a full rebuild."""
    from ledgerloom.plans import pipeline

    monkeypatch.setattr(pipeline, "load_csv", lambda *a, **k: csv_feed.LoadResult("", {}, "", "", ""))
    with pytest.raises(ValueError, match="no load"):
        deliver(spark, "a.csv", str(tmp_path / "l"), str(tmp_path / "w"), today=TODAY, retries=0)
