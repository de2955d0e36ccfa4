"""Reading a delivered CSV file under a contract.

A record of a CSV file may span lines, and whether a line begins inside a quoted field depends on all lines
before it.  To read one large file on many executors anyway:

1. each line says where it would end (inside quotes or not) for both ways it could begin; each input
   partition composes its lines and counts records for both ways; the driver chains these few summaries;
2. knowing how each partition begins, every line gets the number of its record.  Lines that are a record of
   their own, nearly all, are parsed where they are; only records of several lines are gathered, by number.

Record numbers count every record of the file, blank ones too.  Fields are then typed by column
expressions, the first failure in the contract's order is the row's reason, and nothing is dropped: each
record is landed, rejected with its line, or counted as blank.
"""

from __future__ import annotations

import argparse
import csv
import datetime as dt
import json
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coercion import to_date, to_double, to_int, to_postcode
from .scratch import settle
from .store import Store

READER_VERSION = "1"
# Fixed values of the contract: the header's names in order.
HEADER = (
    "Suburb", "Address", "Rooms", "Type", "Price", "Method", "SellerG", "Date", "Postcode", "Regionname", "Propertycount", "Distance", "CouncilArea",
)
LANDING_SCHEMA = (
    "suburb string, address string, rooms int, type string, price double, method string, sellerg string, date date, postcode string, "
    "regionname string, propertycount int, distance double, councilarea string, _load_id string, _source_row int"
)
REJECT_SCHEMA = "source_row int, reason string, raw_line string, _load_id string"
RECEIPT_SCHEMA = (
    "load_id string, loader_version string, source_path string, source_sha256 string, source_bytes bigint, header_contract string, "
    "rows_read bigint, rows_loaded bigint, rows_rejected bigint, rows_blank bigint, reject_reasons map<string,bigint>, event_date_min date, "
    "event_date_max date, landing_path string, rejects_path string, started_at timestamp, ended_at timestamp, duration_s double"
)
#: The longest record, as the csv module's own limit for a field has it; an open quote can't gather a whole file.
MAX_RECORD_CHARS = csv.field_size_limit() * len(HEADER)
# What Python's str.strip takes for blank.
_BLANK = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class FeedError(Exception):
    """The file can't be loaded."""


class HeaderError(FeedError):
    """The header isn't the contract's."""


def ends_quoted(line: str, begins_quoted: bool) -> bool:
    """Whether a line ends inside a quoted field.  Quotes count only at a field's start and inside quoted fields."""
    if '"' not in line:
        return begins_quoted
    quoted, at_start, i = begins_quoted, not begins_quoted, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    quoted = False
        elif c == '"' and at_start:
            quoted = True
        at_start = not quoted and c == ","
        i += 1
    return quoted


# A field after its first character, the rest of a quoted one, a closing quote with what may follow, and fields with their commas.
_QUOTED, _CLOSED = '(?:[^"]|"")*', '"(?:[^",][^,]*)?'
_OPEN = f'(?:(?:"{_QUOTED}{_CLOSED}|[^",][^,]*)?,)*"{_QUOTED}'
#: ``ends_quoted`` of whole lines, for both ways they could begin.
ENDS_QUOTED = (f"(?s)^{_OPEN}$", f"(?s)^{_QUOTED}(?:{_CLOSED},{_OPEN})?$")


def line_ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``ends_quoted`` of each line if it begins outside and if it begins inside quotes."""
    ends = (np.zeros(len(lines), bool), np.ones(len(lines), bool))
    some = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(some):
        there = lines.take(pa.array(some))
        for end, pattern in zip(ends, ENDS_QUOTED, strict=True):
            end[some] = pc.match_substring_regex(there, pattern).to_numpy(zero_copy_only=False)
    return ends


def run_on(ends: tuple[np.ndarray, np.ndarray], quoted: bool) -> tuple[np.ndarray, bool]:
    """Whether each of successive lines begins quoted, if the first begins as ``quoted`` says, and how the last ends.

    A line whose end doesn't depend on its begin settles the state, others keep or turn it: so the state is that of the last
    settling line, turned as often as lines have turned it since.
    """
    free, bound = ends
    n = len(free)
    if not n:
        return np.zeros(0, bool), quoted
    settles = free == bound
    turns = np.cumsum(free & ~bound)
    last = np.maximum.accumulate(np.where(settles, np.arange(n), -1))
    base = np.where(last >= 0, free[last], quoted)
    after = base ^ ((turns - np.where(last >= 0, turns[last], 0)) % 2 == 1)
    return np.concatenate(([quoted], after[:-1])), bool(after[-1])


def part_number(file: Column | str) -> Column:
    """The number in a part file's name, by which parts are ordered: as text, part 100000 would come before part 99999.  0 for other names."""
    name = F.substring_index(F.col(file) if isinstance(file, str) else file, "/", -1)
    return F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), F.lit(0))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of the files of a folder in the order of their numbers and names, with the split that each stands in."""
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_block_length")]
    valid = F.is_valid_utf8("value")
    return spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.when(valid, F.col("value")).otherwise("").alias("line"), valid.alias("valid"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch]]:
    """The rows of each split in turn; a task may read several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
        bounds = [0, *(np.flatnonzero(changes[0] | changes[1] | changes[2]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:], strict=False):
            yield tuple(batch.column(i)[begin].as_py() for i in range(3)), batch.slice(begin, end - begin)


def _chain(lines: DataFrame) -> tuple[dict[tuple[str, int, int], tuple[bool, int]], int, bool]:
    """How each split begins (inside quotes or not, how many records began before it), the records of all, and whether all is UTF-8."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for place, part in _splits(batches):
            states, counts, valid = found.setdefault(place, ([False, True], [0, 0], [True]))
            valid[0] &= bool(pc.all(part.column(5)).as_py())
            ends = line_ends(part.column(4))
            for k in (0, 1):
                begun, states[k] = run_on(ends, states[k])
                counts[k] += int((~begun).sum())
        names = ("file", "start", "length", "end0", "end1", "n0", "n1", "valid")
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*place, *states, *counts, *valid), strict=True)) for place, (states, counts, valid) in found.items()])

    # one row for each split
    rows = lines.mapInArrow(summary, "file string, start bigint, length bigint, end0 boolean, end1 boolean, n0 bigint, n1 bigint, valid boolean").orderBy(part_number("file"), "file", "start").collect()
    out, quoted, records = {}, False, 0
    for r in rows:
        out[r["file"], r["start"], r["length"]] = (quoted, records)
        quoted, records = (r["end1"], records + r["n1"]) if quoted else (r["end0"], records + r["n0"])
    return out, records, all(r["valid"] for r in rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (0 is the header) and ``text`` of each record of a CSV file; a broken line end in a quoted field becomes ``\\n``.

    Lines are numbered once, in the shared folder.  The second scan must find the splits of the first, which
    follow the cores at hand: a split is known by its place and length, and another one is an error, as is
    another number of records; so executors that come or go meanwhile lose no record.
    """
    begins, total, valid = _chain(_lines(spark, path))
    if not valid:
        raise FeedError(f"{path} is not UTF-8")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for place, part in _splits(batches):
            if place not in state:
                if place not in begins:
                    raise RuntimeError(f"the file is split otherwise than before, at {place}")
                state[place] = begins[place]
            quoted, record = state[place]
            begun, ended = run_on(line_ends(part.column(4)), quoted)
            ends = np.append(begun[1:], ended)
            records = record - 1 + np.cumsum(~begun)
            state[place] = ended, int(records[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.int64()), part.column(0), part.column(1), part.column(3), part.column(4), pa.array(~begun & ~ends), pa.array(~begun)], names=["record", "file", "start", "at", "line", "alone", "begins"])

    numbered = settle(_lines(spark, path).mapInArrow(number, "record bigint, file string, start bigint, at bigint, line string, alone boolean, begins boolean"), "feed-lines")
    there = numbered.agg(F.count_if("begins").alias("n"), F.max("record").alias("last")).first()
    if (there["n"], -1 if there["last"] is None else there["last"]) != (total, total - 1):
        raise RuntimeError(f"{total:,} records in the first scan of {path} and {there['n']:,} in the second")
    several = numbered.filter(~F.col("alone"))
    longest = several.groupBy("record").agg(F.sum(F.length("line") + 1).alias("chars")).agg(F.max("chars").alias("m")).first()["m"]
    if longest and longest > MAX_RECORD_CHARS:
        raise FeedError(f"a record of {longest:,} characters: a quote is never closed")
    joined = several.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part_number("file").alias("part"), "file", "start", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return numbered.filter("alone").select("record", F.col("line").alias("text")).unionByName(joined).withColumn("text", F.when(F.col("record") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")))


def split_fields(records: DataFrame) -> DataFrame:
    """Append ``fields`` as the csv module reads them."""

    @F.arrow_udf("array<string>")
    def fields(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([next(csv.reader(t.splitlines(keepends=True) if '"' in t else [t]), []) for t in batch.to_pylist()], pa.list_(pa.string()))

    return records.withColumn("fields", fields.asNondeterministic()("text"))


def check_header(fields: list[str] | None) -> None:
    if fields is None:
        raise HeaderError("the file is empty: it has no header")
    names = [f.strip() for f in fields]
    if tuple(names) == HEADER:
        return
    missing, extra = [c for c in HEADER if c not in names], [c for c in names if c not in HEADER]
    said = [f"missing {missing}"] * bool(missing) + [f"unexpected {extra}"] * bool(extra)
    raise HeaderError("header: " + ("; ".join(said) or f"wrong order: {names}"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def quote_line(fields: Column) -> Column:
    """The fields as one CSV line that reads back to them."""
    quoted = F.transform(fields, lambda f: F.when(f.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f))
    return F.when((F.size(fields) == 1) & (fields[0] == ""), '""').otherwise(F.array_join(quoted, ","))


def type_fields(records: DataFrame, load_id: str, today: dt.date) -> DataFrame:
    """Records after the header as landing columns with ``blank``, ``reason`` and ``raw_line``."""
    rows = records.filter("record > 0").withColumn("f", F.transform("fields", strip))
    text = {name.lower(): F.get("f", F.lit(i)) for i, name in enumerate(HEADER)}
    checks = {
        "rooms": to_int(text["rooms"], "rooms"), "price": to_double(text["price"], "price"), "date": to_date(text["date"], "date", today),
        "postcode": to_postcode(text["postcode"], "postcode"), "propertycount": to_int(text["propertycount"], "propertycount"), "distance": to_double(text["distance"], "distance"),
    }
    reason = F.when(F.size("f") != len(HEADER), "wrong_field_count").otherwise(F.coalesce(*[r for _, r in checks.values()]))
    blank = F.size("f") == 0
    values = [(checks[n][0] if n in checks else text[n]).alias(n) for n in map(str.lower, HEADER)]
    return rows.select(
        *values, F.lit(load_id).alias("_load_id"), F.col("record").cast("int").alias("_source_row"), blank.alias("blank"),
        F.when(~blank, reason).alias("reason"), F.when(~blank & reason.isNotNull(), quote_line(F.col("fields"))).alias("raw_line"),
    )


@dataclass(frozen=True)
class LoadResult:
    load_id: str
    receipt: dict
    landing_path: str
    rejects_path: str
    receipt_path: str


def _stamp(t: float) -> str:
    return dt.datetime.fromtimestamp(int(t), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def load_csv(spark: SparkSession, source: str, out_root: str, *, today: dt.date | None = None) -> LoadResult:
    """Load a file into landing, rejects and a receipt; the same bytes load once.

    The load is named by its bytes.  Everything is written beside the tables first, in a folder whose name
    begins with ``_``, and moved into place in order rejects, receipt, landing: a load is there if its
    landing is.
    """
    begun = time.time()
    today = today or dt.date.today()
    folder, _, name = source.rpartition("/")
    origin, store = Store(spark, folder or "."), Store(spark, out_root)
    sha = origin.sha256(name)
    load_id = sha[:12]
    landing, rejects, receipt_at = f"landing/listing_outcome/load_id={load_id}", f"rejects/load_id={load_id}", f"ingest_receipt/{load_id}.json"
    done = lambda receipt: LoadResult(load_id, receipt, store.at(landing), store.at(rejects), store.at(receipt_at))
    if store.exists(landing) and store.exists(rejects) and store.exists(receipt_at):
        try:
            known = json.loads(store.read_text(receipt_at))
        except (ValueError, OSError):
            known = {}
        if isinstance(known, dict) and known.get("source_sha256") == sha and known.get("loader_version") == READER_VERSION:
            return done(known)
    work = f"_inprogress/{load_id}-{uuid.uuid4().hex}"
    try:
        texts = read_records(spark, source)
        first = split_fields(texts.filter("record = 0")).select("fields").first()  # no filter passes a function of Python
        check_header(first["fields"] if first else None)
        records = split_fields(texts)
        type_fields(records, load_id, today).write.parquet(store.at(f"{work}/typed"))
        typed = spark.read.parquet(store.at(f"{work}/typed"))
        columns = [c.split()[0] for c in LANDING_SCHEMA.split(", ")]
        good = typed.filter("not blank and reason is null")
        good.select(*columns).write.parquet(store.at(f"{work}/landing"))
        bad = typed.filter("reason is not null")
        bad.select(F.col("_source_row").alias("source_row"), "reason", "raw_line", "_load_id").write.parquet(store.at(f"{work}/rejects"))
        count = typed.agg(F.count_if("blank").alias("blank"), F.count_if(~F.col("blank")).alias("read"), F.count_if(~F.col("blank") & F.col("reason").isNull()).alias("loaded"),
                          F.min(F.when(F.col("reason").isNull(), F.col("date"))).alias("a"), F.max(F.when(F.col("reason").isNull(), F.col("date"))).alias("b")).first()
        reasons = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().orderBy("reason").collect()}
        ended = time.time()
        receipt = {
            "load_id": load_id, "loader_version": READER_VERSION, "source_path": source, "source_sha256": sha, "source_bytes": origin.size(name), "header_contract": "ok",
            "rows_read": count["read"], "rows_loaded": count["loaded"], "rows_rejected": count["read"] - count["loaded"], "rows_blank": count["blank"], "reject_reasons": reasons,
            "event_date_min": count["a"] and count["a"].isoformat(), "event_date_max": count["b"] and count["b"].isoformat(),
            "landing_path": store.at(landing), "rejects_path": store.at(rejects), "started_at": _stamp(begun), "ended_at": _stamp(ended), "duration_s": round(ended - begun, 3),
        }
        store.write_text(f"{work}/receipt.json", json.dumps(receipt, indent=2) + "\n")
        for made, there in (("rejects", rejects), ("receipt.json", receipt_at), ("landing", landing)):
            store.rename(f"{work}/{made}", there)
    finally:
        store.delete(work)
    return done(receipt)


def landed_loads(spark: SparkSession, root: str) -> list[str]:
    """The loads in landing, by their folders' names; no data file is opened."""
    return [n.removeprefix("load_id=") for n in Store(spark, root).names("landing/listing_outcome") if n.startswith("load_id=")]


def read_landing(spark: SparkSession, root: str, loads: Sequence[str] | None = None) -> DataFrame:
    """All landed rows (I19), or those of the named loads, of which only the folders are read."""
    folder = f"{root}/landing/listing_outcome"
    if loads is not None:
        folders = [f"{folder}/load_id={x}" for x in loads]
    else:
        folders = [folder] if Store(spark, root).exists("landing/listing_outcome") else []
    if not folders:
        return spark.createDataFrame([], LANDING_SCHEMA)
    return spark.read.schema(LANDING_SCHEMA).parquet(*folders).select(*[c.split()[0] for c in LANDING_SCHEMA.split(", ")])


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    if not Store(spark, root).exists("rejects"):
        return spark.createDataFrame([], REJECT_SCHEMA)
    return spark.read.schema(REJECT_SCHEMA).parquet(f"{root}/rejects").select("source_row", "reason", "raw_line", "_load_id")


def read_receipts(spark: SparkSession, root: str) -> DataFrame:
    """All receipts (I20); each file is one indented JSON object."""
    if not Store(spark, root).exists("ingest_receipt"):
        return spark.createDataFrame([], RECEIPT_SCHEMA)
    return spark.read.schema(RECEIPT_SCHEMA).option("multiLine", True).json(f"{root}/ingest_receipt")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m ledgerloom.sources.csv_feed SOURCE OUT``: loads and prints the receipt; 1 if it can't, 2 if called wrongly."""
    parser = argparse.ArgumentParser(prog="ledgerloom.sources.csv_feed", exit_on_error=False, add_help=False)
    parser.add_argument("source")
    parser.add_argument("out")
    try:
        given, rest = parser.parse_known_args(sys.argv[1:] if argv is None else argv)
        if rest:
            raise argparse.ArgumentError(None, f"too many arguments: {rest}")
    except (argparse.ArgumentError, SystemExit):
        print(f"{main.__doc__}", file=sys.stderr)
        return 2
    try:
        result = load_csv(spark or SparkSession.builder.getOrCreate(), given.source, given.out)
    except FeedError as error:
        print(f"not loaded: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result.receipt, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
