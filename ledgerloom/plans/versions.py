"""Tables that change in place without a table format (N5): versions and one pointer.

A table's data are in ``<name>/v=<n>-<run>``; a small file says which version of every table is live, or which
versions together, if a run added to a table instead of replacing it.  A table in parts (Spark's partitioned writes)
has a version for each part, so a run writes the parts that it touches; the folders of the others stay as they are,
and which parts there are is known from the pointer, without reading any of them.  A run
writes new versions beside the old ones and then puts a new pointer file, with the next number, in place by a
rename that fails if that number is taken; the highest number is live.  So all its tables change together, readers
never see half a run, a run that dies leaves the old state, and of two runs from one state only one succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.store import Store

POINTER = "_live-"


#: The live folders of a table: one, all that were added, or ``{"schema": ..., "parts": {part: version}}``.
#: Names that begin with ``_`` are no tables but what runs note.
Entry = str | list[str] | dict
PART = "part"


def folders(of: Entry, only: Iterable | None = None) -> list[str]:
    """The folders of a pointer's entry; of a table in parts those of ``only``, if given."""
    if isinstance(of, dict):
        wanted = None if only is None else {str(p) for p in only}
        return [f"v={v}/{PART}={p}" for p, v in of["parts"].items() if wanted is None or p in wanted]
    return [f"v={v}" for v in ([of] if isinstance(of, str) else of)]


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def pointer(self) -> int:
        """The number of the live pointer, 0 without one."""
        return max((int(n.removeprefix(POINTER).removesuffix(".json")) for n in self.store.names() if n.startswith(POINTER)), default=0)

    def live(self, number: int | None = None) -> dict[str, Entry]:
        number = self.pointer() if number is None else number
        return json.loads(self.store.read_text(f"{POINTER}{number:08d}.json")) if number else {}

    def has(self, name: str) -> bool:
        return name in self.live()

    def parts(self, name: str) -> list[str] | None:
        """The parts of a table, None if it isn't there or isn't in parts; only the pointer is read."""
        of = self.live().get(name)
        return list(of["parts"]) if isinstance(of, dict) else None

    def table(self, name: str, only: Iterable | None = None) -> DataFrame:
        return self.read(name, self.live()[name], only)

    def read(self, name: str, of: Entry, only: Iterable | None = None) -> DataFrame:
        at = [self.store.at(f"{name}/{folder}") for folder in folders(of, only)]
        if not isinstance(of, dict):
            return self.spark.read.parquet(*at)
        schema = StructType.fromJson(of["schema"])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def begin(self) -> Run:
        return Run(self)

    def drop_old(self, keep: int = 0) -> None:
        """Remove what neither the live pointer nor the ``keep`` before it name, and older pointers."""
        pointers = sorted(n for n in self.store.names() if n.startswith(POINTER))
        for name in pointers[: -1 - keep]:
            self.store.delete(name)
        kept: dict[str, set[str]] = {}
        for pointer in pointers[-1 - keep :]:
            for name, of in json.loads(self.store.read_text(pointer)).items():
                if not name.startswith("_"):
                    kept.setdefault(name, set()).update(folders(of))
        for name in self.store.names():
            if name.startswith("_"):
                continue
            live = kept.get(name, set())
            for found in self.store.names(name):
                if not any(f.partition("/")[0] == found for f in live):
                    self.store.delete(f"{name}/{found}")
                elif found not in live:  # a version of some parts
                    for part in self.store.names(f"{name}/{found}"):
                        if part.startswith(f"{PART}=") and f"{found}/{part}" not in live:
                            self.store.delete(f"{name}/{found}/{part}")


class Run:
    """The versions that one run writes; nothing is live before ``commit``."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse, self.number = warehouse, warehouse.pointer()
        self.before = warehouse.live(self.number)
        self.name = uuid.uuid4().hex[:8]
        self.written: dict[str, Entry] = {}

    def _version(self, name: str) -> str:
        had = [f.partition("/")[0].removeprefix("v=") for f in folders(self.before.get(name, "0"))]
        return f"{max((int(v.partition('-')[0]) for v in had), default=0) + 1:06d}-{self.name}"

    def _put(self, name: str, df: DataFrame) -> str:
        version = self._version(name)
        df.write.parquet(self.warehouse.store.at(f"{name}/v={version}"))
        return version

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the table."""
        self.written[name] = self._put(name, df)
        return self.table(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add to the table; what it holds is neither read nor copied."""
        had = self.before.get(name, [])
        self.written[name] = [*([had] if isinstance(had, str) else had), self._put(name, df)]
        return self.table(name)

    def put_parts(self, name: str, df: DataFrame, by: Column, only: Iterable | None = None) -> DataFrame:
        """Replace the parts ``only`` of a table by the rows of ``df``, which are all in them; without ``only`` the table.

        A part without rows is gone after that.  A part's rows are spread over tasks by their size, so a large part
        isn't written by one task.
        """
        version, store = self._version(name), self.warehouse.store
        df.withColumn(PART, by.cast("string")).hint("rebalance", PART).write.partitionBy(PART).parquet(store.at(f"{name}/v={version}"))
        made = {f.removeprefix(f"{PART}="): version for f in store.names(f"{name}/v={version}") if f.startswith(f"{PART}=")}
        before = self.before.get(name)
        if only is not None and isinstance(before, dict):
            gone = {str(p) for p in only}
            if strange := made.keys() - gone:
                raise ValueError(f"{name}: rows in parts {sorted(strange)[:5]}, which are not replaced")
            made = {p: v for p, v in before["parts"].items() if p not in gone} | made
        self.written[name] = {"schema": df.schema.jsonValue(), "parts": made}
        return self.table(name)

    def drop_parts(self, name: str, gone: Iterable) -> None:
        before = self.before[name]
        gone = {str(p) for p in gone}
        self.written[name] = before | {"parts": {p: v for p, v in before["parts"].items() if p not in gone}}

    def table(self, name: str, only: Iterable | None = None) -> DataFrame:
        """This run's version, else the live one."""
        return self.warehouse.read(name, self.written[name] if name in self.written else self.before[name], only)

    def commit(self) -> Mapping[str, Entry]:
        store = self.warehouse.store
        made = f"_pointer-{uuid.uuid4().hex}.json"
        store.write_text(made, json.dumps(self.before | self.written, sort_keys=True))
        if not store.rename_new(made, f"{POINTER}{self.number + 1:08d}.json"):
            store.delete(made)
            raise RuntimeError("another run has committed meanwhile")
        return self.warehouse.live()
