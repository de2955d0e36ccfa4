"""What the training-data operators share: table access, shared scratch space, text bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import settle, shared_folder  # noqa: F401
from ..sources.store import Store

#: The six ASCII blanks; a word is a maximal run of anything else.  ``bytes.split()`` splits on exactly these.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes are moved up from 256 in order.
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*settled: DataFrame) -> None:
    """Delete the folders of tables that ``settle`` wrote, when nothing that is still to run reads them."""
    for df in settled:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            Store(df.sparkSession, folder).delete("")


def text_bytes(column: str | Column = "text") -> Column:
    """The text as UTF-8 bytes, null as empty; so no Python worker decodes what it only counts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id belongs to no fold (null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds)


class Memo:
    """Remembers results by key in two generations, so that it is bounded and frequent keys stay.

    ``young.get`` is what a hot loop asks first; ``of`` looks further, computes what isn't known, and moves
    what it finds to the young generation.
    """

    def __init__(self, compute, size: int = 1 << 17, longest: int = 64):
        self.compute, self.size, self.longest = compute, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def of(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.compute(key)
            if len(key) <= self.longest:
                if len(self.young) >= self.size:
                    self.old, self.young = self.young, {}
                self.young[key] = found
        return found


def as_bytes(value: bytes | memoryview | None) -> bytes:
    return b"" if value is None else bytes(value)
