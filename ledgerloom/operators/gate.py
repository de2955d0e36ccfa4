"""The receipt gate (Q12): is a load healthy enough to go on?"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config


def evaluate_receipt(receipt: Mapping, config: Config = DEFAULTS) -> list[str]:
    """All problems of one receipt; a missing count raises KeyError, for a gate must not pass on absence."""
    read, loaded, rejected = (receipt[k] for k in ("rows_read", "rows_loaded", "rows_rejected"))
    found = []
    if read != loaded + rejected:
        found.append(f"the row ledger is open: {read:,} read, but {loaded:,} loaded and {rejected:,} rejected")
    if read and rejected > config.max_reject_rate * read:
        found.append(f"reject rate {rejected / read:.2%} is over {config.max_reject_rate:.2%}, by reason: {dict(receipt.get('reject_reasons') or {})}")
    if loaded < config.min_rows_loaded or loaded > config.max_rows_loaded:
        found.append(f"{loaded:,} rows loaded is outside the expected {config.min_rows_loaded:,} to {config.max_rows_loaded:,}")
    return found


def evaluate_receipts(receipts: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """The same over a table of receipts: ``load_id`` and ``problems`` (codes), for every load."""
    read, loaded, rejected = (F.col(c) for c in ("rows_read", "rows_loaded", "rows_rejected"))
    codes = [
        F.when(read != loaded + rejected, "ledger"), F.when((read > 0) & (rejected > read * config.max_reject_rate), "reject rate"),
        F.when((loaded < config.min_rows_loaded) | (loaded > config.max_rows_loaded), "volume"),
    ]
    return receipts.select("load_id", F.array_compact(F.array(*codes)).alias("problems"))
