"""Settings of the warehouse; defaults are the figures of the published contract."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    recapture_window_days: int = 21
    incremental_lookback_days: int = 90
    max_reject_rate: float = 0.01
    min_rows_loaded: int = 50_000
    max_rows_loaded: int = 200_000
    #: Parts of the tables that hold properties; a delivery rewrites those that its properties are in, so choose many for a large history.
    property_parts: int = 64
    #: A property with more rows than this isn't classified in one task.
    hot_property_rows: int = 1_000_000


DEFAULTS = Config()
