"""Time helpers: epoch conversions and tumbling-window bounds.

All helpers keep the timestamp flavour of their input: TIMESTAMP_NTZ stays NTZ
(no time-zone dependence in batch), TIMESTAMP stays TIMESTAMP (needed for
watermarks in streams).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

_UNITS_US = {
    "second": 1_000_000, "seconds": 1_000_000,
    "minute": 60_000_000, "minutes": 60_000_000,
    "hour": 3_600_000_000, "hours": 3_600_000_000,
    "day": 86_400_000_000, "days": 86_400_000_000,
}


def ntz_lit(t) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, built from its text so
    that neither the Python nor the session time zone can shift it."""
    return F.lit(t.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def duration_us(duration: str) -> int:
    """'10 minutes' -> microseconds."""
    n, unit = duration.split()
    return int(n) * _UNITS_US[unit.lower()]


def is_ntz(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.TimestampNTZType)


def epoch_us(ts: Column, ntz: bool) -> Column:
    """Microseconds since the epoch, exact (no double)."""
    if ntz:
        return F.timestamp_diff("MICROSECOND", epoch_ntz(), ts)
    return F.unix_micros(ts)


def from_epoch_us(us: Column, ntz: bool) -> Column:
    if ntz:
        return F.timestamp_add("MICROSECOND", us, epoch_ntz())
    return F.timestamp_micros(us)


def tumble_start(df: DataFrame, column: str, duration: str) -> Column:
    """Start of the epoch-aligned tumbling window holding ``column``.

    Same bounds as ``F.window(column, duration)``; usable several times in one
    projection (``F.window`` is limited to one per operator).
    """
    ntz = is_ntz(df, column)
    us = epoch_us(F.col(column), ntz)
    size = F.lit(duration_us(duration))
    return from_epoch_us(us - F.pmod(us, size), ntz)


def shift(ts: Column, duration: str) -> Column:
    """``ts`` plus a duration (keeps the timestamp flavour)."""
    return F.timestamp_add("MICROSECOND", F.lit(duration_us(duration)), ts)
