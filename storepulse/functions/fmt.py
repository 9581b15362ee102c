"""Text formatting used by report lines (FN-14, FN-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(x: Column) -> Column:
    """Text with two decimals, half-up on the value taken to 6 decimals.

    Going through DECIMAL makes the text independent of how an engine prints a
    double (Java's '%.2f' and C's printf disagree on values such as x.xx5).
    """
    return F.round(x.cast("decimal(20,6)"), 2).cast("decimal(20,2)").cast("string")


def money(x: Column) -> Column:
    """Two-decimal amount, or 'N/A' when the value is null (Q26)."""
    return F.when(x.isNull(), F.lit("N/A")).otherwise(two_decimals(x))


def ts_text(ts: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
