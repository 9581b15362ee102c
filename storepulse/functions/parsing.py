"""Scalar parsing of log rows and event messages (FN-1..FN-4, FN-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timewin import epoch_ntz


def ns_text_to_timestamp(text: Column) -> Column:
    """FN-1: nanoseconds-since-epoch text -> TIMESTAMP_NTZ (UTC wall clock).

    Integer path (no division by 1e9 in double); bad text gives null instead of
    failing the job.
    """
    ns = text.try_cast("long").cast("decimal(20,0)")
    us = F.floor(ns / F.lit(1000)).cast("long")  # exact decimal division
    return F.timestamp_add("MICROSECOND", us, epoch_ntz())


def view_product_id(extra_2: Column) -> Column:
    """FN-2: 'VIEW_PRODUCT <id>.' -> '<id>'."""
    return F.regexp_replace(F.regexp_replace(extra_2, "VIEW_PRODUCT ", ""), r"\.$", "")


def buy_detail_product(details: Column) -> Column:
    """FN-3: 'BUY-<product>-<price>.' -> '<product>'."""
    return F.get(F.split(details, "-"), 1)


def buy_detail_price(details: Column) -> Column:
    """FN-3/FN-4: 'BUY-<product>-<price>.' -> price as FLOAT.

    The trailing newline and final '.' of the message (Q22) are removed before
    the cast; a short or non-numeric detail gives null, never an error.
    """
    raw = F.get(F.split(details, "-"), 2)
    return F.regexp_replace(raw, r"[\s.]+$", "").try_cast("float")


def is_buy_detail(details: Column) -> Column:
    """FN-6 / FLT-3: details LIKE 'BUY%'."""
    return details.startswith("BUY")
