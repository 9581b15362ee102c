"""Event selection and normalisation (FLT-1, SRC-3).

The metric operators consume two normalised frames, ``views`` and ``buys``,
with columns store_id, user_id, product_id, datetime. They come either from the
store log (``split_log``) or from the event table (``split_store_events``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import ns_text_to_timestamp, view_product_id

# The event selectors (name, type, extra_1).
BUY_SELECTOR = ("buy", "Audit", "BUY")
VIEW_SELECTOR = ("view", "User", "ZOOM")


def select_events(log: DataFrame, type_: str, action: str) -> DataFrame:
    """FLT-1: type == t AND extra_1 == a (pushed to the scan)."""
    return log.filter((F.col("type") == type_) & (F.col("extra_1") == action))


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """SRC-3: one filtered frame per selector, normalised columns. Each frame reads the log when it
    is used; ``plans.store_pass.tagged_log_events`` gives both kinds in one scan."""
    buys = select_events(log, *BUY_SELECTOR[1:]).select(
        "store_id", F.col("content").alias("user_id"), F.col("extra_2").alias("product_id"),
        ns_text_to_timestamp(F.col("timestamp")).alias("datetime"))
    views = select_events(log, *VIEW_SELECTOR[1:]).select(
        "store_id", F.col("content").alias("user_id"),
        view_product_id(F.col("extra_2")).alias("product_id"),
        ns_text_to_timestamp(F.col("timestamp")).alias("datetime"))
    return {"buy": buys, "view": views}


def split_store_events(events: DataFrame) -> dict[str, DataFrame]:
    """Same frames from the event table: purchase -> buy, view -> view."""
    cols = ["store_id", "user_id", "product_id", F.col("ts").alias("datetime")]
    return {
        "buy": events.filter(F.col("event_type") == "purchase").select(*cols),
        "view": events.filter(F.col("event_type") == "view").select(*cols),
    }
