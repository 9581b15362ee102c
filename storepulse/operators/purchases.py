"""Purchases from parsed event messages (FLT-3, PRJ-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import buy_detail_price, buy_detail_product, is_buy_detail


def message_purchases(parsed: DataFrame) -> DataFrame:
    """details 'BUY-<product>-<price>.' -> user, store, product, price FLOAT and time (with the
    message's id where there is one); other messages are no purchases."""
    details = F.col("details")
    known = [c for c in ("id",) if c in parsed.columns]
    return parsed.where(is_buy_detail(details)).select(
        *known, "user_id", "store_id", buy_detail_product(details).alias("product_id"),
        buy_detail_price(details).alias("price"), "datetime")
