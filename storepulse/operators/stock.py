"""Stock maintenance (JN-5, AGG-13, AGG-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["product_id", "store_id"]


def order_rollup(buys: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """AGG-13 / Q30: the order table back from per-unit audit rows, one row per
    checkout and product. A checkout writes its rows at once; rows of one user and
    product less than ``gap`` apart belong to one order. Rows without time are in none."""
    session = F.session_window("datetime", gap)
    return (buys.groupBy("user_id", "product_id", "store_id", session.alias("w")).agg(F.count(F.lit(1)).alias("quantity"))
                .select("user_id", "product_id", "store_id", F.col("w.start").alias("ordered_at"), "quantity"))


def sales_per_product(buys: DataFrame) -> DataFrame:
    """AGG-14: units sold per (product, store)."""
    return buys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("sold"))


def stock_after_sales(stock: DataFrame, buys: DataFrame) -> DataFrame:
    """JN-5: stock minus the units sold; rows without sales keep their quantity.
    Both sides are aggregated on the join key, so the join reuses that
    partitioning."""
    j = stock.join(sales_per_product(buys), KEYS, "left")
    return j.select(*KEYS, (F.col("quantity") - F.coalesce(F.col("sold"), F.lit(0))).alias("quantity"))


def unmatched_sales(stock: DataFrame, buys: DataFrame) -> DataFrame:
    """Q29: sales of products that have no stock row (they update nothing)."""
    return sales_per_product(buys).join(stock.select(*KEYS), KEYS, "left_anti")
