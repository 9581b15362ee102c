"""Product catalogue maintenance: newest version per key (JN-9), price update
(JN-6, TOP-2, FN-12), change log (JN-7), snapshot (STR-9)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timewin import ntz_lit


def current_products(products: DataFrame) -> DataFrame:
    """JN-9 / Q28: newest row (largest id_product) per (id, store_id).

    ``max_by`` is an ordinary aggregate: it is combined map-side, so a key with
    very many versions is reduced before the shuffle.
    """
    newest = (products.groupBy("id", "store_id")
                      .agg(F.max_by(F.struct("id_product", "name", "price"), F.col("id_product")).alias("p")))
    return newest.select("p.id_product", "id", "store_id", "p.name", "p.price")


def _pick_hash(key: F.Column, seed: int) -> F.Column:
    # Deterministic stand-in for random(): md5 of "<key>:<seed>".
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def price_moves(products: DataFrame, n: int, seed: int) -> DataFrame:
    """TOP-2 / FN-12: (id_product, cents) of ``n`` products picked by a seeded hash order."""
    h = _pick_hash(F.col("id_product"), seed)
    return (products.select("id_product", h.alias("h")).orderBy("h").limit(n)
            .select("id_product",
                              # cents in [-10000, 100000] from the first 8 hex digits
                              (F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(110001))
                               - F.lit(10000)).alias("cents")))


def price_update(products: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """JN-6 / TOP-2 / FN-12: pick ``n`` products by a seeded hash order (the
    sample is the feature, so it is a top-n, planned as a per-partition top-n
    plus a merge), move each picked price by an amount in [-100.00, +1000.00] in
    cent steps, floor 1.00. Returns the whole table with new prices."""
    picked = price_moves(products, n, seed)
    j = products.join(picked, "id_product", "left")
    new_price = F.when(F.col("cents").isNull(), F.col("price")).otherwise(moved_price(F.col("price"), F.col("cents")))
    return j.select("id_product", "id", "store_id", "name", new_price.alias("price"))


def moved_price(price: F.Column, cents: F.Column) -> F.Column:
    """FN-12: greatest(1.00, price + cents/100) as DECIMAL(10,2)."""
    moved = (price + (cents / F.lit(100)).cast("decimal(10,2)")).cast("decimal(10,2)")
    return F.greatest(F.lit(1).cast("decimal(10,2)"), moved)


def price_changes(old: DataFrame, new: DataFrame, as_of: dt.datetime) -> DataFrame:
    """JN-7: one history row per product whose price really changed."""
    o = old.select("id_product", F.col("price").alias("old_price"))
    j = new.join(o, "id_product").filter(F.col("price") != F.col("old_price"))
    return j.select(F.col("id").alias("product_id"), "price", "store_id",
                    ntz_lit(as_of).alias("recorded_at"))


def price_snapshot(products: DataFrame, as_of: dt.datetime) -> DataFrame:
    """STR-9: every current price with one timestamp (business id, Q16)."""
    return products.select(F.col("id").alias("product_id"), "price", "store_id",
                           ntz_lit(as_of).alias("recorded_at"))
