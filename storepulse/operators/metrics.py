"""The six store metrics (AGG-1..AGG-5, AGG-7) with per-store and ``All`` rows.

Plan shape, chosen for scale:
* ``All`` rows come from grouping sets, so a metric is one aggregation with one
  exchange instead of an aggregation, a re-aggregation and a union.
* Views are pre-aggregated to (window, store, product[, user]) before the
  product join, so the join sees one row per key instead of one per event, and
  a hot product or store is already combined map-side before any shuffle. The
  plan has one shape at every size: the planner's byte threshold and AQE decide
  whether the product side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _store_or_all(flag: str = "_g") -> Column:
    return F.when(F.col(flag) == 1, F.lit(ALL)).otherwise(F.col("store_id")).alias("store_id")


def _product_attrs(products: DataFrame, *cols: str) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), "store_id", *cols)


def purchases_per_minute(buys: DataFrame, duration: str = "1 minute") -> DataFrame:
    """AGG-1: bought units per (window, store) plus ``All`` per window."""
    return units_per_window(buys.select(F.window("datetime", duration).alias("window"), "store_id"), F.count(F.lit(1)))


def units_per_window(rows: DataFrame, units: Column) -> DataFrame:
    """The end of AGG-1, from events or from counts kept of them."""
    agg = (rows.groupingSets([["window", "store_id"], ["window"]], "window", "store_id")
             .agg(units.alias("count"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), _store_or_all(), "count")


def _with_product(events: DataFrame, products: DataFrame, duration: str, *cols: str) -> DataFrame:
    """(window, store_id, product_id, n, *cols): per-product counts with the
    product attributes, left join (unmatched events keep null attributes)."""
    per_product = (events.groupBy(F.window("datetime", duration).alias("window"), "store_id", "product_id")
                         .agg(F.count(F.lit(1)).alias("n")))
    return with_attributes(per_product, products, *cols)


def with_attributes(per_product: DataFrame, products: DataFrame, *cols: str) -> DataFrame:
    return per_product.join(_product_attrs(products, *cols), ["product_id", "store_id"], "left")


def revenue_per_minute(views: DataFrame, products: DataFrame, duration: str = "1 minute") -> DataFrame:
    """AGG-2 (reference form, Q4/Q5): sum of int(price) of the *viewed* products.

    Views without a product match contribute null; the amount is null when no
    view of the group matched.
    """
    return viewed_price(_with_product(views, products, duration, "price"))


def viewed_price(j: DataFrame) -> DataFrame:
    """The end of AGG-2, from counts per product with their price."""
    agg = (j.groupingSets([["window", "store_id"], ["window"]], "window", "store_id")
             .agg(F.sum(F.col("n") * F.col("price").cast("int")).alias("amount_earned"),
                  F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), _store_or_all(), "amount_earned")


def revenue_from_buys(buys: DataFrame, products: DataFrame, duration: str = "1 minute") -> DataFrame:
    """Intent form of AGG-2: revenue of the bought units at their decimal price."""
    j = _with_product(buys, products, duration, "price")
    agg = (j.groupingSets([["window", "store_id"], ["window"]], "window", "store_id")
             .agg(F.sum(F.col("n") * F.col("price")).alias("amount"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), _store_or_all(), F.col("amount").cast("double").alias("amount_earned"))


def _viewer_names(views: DataFrame, products: DataFrame, duration: str) -> DataFrame:
    """(window, name, store, user) of every view: products sharing a name
    merge (Q7); unmatched views form the null-name group."""
    rows = views.select(F.window("datetime", duration).alias("window"), "store_id", "product_id", "user_id").distinct()
    j = rows.join(_product_attrs(products, "name"), ["product_id", "store_id"], "left")
    return j.select("window", "name", "store_id", "user_id")


def unique_users_per_minute(views: DataFrame, products: DataFrame, duration: str = "1 minute") -> DataFrame:
    """AGG-3 (reference form, Q6): distinct viewers per (window, name, store);
    ``All`` is the sum of the store values, i.e. distinct (store, user) pairs."""
    return unique_users_from_sets(viewer_sets(views, products, duration), dedupe=False)


def viewer_sets(views: DataFrame, products: DataFrame, duration: str = "1 minute") -> DataFrame:
    """The user-level state of AGG-3: distinct (window, name, store, user)."""
    return _viewer_names(views, products, duration).distinct()


def unique_users_from_sets(sets: DataFrame, dedupe: bool = True) -> DataFrame:
    """AGG-3 from (merged) viewer sets; merging partial results of a distinct
    count needs these sets, a sum of partial counts would count a user seen in
    both parts twice (Q3). ``dedupe=False`` when the sets are already unique
    (the output of an aggregation, e.g. in a stream)."""
    vn = sets.distinct() if dedupe else sets
    agg = (vn.groupingSets([["window", "name", "store_id"], ["window", "name"]], "window", "name", "store_id")
             .agg(F.count(F.lit(1)).alias("unique_users"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), "name", _store_or_all(), "unique_users")


def unique_users_distinct_all(views: DataFrame, products: DataFrame, duration: str = "1 minute") -> DataFrame:
    """AGG-3, second reading: ``All`` counts each user once across stores."""
    vn = _viewer_names(views, products, duration)
    agg = (vn.groupingSets([["window", "name", "store_id"], ["window", "name"]], "window", "name", "store_id")
             .agg(F.count_distinct("user_id").alias("unique_users"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), "name", _store_or_all(), "unique_users")


def view_ranking_per_hour(views: DataFrame, products: DataFrame, duration: str = "1 hour") -> DataFrame:
    """AGG-4: views per (window, name, store) plus ``All`` per (window, name)."""
    return views_per_name(_with_product(views, products, duration, "name"))


def views_per_name(j: DataFrame) -> DataFrame:
    """The end of AGG-4, from counts per product with their name."""
    agg = (j.groupingSets([["window", "name", "store_id"], ["window", "name"]], "window", "name", "store_id")
             .agg(F.sum("n").alias("views"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"),
                      F.col("window.end").alias("window_end"), "name", _store_or_all(), "views")


BUY_KEYS = ("user_id", "product_id", "store_id")


def any_null(*keys: str) -> Column:
    """Whether a key is null: such a row joins nothing."""
    out = F.col(keys[0]).isNull()
    for k in keys[1:]:
        out = out | F.col(k).isNull()
    return out


def views_per_buy(views: DataFrame, buys: DataFrame) -> DataFrame:
    """Per (user, product, store) that bought: number of views (all time, Q9) and
    bought units. One scan of each side, one shuffle, no join: the left join
    buys -> view counts with null -> 0 (JN-2) becomes a tagged aggregation. A null
    key groups with null but joins with nothing, so its buys have no views."""
    tagged = (views.select(*BUY_KEYS, F.lit(1).alias("v"), F.lit(0).alias("b"))
              .unionByName(buys.select(*BUY_KEYS, F.lit(0).alias("v"), F.lit(1).alias("b"))))
    per_key = tagged.groupBy(*BUY_KEYS).agg(
        F.sum("v").cast("long").alias("views"), F.sum("b").cast("long").alias("buys"))
    return (per_key.filter(F.col("buys") > 0)
                   .withColumn("views", F.when(any_null(*BUY_KEYS), F.lit(0).cast("long")).otherwise(F.col("views"))))


def views_before_buy(views: DataFrame, buys: DataFrame) -> DataFrame:
    """AGG-5: histogram of buys by the buyer's view count, per store and ``All``."""
    return views_histogram(views_per_buy(views, buys))


def views_histogram(per_buy: DataFrame) -> DataFrame:
    agg = (per_buy.groupingSets([["views", "store_id"], ["views"]], "views", "store_id")
                  .agg(F.sum("buys").alias("count"), F.grouping("store_id").alias("_g")))
    return agg.select("views", _store_or_all(), "count")


def sold_without_stock(stock: DataFrame) -> DataFrame:
    """AGG-7: negative-stock rows per store, plus an ``All`` row that exists
    (null) even when no row is negative (Q11). The global aggregate runs over the
    per-store result (one row per store)."""
    per_store = (negative_stock(stock).groupBy("store_id")
                      .agg(F.count(F.lit(1)).alias("products_sold_without_stock")))
    all_row = per_store.agg(F.sum("products_sold_without_stock").alias("products_sold_without_stock")) \
                       .select(F.lit(ALL).alias("store_id"), "products_sold_without_stock")
    return per_store.unionByName(all_row)


def in_stock(stock: DataFrame) -> DataFrame:
    """FLT-8: products with stock > 0."""
    return stock.filter(F.col("quantity") > 0).select("product_id", "store_id", "quantity")


def negative_stock(stock: DataFrame) -> DataFrame:
    """FLT-2: quantity < 0."""
    return stock.filter(F.col("quantity") < 0).select("product_id", "store_id", "quantity")


def views_strictly_before_buy(views: DataFrame, buys: DataFrame, bucket: str = "hour") -> DataFrame:
    """AGG-5, intent reading of Q9: for each bought unit, the views of the same
    (user, product, store) strictly earlier than the buy; histogram per store
    and ``All``. The running count is split by time bucket so a hot key is
    spread over many tasks (see ``sequence.count_before``)."""
    from .sequence import count_before
    cols = ["user_id", "product_id", "store_id", "datetime"]
    # at equal timestamps the buy sorts first, so a simultaneous view is not "before"
    tagged = (views.select(*cols, F.lit(1).alias("is_view"), F.lit(1).alias("_tie"))
              .unionByName(buys.select(*cols, F.lit(0).alias("is_view"), F.lit(0).alias("_tie")))
              .withColumn("_bucket", F.date_trunc(bucket, "datetime")))
    counted = count_before(tagged, ["user_id", "product_id", "store_id"], ["datetime", "_tie"],
                           "is_view", "_bucket", out="views")
    views_ = F.when(any_null(*BUY_KEYS), F.lit(0).cast("long")).otherwise(F.col("views"))
    per_buy = counted.filter(F.col("is_view") == 0).select("store_id", views_.alias("views"), F.lit(1).alias("buys"))
    return views_histogram(per_buy)
