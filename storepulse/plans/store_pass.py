"""One pass of the six store metrics (the reference's poll-and-publish loop).

Four of the six tasks publish only each store's newest window, so the pass reads
the events twice and no more: a first narrow aggregation gives the all-time
histogram of views before a purchase and, with it, the newest event of each store; the
second scan keeps the events of each store's newest hour, the only ones the
windowed tasks need. Both results are small (distinct view counts per store; one
hour) and are checkpointed in the folder the cluster shares
(``spark.checkpoint.dir``), so every task reads them and a lost executor
recomputes from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import view_product_id
from ..functions.timewin import shift, tumble_start
from ..operators import latest, metrics
from ..operators.events import BUY_SELECTOR, VIEW_SELECTOR
from ..operators.payload import MAX_DETAILS, TASK_DETAILS, store_payloads
from ..session import shared_dir

LONGEST = "1 hour"  # the widest window of the timed tasks
HISTOGRAM = "median_views_before_buy"


def tagged_events(events: DataFrame) -> DataFrame:
    """Store events -> (kind, store_id, product_id, user_id, datetime) for views and buys."""
    kind = (F.when(F.col("event_type") == "view", F.lit("view"))
             .when(F.col("event_type") == "purchase", F.lit("buy")))
    return events.filter(F.col("event_type").isin("view", "purchase")).select(
        kind.alias("kind"), "store_id", "product_id", "user_id", F.col("ts").alias("datetime"))


def tagged_log_events(log: DataFrame) -> DataFrame:
    """Log rows -> (kind, store_id, product_id, user_id, datetime): both
    selectors (Audit/BUY, User/ZOOM) in one scan."""
    def chosen(selector):
        return (F.col("type") == selector[1]) & (F.col("extra_1") == selector[2])
    buy = chosen(BUY_SELECTOR)
    kind = F.when(buy, F.lit(BUY_SELECTOR[0])).otherwise(F.lit(VIEW_SELECTOR[0]))
    product = F.when(buy, F.col("extra_2")).otherwise(view_product_id(F.col("extra_2")))
    return log.filter(buy | chosen(VIEW_SELECTOR)).select(
        kind.alias("kind"), "store_id", product.alias("product_id"), F.col("content").alias("user_id"), "datetime")


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)  # make sure a checkpoint folder is set
    return df.checkpoint(eager=True)


def summary(tagged: DataFrame) -> DataFrame:
    """(views, store_id) -> bought units, newest view and newest buy: first scan."""
    is_view = F.col("kind") == "view"
    per_key = tagged.groupBy(*metrics.BUY_KEYS).agg(
        F.count_if(is_view).alias("views"), F.count_if(~is_view).alias("buys"),
        F.max(F.when(is_view, F.col("datetime"))).alias("last_view"),
        F.max(F.when(~is_view, F.col("datetime"))).alias("last_buy"))
    views = F.when(metrics.any_null(*metrics.BUY_KEYS), F.lit(0).cast("long")).otherwise(F.col("views"))
    return (per_key.groupBy(views.alias("views"), "store_id")
            .agg(F.sum("buys").alias("buys"), F.max("last_view").alias("last_view"), F.max("last_buy").alias("last_buy")))


def newest_hours(tagged: DataFrame, small: DataFrame) -> DataFrame:
    """The events in the newest hour of their kind and store: second scan.

    Every store's newest window is whole in it, and so is the newest window over all
    stores, which starts no earlier than that of any store with events in it."""
    kinds = F.explode(F.array(F.struct(F.lit("view").alias("k"), F.col("last_view").alias("t")),
                              F.struct(F.lit("buy").alias("k"), F.col("last_buy").alias("t"))))
    last = (small.select(F.col("store_id").alias("s"), kinds.alias("x")).groupBy("s", F.col("x.k").alias("k"))
            .agg(F.max("x.t").alias("t")).where("t is not null"))
    start = last.select("s", "k", tumble_start(last, "t", LONGEST).alias("since"))
    same = F.col("store_id").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k"))
    return tagged.join(start, same & (F.col("datetime") >= F.col("since"))).drop("s", "k", "since")


def cells(recent: DataFrame, products: DataFrame) -> DataFrame:
    """(kind, minute, hour, store_id, product_id, user_id, n, name, price): the recent events counted once, with their
    product's attributes from one join; every windowed task is a sum over these rows."""
    minute = F.window("datetime", "1 minute").alias("minute")
    counted = recent.groupBy("kind", minute, "store_id", "product_id", "user_id").agg(F.count(F.lit(1)).alias("n"))
    flat = counted.select("*", F.col("minute.start").alias("_start"))
    start = tumble_start(flat, "_start", LONGEST)
    hour = F.struct(start.alias("start"), shift(start, LONGEST).alias("end"))
    return metrics.with_attributes(flat.withColumn("hour", hour).drop("_start"), products, "name", "price")


def task_results(tagged: DataFrame, products: DataFrame, stock: DataFrame, store: str | None = None) -> dict[str, DataFrame]:
    """The six published task results, from tagged events; see the module. With ``store`` (FLT-10) only that
    store's events, products and stock are read."""
    if store is not None:
        tagged, products, stock = (df.where(F.col("store_id") == store) for df in (tagged, products, stock))
    small = _checkpointed(summary(tagged))
    counted = _checkpointed(cells(newest_hours(tagged, small), products))
    views = counted.where("kind = 'view'").withColumnRenamed("minute", "window")
    buys = counted.where("kind = 'buy'").withColumnRenamed("minute", "window")
    hours = counted.where("kind = 'view'").withColumnRenamed("hour", "window")
    return {
        "purchases_per_minute": latest.last_window(metrics.units_per_window(buys, F.sum("n"))),
        "revenue_per_minute": latest.last_window(metrics.viewed_price(views)),
        "unique_users_per_minute": latest.last_window(
            metrics.unique_users_from_sets(views.select("window", "name", "store_id", "user_id"))),
        "ranking_viewed_products_per_hour": latest.last_window(metrics.views_per_name(hours)),
        HISTOGRAM: metrics.views_histogram(small.filter(F.col("buys") > 0)),
        "without_stock": metrics.sold_without_stock(stock),
    }


def task_order(task: str):
    if task in ("unique_users_per_minute", "ranking_viewed_products_per_hour"):
        metric = "unique_users" if task == "unique_users_per_minute" else "views"
        return [F.col(metric).desc_nulls_last(), F.col("name").asc_nulls_first()]
    if task == HISTOGRAM:
        return [F.col("views").asc()]
    if task == "without_stock":
        return [F.col("store_id").asc()]
    return [F.col("window_start").asc()]


def payloads(results: dict[str, DataFrame], n: int = MAX_DETAILS) -> DataFrame:
    """One message body per (task, store): the first ``n`` details of each ranked
    task, and the whole histogram, whose reader takes a median of it."""
    parts = [store_payloads(df, task, TASK_DETAILS[task], task_order(task), n=None if task == HISTOGRAM else n)
             for task, df in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_pass(events: DataFrame, products: DataFrame, stock: DataFrame, out_path: str) -> str:
    """SNK-4/SNK-5: compute and write one pass's messages, one folder per task
    (``task_name=<task>``, one JSON line per store), replacing the previous pass."""
    out = payloads(task_results(tagged_events(events), products, stock))
    out.write.mode("overwrite").partitionBy("task_name").json(out_path)
    return out_path
