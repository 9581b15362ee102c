"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bonus, deals, latest, median, metrics, prices, stock
from .inputs import (AS_OF, BONUS_MIN_LONG, BONUS_MIN_SHORT, DEAL_DISCOUNT, DEAL_MONTHS,
                     DEAL_REQUESTS, PRICE_UPDATE_N, PRICE_UPDATE_SEED, StoreInputs)

Query = Callable[[SparkSession, str], DataFrame]
# Windows of the merge queries: wide enough that both parts hold events of the same windows and users.
MERGE_WINDOW = "1 day"
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# ---- store metrics -------------------------------------------------------------------

@query
def purchases_per_minute(spark, sf_dir):
    return metrics.purchases_per_minute(StoreInputs(spark, sf_dir).buys)


@query
def revenue_per_minute(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.revenue_per_minute(i.views, i.products)


@query
def revenue_from_buys(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.revenue_from_buys(i.buys, i.products)


@query
def unique_users_per_minute(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.unique_users_per_minute(i.views, i.products)


@query
def unique_users_per_day(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.unique_users_per_minute(i.views, i.products, duration="1 day")


@query
def unique_users_distinct_all(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.unique_users_distinct_all(i.views, i.products, duration="1 day")


@query
def view_ranking_per_hour(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.view_ranking_per_hour(i.views, i.products)


@query
def views_before_buy(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.views_before_buy(i.views, i.buys)


@query
def sold_without_stock(spark, sf_dir):
    return metrics.sold_without_stock(StoreInputs(spark, sf_dir).stock)


@query
def in_stock(spark, sf_dir):
    return metrics.in_stock(StoreInputs(spark, sf_dir).stock)


@query
def median_views_ref(spark, sf_dir):
    return median.median_views_ref(views_before_buy(spark, sf_dir))


@query
def median_views(spark, sf_dir):
    return median.median_views(views_before_buy(spark, sf_dir))


@query
def last_window(spark, sf_dir):
    return latest.last_window(purchases_per_minute(spark, sf_dir))


@query
def older_windows(spark, sf_dir):
    return latest.older_windows(purchases_per_minute(spark, sf_dir))


@query
def top10_viewed(spark, sf_dir):
    """Ranking task as published: newest hour of each store, first 10 names."""
    last = latest.last_window(view_ranking_per_hour(spark, sf_dir))
    return latest.top_n(last, "views", 10).select("store_id", "rank", "name", "views", "window_start", "window_end")


def merge_parts(df):
    """Two parts of the events that share windows and users: even and odd seconds."""
    even = F.second("datetime") % 2 == 0
    return df.filter(even), df.filter(~even)


@query
def merge_partials(spark, sf_dir):
    """AGG-11: purchases of two parts counted separately, then merged (sum)."""
    a, b = (metrics.purchases_per_minute(p, MERGE_WINDOW) for p in merge_parts(StoreInputs(spark, sf_dir).buys))
    return latest.merge_partials(a, b, ["window_start", "window_end", "store_id"], "count")


@query
def merge_unique_users(spark, sf_dir):
    """AGG-11 for distinct counts (Q3, intent): the two parts' viewer sets are
    merged, then counted; a user seen in both parts counts once."""
    i = StoreInputs(spark, sf_dir)
    a, b = (metrics.viewer_sets(p, i.products, MERGE_WINDOW) for p in merge_parts(i.views))
    return metrics.unique_users_from_sets(a.unionByName(b))


@query
def unique_users_bitmaps(spark, sf_dir):
    """AGG-3 + AGG-11 as bitmaps: the two parts' viewers become bitmaps over one numbering of the users, merged by OR."""
    from ..operators import viewers
    i = StoreInputs(spark, sf_dir)
    a, b = merge_parts(i.views)
    numbers = viewers.number_users(b, viewers.number_users(a))
    states = [viewers.viewer_bitmaps(p, i.products, numbers, MERGE_WINDOW) for p in (a, b)]
    return viewers.unique_users_from_bitmaps(viewers.merge_bitmaps(*states))


# Passes of the kept metrics: days of the month below these, and the rest.
PASS_DAYS = (11, 21, 32)
# Of the late-rows query: every tenth event arrives one pass after its own.
LATE_EVERY = 10
LATE_DELAY = "10 minutes"


@query
def metrics_incremental(spark, sf_dir):
    """AGG-11 + STR-5: three passes merged into the table of kept counts (the second one repeated), then read."""
    from ..session import scratch_path
    from .metric_table import MetricTable
    from .store_pass import tagged_events
    i = StoreInputs(spark, sf_dir)
    kept = MetricTable(spark, scratch_path(spark, "metric-table"))
    below = 0
    for number, day in enumerate(PASS_DAYS):
        part = i.events.where((F.dayofmonth("ts") >= below) & (F.dayofmonth("ts") < day))
        for _ in range(2 if number == 1 else 1):
            kept.add(number, tagged_events(part))
        below = day
    bounds = ["window_start", "window_end", "store_id"]
    none = F.lit(None).cast("string").alias("name")
    return (kept.purchases().select(F.lit("purchases").alias("metric"), *bounds, none, F.col("count").alias("value"))
            .unionByName(kept.revenue(i.products).select(F.lit("revenue").alias("metric"), *bounds, none, F.col("amount_earned").alias("value")))
            .unionByName(kept.ranking(i.products).select(F.lit("views").alias("metric"), *bounds, "name", F.col("views").alias("value"))))


@query
def metrics_late(spark, sf_dir):
    """STR-8: as three passes whose late rows wait in the side table and are corrected twice; ``corrected`` names the windows."""
    from ..session import scratch_path
    from .metric_table import MetricTable
    from .store_pass import tagged_events
    i = StoreInputs(spark, sf_dir)
    kept = MetricTable(spark, scratch_path(spark, "late-table"))
    day = F.dayofmonth("ts")
    own = F.when(day < PASS_DAYS[0], 0).when(day < PASS_DAYS[1], 1).otherwise(2)
    arrives = F.least(own + F.when(F.col("event_id") % LATE_EVERY == 0, 1).otherwise(0), F.lit(2))
    for number in range(3):
        kept.add_on_time(2 * number, tagged_events(i.events.where(arrives == number)), LATE_DELAY)
        if number:
            kept.correct(2 * number + 1)
    fixed = kept.corrected().where("kind = 'buy'").select(F.col("minute").cast("string").alias("_start"), F.lit(True).alias("_fixed"))
    rows = kept.purchases()
    return (rows.join(fixed, rows.window_start == fixed._start, "left")
            .select("window_start", "window_end", "store_id", "count", F.coalesce("_fixed", F.lit(False)).alias("corrected")))


@query
def store_list(spark, sf_dir):
    """SRT-3: the stores present in the events, sorted."""
    return StoreInputs(spark, sf_dir).events.select("store_id").distinct().orderBy("store_id")


# ---- catalogue, stock ---------------------------------------------------------------

@query
def current_products(spark, sf_dir):
    return StoreInputs(spark, sf_dir).products


@query
def order_rollup(spark, sf_dir):
    return stock.order_rollup(StoreInputs(spark, sf_dir).buys)


@query
def stock_after_sales(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return stock.stock_after_sales(i.stock, i.buys)


@query
def unmatched_sales(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return stock.unmatched_sales(i.stock, i.buys)


@query
def price_update(spark, sf_dir):
    return prices.price_update(StoreInputs(spark, sf_dir).products_all_versions, PRICE_UPDATE_N, PRICE_UPDATE_SEED)


@query
def price_changes(spark, sf_dir):
    old = StoreInputs(spark, sf_dir).products_all_versions
    new = prices.price_update(old, PRICE_UPDATE_N, PRICE_UPDATE_SEED)
    return prices.price_changes(old, new, AS_OF)


@query
def price_snapshot(spark, sf_dir):
    return prices.price_snapshot(StoreInputs(spark, sf_dir).products, AS_OF)


# Batches of the kept stock: the sales of the days of the month below these, and the rest.
STOCK_DAYS = (16, 32)
# Key buckets of the kept tables: a few files each at the sizes of the driver tables.
KEY_BUCKETS = 16


def _kept_stock(spark, sf_dir):
    """The stock table after two batches of sales, the second one repeated, and each batch's changes."""
    from ..operators import upkeep
    from ..session import scratch_path
    i = StoreInputs(spark, sf_dir)
    path = scratch_path(spark, "stock")
    upkeep.create_stock(i.stock, path, KEY_BUCKETS)
    below, changes = 0, []
    for number, day in enumerate(STOCK_DAYS):
        part = i.buys.where((F.dayofmonth("datetime") >= below) & (F.dayofmonth("datetime") < day))
        held = scratch_path(spark, "stock-changes")
        upkeep.sell(spark, path, number, part, KEY_BUCKETS).write.parquet(held)
        changes.append(spark.read.parquet(held).withColumn("batch", F.lit(number)))
        below = day
    upkeep.sell(spark, path, number, part, KEY_BUCKETS)
    return upkeep.read_stock(spark, path), changes


@query
def stock_merge(spark, sf_dir):
    """JN-5 as a keyed merge: only the buckets with sales are rewritten."""
    return _kept_stock(spark, sf_dir)[0]


@query
def stock_merge_changes(spark, sf_dir):
    """The change rows that the two batches gave."""
    from functools import reduce
    return reduce(DataFrame.unionByName, _kept_stock(spark, sf_dir)[1])


@query
def price_merge(spark, sf_dir):
    """JN-6 + JN-7 as a keyed merge: the products after one batch of moves, with the time of the history row where one was written."""
    from ..operators import upkeep
    from ..session import scratch_path
    p = StoreInputs(spark, sf_dir).products_all_versions
    path, held = scratch_path(spark, "products"), scratch_path(spark, "price-changes")
    upkeep.create_products(p, path, KEY_BUCKETS)
    upkeep.move_prices(spark, path, 0, prices.price_moves(p, PRICE_UPDATE_N, PRICE_UPDATE_SEED), AS_OF, KEY_BUCKETS).write.parquet(held)
    history = spark.read.parquet(held).select("product_id", "store_id", "price", "recorded_at").distinct()
    rows = upkeep.read_products(spark, path).join(p.select("id_product", F.col("price").alias("before")), "id_product")
    moved = rows.where("price <> before").drop("before").join(
        history.withColumnRenamed("product_id", "id"), ["id", "store_id", "price"])
    same = rows.where("price = before").drop("before").withColumn("recorded_at", F.lit(None).cast("timestamp_ntz"))
    return same.unionByName(moved.select(*same.columns))


# ---- deals ----------------------------------------------------------------------------

@query
def price_deals(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, DEAL_DISCOUNT)


@query
def deals_ranked(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    d = deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, DEAL_DISCOUNT)
    r = deals.deals_in_order(d)
    return r.select("rank", "product_id", "store_id", F.round("evaluated_discount", 6).alias("evaluated_discount"), "line")


@query
def deal_report(spark, sf_dir):
    """RPT-7: the deal answer as the dashboard shows it."""
    i = StoreInputs(spark, sf_dir)
    d = deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, DEAL_DISCOUNT)
    r = deals.deal_report(d, DEAL_MONTHS, DEAL_DISCOUNT, AS_OF)
    return r.withColumn("evaluated_discount", F.round("evaluated_discount", 6))


@query
def deal_messages(spark, sf_dir):
    """FN-16: the deal answer as result messages of consecutive ranks."""
    i = StoreInputs(spark, sf_dir)
    d = deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, DEAL_DISCOUNT)
    return deals.deal_messages(d, DEAL_MONTHS, DEAL_DISCOUNT, AS_OF)


@query
def deal_messages_decoded(spark, sf_dir):
    """FN-14/FN-16/RPT-7 on the consumer side: result messages decoded and
    ranked; equals deals_ranked plus the request fields."""
    r = deals.rank_deals(deals.decode_deal_messages(deal_messages(spark, sf_dir)))
    return r.select("rank", "product_id", "store_id", F.round("evaluated_discount", 6).alias("evaluated_discount"), "line",
                    "months", "discount", "answered_at")


@query
def deal_messages_empty(spark, sf_dir):
    """The answer without a deal, as the consumer shows it: one message with an empty list is sent."""
    i = StoreInputs(spark, sf_dir)
    d = deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, 100.0)
    return deals.answer_lines(deals.deal_messages(d, DEAL_MONTHS, 100.0, AS_OF))


@query
def deal_report_empty(spark, sf_dir):
    """RPT-7 when nothing qualifies (a 100 % discount can never be met)."""
    i = StoreInputs(spark, sf_dir)
    d = deals.price_deals(i.history, i.catalog, AS_OF, DEAL_MONTHS, 100.0)
    return deals.deal_report(d, DEAL_MONTHS, 100.0, AS_OF)


def _raw_requests(spark):
    return spark.createDataFrame([(n, v) for n, v in enumerate(DEAL_REQUESTS)], "request_id INT, value STRING")


@query
def deal_requests(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    req = deals.decode_requests(_raw_requests(spark))
    return deals.deals_for_requests(i.history, i.catalog, req, AS_OF)


# ---- bonus ----------------------------------------------------------------------------

@query
def bonus_totals(spark, sf_dir):
    return bonus.spend_totals(StoreInputs(spark, sf_dir).purchases)


@query
def bonus_eligible(spark, sf_dir):
    return bonus.bonus_eligible(StoreInputs(spark, sf_dir).purchases, BONUS_MIN_SHORT, BONUS_MIN_LONG)


@query
def bonus_contained(spark, sf_dir):
    return bonus.bonus_contained(StoreInputs(spark, sf_dir).purchases, BONUS_MIN_SHORT, BONUS_MIN_LONG)


@query
def bonus_sliding(spark, sf_dir):
    """Q12 intent: sliding 10-minute (1-minute steps) and 6-hour (10-minute steps) windows."""
    return bonus.bonus_sliding(StoreInputs(spark, sf_dir).purchases, BONUS_MIN_SHORT, BONUS_MIN_LONG)


@query
def bonus_messages(spark, sf_dir):
    return bonus.bonus_messages(bonus_eligible(spark, sf_dir)).select("value", "line")


@query
def coupon_lines(spark, sf_dir):
    """RPT-8 on the consumer's side: coupon messages decoded to lines."""
    return bonus.coupon_lines(bonus.bonus_messages(bonus_eligible(spark, sf_dir)))


@query
def bonus_count(spark, sf_dir):
    return bonus.bonus_count(bonus_eligible(spark, sf_dir))


@query
def views_strictly_before_buy(spark, sf_dir):
    i = StoreInputs(spark, sf_dir)
    return metrics.views_strictly_before_buy(i.views, i.buys)


# ---- logs and messages ------------------------------------------------------------------

_LOG_DIRS: dict[tuple[str, str], str] = {}


def _log_dir(spark, sf_dir) -> str:
    """The event table written as store log files, once per session and table
    directory (the log files are the source the log queries read, as the
    reference reads files that already exist)."""
    from ..session import scratch_path
    from ..sources import logs
    key = (spark.sparkContext.applicationId, str(sf_dir))
    path = _LOG_DIRS.get(key)
    if path is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            path = None
    if path is None:
        path = logs.write_logs(logs.render_log_rows(StoreInputs(spark, sf_dir).events), scratch_path(spark, "logs"))
        _LOG_DIRS[key] = path
    return path


@query
def log_scan(spark, sf_dir):
    """SRC-1/2 + SNK-8: logs written as ';' files with headers, read back."""
    from ..sources import logs
    return logs.read_logs(spark, _log_dir(spark, sf_dir))


@query
def csv_round_trip(spark, sf_dir):
    """SNK-6: log rows saved as CSV with a header and read back."""
    from ..session import scratch_path
    from ..sinks.writers import save_csv
    from ..sources import logs
    path = scratch_path(spark, "csv")
    rows = logs.render_log_rows(StoreInputs(spark, sf_dir).events)
    save_csv(rows, path, overwrite=True)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


# Cycles (days) from this one on are new to the file listing.
FIRST_NEW_CYCLE = "2024-01-20"


_CYCLE_DIRS: dict[tuple[str, str], str] = {}


def _cycle_day():
    from ..functions.parsing import ns_text_to_timestamp
    return F.date_format(ns_text_to_timestamp(F.col("timestamp")), "yyyy-MM-dd")


def _cycle_dir(spark, sf_dir) -> str:
    """The event table as log files in the layout of store and cycle, once per session and table directory."""
    from ..session import scratch_path
    from ..sinks import files
    from ..sources import logs
    key = (spark.sparkContext.applicationId, str(sf_dir))
    path = _CYCLE_DIRS.get(key)
    if path is None or not files.exists(spark, path):
        rows = logs.render_log_rows(StoreInputs(spark, sf_dir).events)
        path = _CYCLE_DIRS[key] = logs.write_store_logs(rows, scratch_path(spark, "cycles"), _cycle_day())
    return path


def _store_and_cycle(files_):
    return files_.select(F.regexp_extract("file_path", r"/store=([^/]+)/", 1).alias("store"),
                         F.regexp_extract("file_path", r"/cycle=([^/]+)/", 1).alias("cycle")).where("cycle <> ''").distinct()


@query
def new_files(spark, sf_dir):
    """SET-3 + SNK-8: log files in the layout of store and cycle; the stores and cycles of unseen files."""
    from ..sources import logs
    path = _cycle_dir(spark, sf_dir)
    cycle = F.regexp_extract("file_path", r"/cycle=([^/]+)/", 1)
    seen = logs.files_in(spark, path).where((cycle < FIRST_NEW_CYCLE) | ~F.col("file_path").rlike(r"/cycle="))
    return _store_and_cycle(logs.new_files(spark, path, seen))


# The store and cycle whose file is written anew between two passes.
REWRITTEN = ("store_1", "2024-01-05")


@query
def new_files_passes(spark, sf_dir):
    """SET-3 + STR-7 with the manifest: a pass that fails is not recorded, one that succeeds is, and of the files that are
    then written anew or added, just those are read by the next pass."""
    from ..session import scratch_path
    from ..sources import logs
    path, held = scratch_path(spark, "log-folder"), []
    manifest = logs.FileManifest(spark, scratch_path(spark, "manifest"))
    rows = logs.render_log_rows(StoreInputs(spark, sf_dir).events)
    old = _cycle_day() < FIRST_NEW_CYCLE

    def note(number):
        out = scratch_path(spark, "fresh-files")
        fresh = manifest.fresh(path, number)
        _store_and_cycle(fresh).withColumn("pass", F.lit(number)).write.parquet(out)
        held.append(spark.read.parquet(out))
        return fresh

    def write(part):
        (part.select(*logs.LOG_COLUMNS, F.col("store_id").alias("store"), _cycle_day().alias("cycle")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("store", "cycle").option("sep", ";").option("header", True).csv(path))

    write(rows.where(old))
    note(0)  # fails after it has looked: its files are new to the next pass
    manifest.record(note(1), 1)
    write(rows.where(~old | ((F.col("store_id") == REWRITTEN[0]) & (_cycle_day() == REWRITTEN[1]))))
    manifest.record(note(2), 2)
    note(3)
    return held[0].unionByName(held[1]).unionByName(held[2]).unionByName(held[3])


# The store and first cycle that the pruned scan asks for.
SCAN_STORE, SCAN_FROM = "store_2", "2024-01-15"


@query
def log_scan_store(spark, sf_dir):
    """SRC-1 + SRC-3: one store's logs from a cycle on; only its folders are listed and read."""
    from ..sources import logs
    rows = logs.read_store_logs(spark, _cycle_dir(spark, sf_dir))
    return rows.where((F.col("store") == SCAN_STORE) & (F.col("cycle") >= SCAN_FROM))


# Of every so many events one more, malformed, line is written.
REJECT_EVERY = 50


@query
def log_rejects(spark, sf_dir):
    """SRC-2 / Q23: logs with malformed lines among them; the rejected lines with their reason, and how many were accepted."""
    from ..session import scratch_path
    from ..sources import logs
    path = scratch_path(spark, "checked")
    events = StoreInputs(spark, sf_dir).events
    rows = logs.render_log_rows(events)
    rows.write.option("sep", ";").option("header", True).csv(f"{path}/good")
    bad = events.where(F.col("event_id") % REJECT_EVERY == 0)
    ts, kind = logs.ns_text(F.col("ts")).alias("timestamp"), (F.col("event_id") / REJECT_EVERY).cast("long") % 3
    user, action = F.col("user_id").alias("content"), F.lit("BUY").alias("extra_1")
    short = bad.where(kind == 0).select(ts, F.col("store_id"))
    wide = bad.where(kind == 1).select(ts, "store_id", F.lit("Audit").alias("type"), user, action, F.lit("7").alias("extra_2"), F.lit("x").alias("more"))
    stray = bad.where(kind == 2).select(F.concat(F.lit("at "), F.col("event_id")).alias("timestamp"), "store_id", F.lit("Audit").alias("type"),
                                        user, action, F.lit("7").alias("extra_2"))
    for name, part in (("short", short), ("wide", wide), ("stray", stray)):
        part.write.option("sep", ";").option("header", True).csv(f"{path}/{name}")
    good, rejected = logs.read_checked_logs(spark, path)
    counted = good.agg(F.count(F.lit(1)).cast("string").alias("line")).select("line", F.lit("accepted").alias("reason"))
    return rejected.select("line", "reason").unionByName(counted)


BATCH_LINES = 100


@query
def batch_message(spark, sf_dir):
    """SNK-3: stored lines as JSON lists of at most ``BATCH_LINES`` lines."""
    from ..sources import logs
    return logs.batch_messages(ingest(spark, sf_dir).select("id", "message"), BATCH_LINES)


@query
def event_split(spark, sf_dir):
    """SRC-3 + FLT-1 + FN-2: buy and view rows from one log scan."""
    from ..sources import logs
    from .store_pass import tagged_log_events
    return tagged_log_events(logs.read_logs(spark, _log_dir(spark, sf_dir)))


@query
def log_purchases_per_minute(spark, sf_dir):
    """AGG-1 end to end from the log files."""
    from ..operators.events import split_log
    from ..sources import logs
    return metrics.purchases_per_minute(split_log(logs.read_logs(spark, _log_dir(spark, sf_dir)))["buy"])


@query
def ingest(spark, sf_dir):
    """SRC-7 + SNK-2: events(id, message) as the ingest service stores them."""
    from ..sources import logs
    return logs.render_messages(StoreInputs(spark, sf_dir).events)


@query
def ingest_stream(spark, sf_dir):
    """SRC-7 + SNK-2 + STR-4 as the stream itself: the lines as text files, several micro-batches, dense LONG ids."""
    from ..session import scratch_path
    from ..sources import logs
    from ..streaming.jobs import ingest_lines
    lines = logs.render_messages(StoreInputs(spark, sf_dir).events).select(F.regexp_replace("message", r"\n$", "").alias("value"))
    source, table = scratch_path(spark, "lines"), scratch_path(spark, "events")
    lines.repartition(4).write.text(source)
    ingest_lines(spark, source, table, scratch_path(spark, "ingest-checkpoint"), max_files_per_trigger=2).awaitTermination()
    return spark.read.schema("id long, message string").parquet(table)


@query
def parse_events(spark, sf_dir):
    """PRJ-2 + FN-1: messages -> typed columns and datetime."""
    from ..sources import logs
    return logs.parse_messages(ingest(spark, sf_dir))


@query
def buy_details(spark, sf_dir):
    """FLT-3 + PRJ-3: purchases with product and price from the message text."""
    from ..operators.purchases import message_purchases
    return message_purchases(parse_events(spark, sf_dir))


@query
def bonus_from_messages(spark, sf_dir):
    """The bonus job end to end: stored messages -> eligible users."""
    return bonus.bonus_eligible(buy_details(spark, sf_dir), BONUS_MIN_SHORT, BONUS_MIN_LONG)


# ---- user flow ---------------------------------------------------------------------------

@query
def flow_transitions(spark, sf_dir):
    from ..operators import flow
    return flow.transitions(StoreInputs(spark, sf_dir).events)


@query
def flow_drift(spark, sf_dir):
    from ..operators import flow
    return flow.drift(spark, flow.node_transitions(StoreInputs(spark, sf_dir).events))


# ---- published insights and report lines ---------------------------------------------------

def _task_results(spark, sf_dir, store=None) -> dict[str, DataFrame]:
    """The six tasks as published: newest window per store for the timed ones."""
    from . import store_pass as sp
    i = StoreInputs(spark, sf_dir)
    return sp.task_results(sp.tagged_events(i.events), i.products, i.stock, store)


@query
def store_pass(spark, sf_dir):
    """The six-task pass as published: one message per task over all stores."""
    from ..operators.payload import task_messages
    return task_messages(insight_payload(spark, sf_dir))


@query
def log_store_pass(spark, sf_dir):
    """The metrics service as the reference runs it: six tasks from the store
    log files plus the product and stock tables."""
    from ..sources import logs
    from . import store_pass as sp
    i = StoreInputs(spark, sf_dir)
    log = logs.read_logs(spark, _log_dir(spark, sf_dir))
    return sp.payloads(sp.task_results(sp.tagged_log_events(log), i.products, i.stock))


@query
def insight_payload(spark, sf_dir):
    """AGG-10 + SNK-4: one JSON message body per (task, store)."""
    from .store_pass import payloads
    return payloads(_task_results(spark, sf_dir))


@query
def task_messages_decoded(spark, sf_dir):
    """SRC-9: the published messages back to one body per (task, store)."""
    from ..operators.payload import decode_task_messages
    return decode_task_messages(store_pass(spark, sf_dir))


@query
def insight_decode(spark, sf_dir):
    """SRC-9: published bodies back to one row per detail."""
    from ..operators.payload import decode_payloads
    return decode_payloads(insight_payload(spark, sf_dir))


@query
def latest_insight(spark, sf_dir):
    """STR-6: a purchases message per store and minute, latest one per store kept."""
    from ..operators.payload import TASK_DETAILS, latest_per_key, store_payloads
    from .store_pass import task_order
    task = "purchases_per_minute"
    every = store_payloads(purchases_per_minute(spark, sf_dir).withColumn("_end", F.col("window_end")),
                           task, TASK_DETAILS[task], task_order(task), keys=("store_id", "_end"))
    return latest_per_key(every, "_end", ["task_name", "store_id"]).withColumnRenamed("_end", "window_end")


@query
def store_report_one(spark, sf_dir):
    """FLT-10: the report of one store, from that store's rows alone."""
    from ..operators.deals import report_for_store
    return report_for_store(_report(_task_results(spark, sf_dir, "store_2")), "store_2")


@query
def store_report(spark, sf_dir):
    """RPT-1..6 + RPT-9: every report line of every store."""
    return _report(_task_results(spark, sf_dir))


def _report(t: dict[str, DataFrame]) -> DataFrame:
    from ..operators import reports
    from ..operators.payload import TASK_DETAILS
    out = reports.store_report([
        reports.purchases_lines(t["purchases_per_minute"]),
        reports.revenue_lines(t["revenue_per_minute"]),
        reports.unique_users_lines(t["unique_users_per_minute"]),
        reports.most_viewed_lines(t["ranking_viewed_products_per_hour"]),
        reports.median_lines(median.median_views_ref(t["median_views_before_buy"])),
        reports.without_stock_lines(t["without_stock"]),
    ])
    return reports.with_empty_sections(out, list(TASK_DETAILS))
