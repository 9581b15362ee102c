"""Structured Streaming forms of the operators (STR-1..STR-8, SNK-2, SNK-3).

The batch operator functions are reused unchanged wherever streaming allows;
the differences are the event-time column (TIMESTAMP, needed by watermarks),
the watermark itself, and the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timewin import is_ntz
from ..operators import metrics
from ..operators.bonus import LONG, MIN_LONG, MIN_SHORT, SHORT, spend
from ..operators.events import split_log
from ..sinks.appends import append_batch
from ..sinks.merge import bucket, merge_batch
from ..sources.logs import batch_messages, parse_messages


def event_time(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ); the wall
    clock is read in the session time zone (UTC in every job here)."""
    if is_ntz(df, column):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def purchases_per_minute(log_stream: DataFrame, watermark: str = "10 minutes",
                         duration: str = "1 minute") -> DataFrame:
    """AGG-1 on a log stream: one grouping-sets aggregation (store rows and
    ``All`` rows in one state store); append mode emits each window once, when
    the watermark passes its end."""
    buys = event_time(split_log(log_stream)["buy"]).withWatermark("datetime", watermark)
    return metrics.purchases_per_minute(buys, duration)


def view_ranking_per_hour(log_stream: DataFrame, products: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """AGG-4 on a stream: pre-aggregation, stream-static join with the
    product table, then the grouping-sets aggregation (chained aggregations in
    append mode)."""
    views = event_time(split_log(log_stream)["view"]).withWatermark("datetime", watermark)
    return metrics.view_ranking_per_hour(views, products)


def revenue_per_minute(log_stream: DataFrame, products: DataFrame, watermark: str = "10 minutes",
                       duration: str = "1 minute") -> DataFrame:
    """AGG-2 on a stream: views per product, stream-static join with the product
    table, then the grouping-sets sum (chained aggregations in append mode)."""
    views = event_time(split_log(log_stream)["view"]).withWatermark("datetime", watermark)
    return metrics.revenue_per_minute(views, products, duration)


def unique_users_per_minute(log_stream: DataFrame, products: DataFrame, watermark: str = "10 minutes",
                            duration: str = "1 minute") -> DataFrame:
    """AGG-3 on a stream (exact, no approximate distinct): stream-static join
    with the product table, the viewer sets as a watermarked aggregation on
    (window, name, store, user), then the grouping-sets count; both state stores
    are evicted by the watermark, and each window is emitted once (append)."""
    views = event_time(split_log(log_stream)["view"]).withWatermark("datetime", watermark)
    attrs = products.select(F.col("id").alias("product_id"), "store_id", "name")
    j = views.join(attrs, ["product_id", "store_id"], "left")
    sets = (j.groupBy(F.window("datetime", duration).alias("window"), "name", "store_id", "user_id")
             .agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    return metrics.unique_users_from_sets(sets, dedupe=False)


def bonus_contained(purchases: DataFrame, watermark: str = "10 minutes", min_short: float = MIN_SHORT,
                    min_long: float = MIN_LONG, short: str = SHORT, long: str = LONG) -> DataFrame:
    """JN-3 streaming form (Q13/Q14): 10-minute totals rolled into the 6-hour
    window holding them (a window of windows), so there is no stream-stream
    join and both state stores are evicted by the watermark. Each eligible
    (user, store, 6 h) row is emitted once, when its window closes."""
    p = event_time(purchases).withWatermark("datetime", watermark)
    short_tot = (p.groupBy(F.window("datetime", short).alias("w10"), "user_id", "store_id")
                  .agg(spend().alias("total_10m")))
    long_tot = (short_tot.groupBy(F.window("w10", long).alias("w6"), "user_id", "store_id")
                         .agg(F.sum("total_10m").alias("total_6h"),
                              F.count_if(F.col("total_10m") > min_short).alias("windows_10m")))
    return long_tot.filter((F.col("total_6h") > min_long) & (F.col("windows_10m") > 0)).select(
        "user_id", "store_id", F.col("w6.start").alias("window_start"), F.col("w6.end").alias("window_end"),
        F.col("total_6h").cast("double").alias("total_6h"), "windows_10m")


def purchases_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Message stream -> purchases (PRJ-2, FLT-3, PRJ-3)."""
    from ..operators.purchases import message_purchases
    return message_purchases(parse_messages(lines.withColumnRenamed(column, "message")))


def latest_insights(messages: DataFrame) -> DataFrame:
    """STR-6: newest payload per (store, task); run in update mode."""
    return (messages.groupBy("store_id", "task_name")
                    .agg(F.max_by("payload", "ts").alias("payload"), F.max("ts").alias("ts")))


MESSAGE_LINES = 1000


def ingest_lines(spark: SparkSession, source: str | DataFrame, table_path: str, checkpoint: str,
                 batch_path: str | None = None, max_files_per_trigger: int | None = None,
                 available_now: bool = True, lines_per_message: int = MESSAGE_LINES) -> StreamingQuery:
    """SRC-5/SRC-7 + SNK-2 + SNK-3 + STR-4: text lines -> events(id LONG, message).

    ``source`` is a folder of text files or a stream with a ``value`` column (a topic).
    Ids have no gaps (``sinks.appends``). Each micro-batch overwrites its own ``batch_id=<n>`` folder, so a batch
    replayed after a failure takes the same range of ids (exactly-once on top of the checkpoint). The
    optional batch messages (SNK-3) are made from the rows just written, so the source is read once;
    each is a JSON list of at most ``lines_per_message`` lines.
    """
    if isinstance(source, str):
        r = spark.readStream.format("text")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = r.load(source)
    else:
        lines = source.select("value")

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = append_batch(batch.select(F.col("value").alias("message")), table_path, batch_id, "id")
        if batch_path:
            batch_messages(own, lines_per_message).write.mode("overwrite").parquet(f"{batch_path}/batch_id={batch_id}")

    w = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def publish_task(results: DataFrame, task_name: str, out_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """STR-5 + WIN-1 + SNK-4 as a stream: a watermarked metric in append mode
    emits each window once when it closes; every micro-batch then publishes,
    per store, the newest of its closed windows as one payload message
    (``dense_rank`` is not allowed on a stream, so it runs inside foreachBatch,
    on the batch's closed windows only). A replayed batch rewrites its folder."""
    from ..operators.latest import last_window
    from ..operators.payload import TASK_DETAILS, store_payloads
    from ..plans.store_pass import task_order

    def publish(batch: DataFrame, batch_id: int) -> None:
        msgs = store_payloads(last_window(batch), task_name, TASK_DETAILS[task_name], task_order(task_name))
        (msgs.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .json(f"{out_path}/batch_id={batch_id}"))

    w = results.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


STATE = "user_id string, product_id string, store_id string, views bigint, buys bigint, bucket int"
BUCKETS = 64


def views_per_buy_state(log_stream: DataFrame, table_path: str, checkpoint: str,
                        available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """AGG-5 / STR-5 for an all-time metric: view and buy counts per (user,
    product, store) kept as streaming state (update mode; the state is bounded
    by the key space, not by the events). Each micro-batch merges its updated keys into
    the table's key buckets; buckets without updated keys are not written."""
    parts = split_log(log_stream)
    cols = list(metrics.BUY_KEYS)
    tagged = (parts["view"].select(*cols, F.lit(1).alias("v"), F.lit(0).alias("b"))
              .unionByName(parts["buy"].select(*cols, F.lit(0).alias("v"), F.lit(1).alias("b"))))
    counts = tagged.groupBy(*cols).agg(F.sum("v").cast("long").alias("views"), F.sum("b").cast("long").alias("buys"))

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:  # counts only grow: a key's newest are its largest
        return (old.unionByName(new).groupBy(*cols, "bucket")
                .agg(F.max("views").alias("views"), F.max("buys").alias("buys")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        schema = batch.sparkSession.createDataFrame([], STATE).schema
        merge_batch(batch.sparkSession, table_path, batch_id, batch.withColumn("bucket", bucket(cols, buckets)), "bucket", newest,
                    schema.names, schema)

    w = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def views_before_buy_from_state(spark, table_path: str) -> DataFrame:
    """The histogram from the table of counts."""
    state = spark.read.schema(STATE).parquet(table_path)
    views = F.when(metrics.any_null(*metrics.BUY_KEYS), F.lit(0).cast("long")).otherwise(F.col("views"))
    return metrics.views_histogram(state.filter(F.col("buys") > 0).select("store_id", views.alias("views"), "buys"))
