"""Keyed state that forgets (STR-5, STR-6): event-time timers end a key's state a time after its last event.

Views and buys per (user, product, store), and the newest insight per (store, task). Keys that were not
heard of for ``ttl`` leave the state and the table made from it, so that neither grows with keys long gone.
The state functions use pandas alone, so that workers need nothing of this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timewin import duration_us
from ..operators import metrics
from ..operators.events import split_log
from ..sinks import files
from ..sinks.merge import bucket, merge_batch

BUCKETS = 64
COUNTS = "user_id string, product_id string, store_id string, views bigint, buys bigint, bucket int"
INSIGHTS = "store_id string, task_name string, payload string, ts timestamp, bucket int"


def forgetting_counts(log_stream: DataFrame, ttl: str, watermark: str = "10 minutes") -> DataFrame:
    """Updates (user_id, product_id, store_id, views, buys, kept): a key's counts when it has new events, and once with
    ``kept`` false when it is forgotten."""
    from .jobs import event_time
    parts = split_log(log_stream)
    keys, ttl_ms = list(metrics.BUY_KEYS), duration_us(ttl) // 1000
    names = [*keys, "views", "buys", "kept"]
    one = (parts["view"].select(*keys, "datetime", F.lit(1).alias("v"), F.lit(0).alias("b"))
           .unionByName(parts["buy"].select(*keys, "datetime", F.lit(0).alias("v"), F.lit(1).alias("b"))))
    timed = event_time(one.where("datetime is not null")).withWatermark("datetime", watermark)

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            views, buys, _ = state.get
            state.remove()
            yield pd.DataFrame([(*key, views, buys, False)], columns=names)
            return
        views, buys, last = state.get if state.exists else (0, 0, 0)
        for f in frames:
            views, buys = views + int(f["v"].sum()), buys + int(f["b"].sum())
            last = max(last, int(f["datetime"].max().timestamp() * 1000))
        state.update((views, buys, last))
        # a timer has to lie beyond the watermark; one that would not fires with the next batch
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, views, buys, True)], columns=names)

    return timed.groupBy(*keys).applyInPandasWithState(
        count, "user_id string, product_id string, store_id string, views bigint, buys bigint, kept boolean",
        "views bigint, buys bigint, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def forgetting_insights(messages: DataFrame, ttl: str, watermark: str = "10 minutes") -> DataFrame:
    """Updates (store_id, task_name, payload, ts, kept): the newest payload of each key."""
    ttl_ms, names = duration_us(ttl) // 1000, ["store_id", "task_name", "payload", "ts", "kept"]

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            payload, last = state.get
            state.remove()
            yield pd.DataFrame([(*key, payload, pd.Timestamp(last, unit="us"), False)], columns=names)
            return
        payload, last = state.get if state.exists else (None, -1)
        for f in frames:
            at = f.sort_values(["ts", "payload"]).iloc[-1]
            us = at["ts"].value // 1000
            if us >= last:
                payload, last = at["payload"], us
        state.update((payload, last))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, payload, pd.Timestamp(last, unit="us"), True)], columns=names)

    return (messages.select("store_id", "task_name", "payload", "ts").withWatermark("ts", watermark).groupBy("store_id", "task_name")
            .applyInPandasWithState(newest, "store_id string, task_name string, payload string, ts timestamp, kept boolean",
                                    "payload string, last bigint", "update", GroupStateTimeout.EventTimeTimeout))


def keep_table(updates: DataFrame, schema: str, keys: list[str], path: str, checkpoint: str, buckets: int = BUCKETS,
               available_now: bool = True) -> StreamingQuery:
    """Merge a stream of updates into a table by key bucket: only buckets with updates are written, forgotten keys leave."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = spark.createDataFrame([], schema).schema

        def merge(old, new):
            cond = F.lit(True)
            side = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
            return old.join(side, cond, "left_anti").unionByName(new.where("kept").select(*own.names))

        # a key can be counted and forgotten in one batch: its timer fires after its events
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), ~F.col("kept")).alias("u"))
        fresh = last.select(*keys, "u.*").withColumn("bucket", bucket(keys, buckets))
        merge_batch(spark, path, batch_id, fresh, "bucket", merge, own.names, own)

    w = updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    return w.start()


def keep_counts(updates: DataFrame, path: str, checkpoint: str, **more) -> StreamingQuery:
    return keep_table(updates, COUNTS, list(metrics.BUY_KEYS), path, checkpoint, **more)


def keep_insights(updates: DataFrame, path: str, checkpoint: str, **more) -> StreamingQuery:
    return keep_table(updates, INSIGHTS, ["store_id", "task_name"], path, checkpoint, **more)


def kept(spark: SparkSession, schema: str, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema).drop("bucket")
    return spark.read.schema(schema).parquet(path).drop("bucket")
