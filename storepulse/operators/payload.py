"""Insight messages (AGG-10, SNK-4, SRC-9, STR-6).

A task result becomes one JSON object per store, ``{"0": {...}, ..., "9": {...}}``,
holding the store's first ``n`` detail rows (10 unless the caller asks for more).
Each store's rows are bounded to ``n`` by a per-store ``row_number`` filter (planned
as a group limit before the shuffle) before anything is collected into a list;
``n=None`` publishes all rows and is meant for results of a bounded number of rows
per store, such as the histogram of view counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DETAILS = 10

# Task names and detail columns of the six published tasks.
TASK_DETAILS = {
    "purchases_per_minute": ["count", "window_start", "window_end"],
    "revenue_per_minute": ["amount_earned", "window_start", "window_end"],
    "unique_users_per_minute": ["name", "unique_users", "window_start", "window_end"],
    "ranking_viewed_products_per_hour": ["name", "views", "window_start", "window_end"],
    "median_views_before_buy": ["count", "views"],
    "without_stock": ["products_sold_without_stock"],
}


def store_payloads(df: DataFrame, task_name: str, detail_cols: list[str], order: list[Column],
                   keys: tuple[str, ...] = ("store_id",), n: int | None = MAX_DETAILS) -> DataFrame:
    """Rows of one task -> (task_name, *keys, payload JSON). Timestamps travel
    as 'yyyy-MM-dd HH:mm:ss' text, like the dashboard prints them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # filter on row_number itself, so it is planned as a group limit
    top = df.withColumn("_rn", F.row_number().over(w))
    top = (top if n is None else top.filter(F.col("_rn") <= n)).withColumn("_rank", F.col("_rn") - 1).drop("_rn")
    fields = ", ".join(f"CAST(`{c}` AS STRING) AS `{c}`" if c == "window_end" else f"`{c}`" for c in detail_cols)
    grouped = top.groupBy(*keys).agg(
        F.expr(f"sort_array(collect_list(struct(_rank, struct({fields}) AS d)))").alias("_l"))
    # one SQL expression: {"<rank>": {detail}, ...}, null fields kept
    body = F.expr("to_json(map_from_entries(transform(_l, x -> struct(CAST(x._rank AS STRING), x.d))), "
                  "map('ignoreNullFields', 'false'))")
    return grouped.select(F.lit(task_name).alias("task_name"), *keys, body.alias("payload"))


def decode_payloads(messages: DataFrame) -> DataFrame:
    """SRC-9: (task_name, store_id, payload) -> one row per detail:
    (task_name, store_id, rank, detail JSON text)."""
    m = messages.select("task_name", "store_id",
                        F.explode(F.from_json("payload", "map<string, string>")).alias("rank", "detail"))
    return m.select("task_name", "store_id", F.col("rank").cast("int").alias("rank"), "detail")


def latest_per_key(messages: DataFrame, ts: str, keys: list[str], value: str = "payload") -> DataFrame:
    """STR-6: last write wins per key (an aggregate, combined map-side)."""
    return messages.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def task_messages(payloads: DataFrame) -> DataFrame:
    """SNK-4 as published: one message per task, ``{"task_name": <task>, "<store>": {...}, ...}``.

    One body per store, so a message grows with the number of stores alone."""
    bodies = F.sort_array(F.collect_list(F.struct("store_id", "payload")))
    # a store's name as a JSON string: the text of a one-element list without its brackets
    name = lambda x: F.regexp_replace(F.to_json(F.array(x["store_id"])), r"^\[|\]$", "")
    part = lambda x: F.concat(F.lit(","), name(x), F.lit(":"), x["payload"])
    return payloads.where("store_id is not null").groupBy("task_name").agg(bodies.alias("_b")).select(
        "task_name", F.concat(F.lit('{"task_name":"'), F.col("task_name"), F.lit('"'),
                              F.concat_ws("", F.transform("_b", part)), F.lit("}")).alias("message"))


def decode_task_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """The consumer's side: (task_name, store_id, payload) of every store in the messages.
    A message that is no JSON object is left out, as the consumer logs and skips it."""
    m = messages.select(F.from_json(F.col(column), "map<string, string>").alias("m")).where("m is not null")
    return (m.select(F.coalesce(F.col("m")["task_name"], F.lit("N/A")).alias("task_name"), F.explode("m").alias("store_id", "payload"))
            .where("store_id <> 'task_name'"))
