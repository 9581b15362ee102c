"""Price deals (AGG-9, JN-4, FLT-5, FLT-6, FN-10, FN-11, SRT-2, JN-8, FLT-9).

A deal is a product whose current price is strictly below
``avg(price over the last 30*months days) * (1 - discount/100)``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.timewin import ntz_lit
from .numbering import numbered

DAY_US = 86_400_000_000
# The longest period, in months of 30 days: from 1973 on its start is still a date. The dashboard asks for 1 to 48.
LONGEST_PERIOD = 24_000
DEALS_PER_MESSAGE = 1000
# Parts of the products of a period; each request is sent to all of them.
PERIOD_PARTS = 64


def period_start(as_of: dt.datetime, months: int) -> dt.datetime:
    """FN-13 / Q17: a month is 30 days."""
    return as_of - dt.timedelta(days=30 * months)


def average_prices(history: DataFrame, as_of: dt.datetime, months: int) -> DataFrame:
    """FLT-5 + AGG-9: average price per (product, store) since the period start
    (no upper bound). The bound is a literal, so it reaches the scan."""
    start = period_start(as_of, months)
    return (history.filter(F.col("recorded_at") >= ntz_lit(start))
                   .groupBy("product_id", "store_id")
                   # exact for DECIMAL prices: decimal(p+4, s+4), half-up
                   .agg(F.avg("price").cast("double").alias("avg_price")))


def price_deals(history: DataFrame, products: DataFrame, as_of: dt.datetime,
                months: int, discount_percent: float) -> DataFrame:
    """JN-4 + FLT-6: current products priced under the threshold.

    A sort-merge join: by the size of its compressed file a catalogue of millions of rows looks small enough to be
    broadcast, and then stands whole in the driver and in each task."""
    factor = 1 - discount_percent / 100
    avg = average_prices(history, as_of, months).withColumnRenamed("product_id", "id")
    j = products.join(avg.hint("merge"), ["id", "store_id"], "inner")
    return j.filter(F.col("price") < F.col("avg_price") * F.lit(factor)).select(
        F.col("id").alias("product_id"), "name", "store_id", "price",
        F.col("avg_price").alias("average_price"))


def rank_deals(deals: DataFrame) -> DataFrame:
    """FN-11 + SRT-2 + RPT-7: evaluated discount and the report line; order is
    applied by the caller at the very end."""
    from ..functions.fmt import money
    disc = F.try_divide(F.col("average_price") - F.col("price"), F.col("average_price")) * F.lit(100)
    return deals.withColumn("evaluated_discount", disc).withColumn(
        "line", F.format_string(texts.DEAL_LINE, F.col("name"), F.col("product_id"), money(F.col("average_price")),
                                money(F.col("price")), money(F.col("evaluated_discount")), F.col("store_id")))


def _requests(raw: DataFrame, column: str) -> DataFrame:
    from ..schemas import DEAL_REQUEST_DDL
    r = raw.select("request_id", F.col(column).alias("value"), F.from_json(F.col(column), DEAL_REQUEST_DDL).alias("r"))
    months, discount = F.col("r.time_window"), F.col("r.discount_percentage")
    reason = (F.when(months.isNull() | discount.isNull(), texts.NO_REQUEST).when(~(discount > 0), texts.NO_DISCOUNT)
               .when(~months.between(1, LONGEST_PERIOD), texts.NO_PERIOD))
    return r.select("request_id", "value", months.alias("months"), discount.alias("discount"), reason.alias("reason"))


def decode_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """SRC-8 + FLT-9: JSON requests -> (request_id, months, discount). A request
    that is no valid JSON, has a discount not above 0 or a period whose start is no
    date is rejected by itself (``rejection_messages``); the others are answered."""
    return _requests(raw, column).where("reason is null").select("request_id", "months", "discount")


def rejection_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """The answer to each request that can't be met: an error message with the reason and the request as it came."""
    body = F.struct(F.lit("error").alias("status"), F.lit("price_monitor_job_results").alias("task_name"),
                    F.col("reason").alias("error"), F.coalesce("value", F.lit("")).alias("request"))
    return _requests(raw, column).where("reason is not null").select("request_id", F.to_json(body).alias("message"))


def requested_periods(requests: DataFrame) -> DataFrame:
    """(m, step): for each month up to the longest request, the place of the smallest requested period that holds it. At most
    ``LONGEST_PERIOD`` rows, whatever the requests are."""
    from pyspark.sql import Window
    every = Window.orderBy("months")  # distinct periods: at most LONGEST_PERIOD rows
    periods = requests.select("months").distinct()
    placed = periods.select("months", F.row_number().over(every).alias("step"), F.coalesce(F.lag("months").over(every), F.lit(0)).alias("before"))
    return placed.select(F.explode(F.sequence(F.col("before") + 1, F.col("months"))).alias("m"), "step", "months")


def deals_for_requests(history: DataFrame, products: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """JN-8: all requests in one job, without a range join.

    A row belongs to every period of at least ``ceil(age in days / 30)`` months
    (newer rows, and rows after ``as_of``, to all). Each row gets the smallest requested period that holds
    it (a broadcast of at most ``LONGEST_PERIOD`` months) and history is reduced to one row per (product,
    store, that period); a running sum over a product's periods gives the average of each of them up to the
    next one with rows, and requests meet their period by an equi-join. Periods are few and each holds all
    products, so a period is dealt in ``PERIOD_PARTS`` parts. The history is scanned and shuffled once,
    whatever the requests are; the longest requested period is a literal bound that reaches the scan.
    """
    from pyspark.sql import Window
    age_us = F.timestamp_diff("MICROSECOND", F.col("recorded_at"), ntz_lit(as_of))
    # integer ceiling of age / 30 days
    month = F.floor((age_us + F.lit(30 * DAY_US - 1)) / F.lit(30 * DAY_US).cast("decimal(20,0)")).cast("int")
    req = requests.select("request_id", "months", "discount")
    longest = req.agg(F.max("months")).first()[0] or 0
    steps = requested_periods(req)
    periods = steps.select("step", "months").distinct()
    recent = history.filter(F.col("recorded_at") >= ntz_lit(period_start(as_of, longest)))
    monthly = (recent.withColumn("m", F.greatest(month, F.lit(1))).join(F.broadcast(steps.select("m", "step")), "m")
                     .groupBy("product_id", "store_id", "step").agg(F.sum("price").alias("s"), F.count("price").alias("n")))
    w = Window.partitionBy("product_id", "store_id").orderBy("step")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = periods.agg(F.max("step")).first()[0] or 0
    running = monthly.select(
        "product_id", "store_id", "step", F.sum("s").over(upto).alias("s"), F.sum("n").over(upto).alias("n"),
        F.coalesce(F.lead("step").over(w) - 1, F.lit(last)).alias("last"))
    per_period = (running.select("product_id", "store_id", F.explode(F.sequence("step", "last")).alias("step"),
                                 F.round(F.col("s") / F.col("n"), 6).cast("double").alias("avg_price"))
                         .join(F.broadcast(periods), "step").drop("step"))
    # no broadcast of the catalogue, as in ``price_deals``
    cand = products.join(per_period.withColumnRenamed("product_id", "id").hint("merge"), ["id", "store_id"], "inner")
    part = F.pmod(F.xxhash64("id", "store_id"), F.lit(PERIOD_PARTS)).cast("int")
    every = req.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PERIOD_PARTS - 1))))
    j = cand.withColumn("part", part).join(every, ["months", "part"])
    return j.filter(F.col("price") < F.col("avg_price") * (F.lit(1) - F.col("discount") / F.lit(100))).select(
        "request_id", "months", "discount", F.col("id").alias("product_id"), "name", "store_id", "price",
        F.col("avg_price").alias("average_price"))


def deal_report(deals: DataFrame, months: int, discount: float, as_of: dt.datetime) -> DataFrame:
    """RPT-7 + SRT-2 + FN-14: the header (section 0), one line per deal
    (section 1) or 'No deals found.' (section 2), sorted by section and
    evaluated discount, descending (a range-partitioned sort, applied last)."""
    from ..functions.fmt import ts_text
    spark = deals.sparkSession
    header_text = F.format_string(texts.DEALS_HEADER, F.lit(months), F.lit(str(discount)), ts_text(ntz_lit(as_of)))
    ranked = rank_deals(deals)
    header = spark.range(1).select(F.lit(0).alias("section"), F.lit(None).cast("double").alias("evaluated_discount"),
                                   header_text.alias("line"))
    body = ranked.select(F.lit(1).alias("section"), "evaluated_discount", "line")
    # one global count: a row only when there is no deal
    none = (ranked.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0)
                  .select(F.lit(2).alias("section"), F.lit(None).cast("double").alias("evaluated_discount"),
                          F.lit(texts.NO_DEALS).alias("line")))
    return (header.unionByName(body).unionByName(none)
                  .orderBy("section", F.col("evaluated_discount").desc_nulls_last()))


def report_for_store(report: DataFrame, store_id: str) -> DataFrame:
    """FLT-10: one store's lines (the dashboard's store selector)."""
    return report.filter(F.col("store_id") == store_id)


def deals_in_order(deals: DataFrame) -> DataFrame:
    """SRT-2: ``rank_deals`` with each deal's global ``rank`` (from 1, the largest discount first, then
    product and store), numbered over range partitions."""
    order = [F.col("evaluated_discount").desc_nulls_last(), F.col("product_id"), F.col("store_id")]
    return numbered(rank_deals(deals), "rank", order)


def deal_messages(deals: DataFrame, months: int, discount: float, as_of: dt.datetime,
                  deals_per_message: int = DEALS_PER_MESSAGE) -> DataFrame:
    """FN-16 + the deal job's result messages. The reference sends every deal in one message; here
    message ``part`` (of ``parts``) holds the next ``deals_per_message`` ranks, so that no message grows with
    the deals. Without any deal one message with an empty list is sent: the consumer learns that there is none.
    Prices travel as decimal text (Q18), DECIMAL(10,2) and DECIMAL(20,6) like the reference."""
    spark = deals.sparkSession
    ranked = deals_in_order(deals)
    part = F.floor((F.col("rank") - 1) / deals_per_message).cast("long")
    entry = F.struct(F.col("product_id").alias("id"), "name", "store_id",
                     F.col("price").cast("decimal(10,2)").cast("string").alias("price"),
                     F.col("average_price").cast("decimal(20,6)").cast("string").alias("average_price"))
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("deal"))))
    grouped = ranked.groupBy(part.alias("part")).agg(F.transform(listed, lambda d: d["deal"]).alias("deals"))
    parts = max(1, -(-ranked.count() // deals_per_message))  # of the written ranks
    every = spark.range(parts).select(F.col("id").alias("part")).join(grouped, "part", "left")
    body = F.struct(F.lit("success").alias("status"), F.lit("price_monitor_job_results").alias("task_name"),
                    F.coalesce(F.col("deals"), F.expr("array()").cast(grouped.schema["deals"].dataType)).alias("deals"),
                    F.lit(months).alias("time_window"),
                    F.lit(float(discount)).alias("discount_percentage"),
                    F.lit(as_of.isoformat()).alias("timestamp"), F.col("part"), F.lit(parts).alias("parts"),
                    (F.col("part") * deals_per_message + 1).alias("first_rank"))
    return every.select("part", F.to_json(body).alias("message"))


DEAL_RESULT_DDL = ("status STRING, task_name STRING, deals ARRAY<STRUCT<id: STRING, name: STRING, "
                   "store_id: STRING, price: STRING, average_price: STRING>>, time_window INT, "
                   "discount_percentage DOUBLE, timestamp STRING, part BIGINT, parts BIGINT, first_rank BIGINT")


def decode_deal_messages(messages: DataFrame, column: str = "message") -> DataFrame:
    """FN-16 + FN-14, the dashboard side: result messages -> one row per deal with its rank
    (numbers back from their text, the answer time parsed from ISO text, with
    or without fractional seconds), ready for ``rank_deals``."""
    m = messages.select(F.from_json(F.col(column), DEAL_RESULT_DDL).alias("m"))
    text = F.col("m.timestamp")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                    F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = m.select(F.col("m.time_window").alias("months"), F.col("m.discount_percentage").alias("discount"),
                    at.cast("timestamp_ntz").alias("answered_at"), F.col("m.first_rank").alias("first"),
                    F.posexplode("m.deals").alias("place", "d"))
    return rows.select("months", "discount", "answered_at", (F.col("first") + F.col("place")).alias("rank"),
                       F.col("d.id").alias("product_id"), "d.name",
                       "d.store_id", F.col("d.price").try_cast("double").alias("price"),
                       F.col("d.average_price").try_cast("double").alias("average_price"))


def answer_lines(messages: DataFrame) -> DataFrame:
    """RPT-7 from the result messages: one line per deal, or the line for no deals
    where none of the answer's parts holds one."""
    ranked = rank_deals(decode_deal_messages(messages)).select("evaluated_discount", "line")
    none = (messages.select(F.size(F.from_json("message", DEAL_RESULT_DDL)["deals"]).alias("n"))
            .agg(F.sum("n").alias("n")).filter(F.col("n") == 0)
            .select(F.lit(None).cast("double").alias("evaluated_discount"), F.lit(texts.NO_DEALS).alias("line")))
    return ranked.unionByName(none)
