"""Bonus eligibility (AGG-8, JN-3, FLT-4, SNK-1, RPT-8, AGG-12).

Spend is summed over two epoch-aligned tumbling horizons, 10 minutes and
6 hours (Q12). The reference joins *every* passing 6-hour window of a user with
*every* passing 10-minute window (Q13); that pair list grows with the square of
a user's activity. Here the same answer is given as counts per (user, store):
``windows_6h * windows_10m`` is the number of pairs the reference emits, and no
pair is ever materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.timewin import duration_us, shift, tumble_start

# Bonus horizons and thresholds (strictly greater): 500 in 10 minutes, 2000 in 6 hours.
SHORT = "10 minutes"
LONG = "6 hours"
MIN_SHORT = 500.0
MIN_LONG = 2000.0


def spend() -> F.Column:
    """Spend as an exact decimal: a sum at a threshold must not depend on the order of rows."""
    return F.sum(F.col("price").cast("double").cast("decimal(20,6)"))


def spend_totals(purchases: DataFrame, short: str = SHORT, long: str = LONG) -> DataFrame:
    """AGG-8: spend per (horizon, window, user, store). Purchases are combined
    once, by the short window; the long windows are sums of the short ones they hold."""
    return _totals(purchases, short, long).withColumn("total", F.col("total").cast("double"))


def _totals(purchases: DataFrame, short: str, long: str) -> DataFrame:
    assert duration_us(long) % duration_us(short) == 0, "short horizon must divide the long one"
    small = (purchases.groupBy(tumble_start(purchases, "datetime", short).alias("s"), "user_id", "store_id")
                      .agg(spend().alias("total")))
    large = (small.groupBy(tumble_start(small, "s", long).alias("s"), "user_id", "store_id")
                  .agg(F.sum("total").cast("decimal(30,6)").alias("total")))

    def rows(df, horizon, size):
        return df.select(F.lit(horizon).alias("horizon"), F.col("s").cast("string").alias("window_start"),
                         shift(F.col("s"), size).alias("window_end"), "user_id", "store_id",
                         F.col("total").cast("decimal(30,6)").alias("total"))

    return rows(small, "10m", short).unionByName(rows(large, "6h", long))


def bonus_eligible(purchases: DataFrame, min_short: float = MIN_SHORT, min_long: float = MIN_LONG,
                   short: str = SHORT, long: str = LONG) -> DataFrame:
    """JN-3 + FLT-4, reference reading: users with at least one 6-hour window
    over ``min_long`` and at least one 10-minute window over ``min_short`` (any
    two windows, unrelated in time). One row per (user, store) with the number
    of passing windows of each horizon and the pair count."""
    long_tot = _long_windows(purchases, min_short, short, long)
    agg = long_tot.groupBy("user_id", "store_id").agg(
        F.count_if(F.col("total_6h") > min_long).alias("windows_6h"), F.sum("windows_10m").alias("windows_10m"))
    return (agg.filter((F.col("windows_6h") > 0) & (F.col("windows_10m") > 0))
               .withColumn("pairs", F.col("windows_6h") * F.col("windows_10m")))


def _long_windows(purchases: DataFrame, min_short: float, short: str, long: str) -> DataFrame:
    """(l, user_id, store_id, total_6h, windows_10m): each long window's spend and its short windows over ``min_short``. The
    purchases are combined once, by the short window; a long window is a sum of the short ones that lie in it."""
    assert duration_us(long) % duration_us(short) == 0, "short horizon must divide the long one"
    short_tot = (purchases.groupBy(tumble_start(purchases, "datetime", short).alias("s"), "user_id", "store_id")
                          .agg(spend().alias("total_10m")))
    return (short_tot.groupBy(tumble_start(short_tot, "s", long).alias("l"), "user_id", "store_id")
                     .agg(F.sum("total_10m").alias("total_6h"), F.count_if(F.col("total_10m") > min_short).alias("windows_10m")))


def bonus_contained(purchases: DataFrame, min_short: float = MIN_SHORT, min_long: float = MIN_LONG,
                    short: str = SHORT, long: str = LONG) -> DataFrame:
    """JN-3, contained reading: 6-hour windows over ``min_long`` holding a
    10-minute window over ``min_short``. The short windows are rolled up into the
    long one they lie in (10 minutes divides 6 hours), so no join is needed."""
    long_tot = _long_windows(purchases, min_short, short, long)
    return long_tot.filter((F.col("total_6h") > min_long) & (F.col("windows_10m") > 0)).select(
        "user_id", "store_id", F.col("l").cast("string").alias("window_start"),
        shift(F.col("l"), long).alias("window_end"), F.col("total_6h").cast("double").alias("total_6h"), "windows_10m")


def _buckets(spend: DataFrame, per: int) -> DataFrame:
    """Spend summed over ``per`` consecutive buckets."""
    return (spend.groupBy("user_id", "store_id", F.floor(F.col("b") / per).cast("long").alias("b"))
                 .agg(F.sum("s").cast("decimal(30,6)").alias("s")))


def _best_window(buckets: DataFrame, k: int, name: str) -> DataFrame:
    """Largest spend in any ``k`` consecutive buckets, per (user, store): a range sum
    over the buckets; the best window ends on a bucket with a purchase, so only
    those are evaluated. A user's rows are bounded by the time span / bucket size."""
    from pyspark.sql import Window
    w = Window.partitionBy("user_id", "store_id").orderBy("b").rangeBetween(-(k - 1), 0)
    return (buckets.withColumn("win", F.sum("s").over(w))
                   .groupBy("user_id", "store_id").agg(F.max("win").alias(name)))


def bonus_sliding(purchases: DataFrame, min_short: float = MIN_SHORT, min_long: float = MIN_LONG,
                  short: str = SHORT, short_slide: str = "1 minute", long: str = LONG,
                  long_slide: str = "10 minutes") -> DataFrame:
    """Q12, the "last 10 minutes / last 6 hours" reading: sliding windows
    instead of epoch-aligned tumbling ones. One row per eligible (user, store)
    with the best spend of each horizon. Purchases are combined once, by the
    small step; the large step's buckets are sums of those."""
    from ..functions.timewin import epoch_us, is_ntz
    step, wide = duration_us(short_slide), duration_us(long_slide)
    assert duration_us(short) % step == 0 and duration_us(long) % wide == 0 and wide % step == 0
    idx = F.floor(epoch_us(F.col("datetime"), is_ntz(purchases, "datetime")) / F.lit(step)).cast("long")
    fine = purchases.groupBy("user_id", "store_id", idx.alias("b")).agg(spend().alias("s"))
    a = _best_window(fine, duration_us(short) // step, "best_10m")
    c = _best_window(_buckets(fine, wide // step), duration_us(long) // wide, "best_6h")
    # both sides are one row per (user, store), partitioned alike: no pair growth
    return (a.join(c, ["user_id", "store_id"])
             .filter((F.col("best_10m") > min_short) & (F.col("best_6h") > min_long))
             .select("user_id", "store_id", F.col("best_10m").cast("double").alias("best_10m"),
                     F.col("best_6h").cast("double").alias("best_6h")))


def bonus_messages(eligible: DataFrame) -> DataFrame:
    """SNK-1 / RPT-8: one JSON value per eligible user, and the coupon line."""
    return eligible.select(
        "user_id", "store_id",
        F.to_json(F.struct("user_id", "store_id")).alias("value"),
        F.format_string(texts.COUPON_LINE,
                        F.col("user_id"), F.col("store_id")).alias("line"))


def bonus_count(eligible: DataFrame) -> DataFrame:
    """AGG-12: number of eligible (user, store) rows."""
    return eligible.agg(F.count(F.lit(1)).alias("eligible_users"))


def coupon_lines(messages: DataFrame, column: str = "value") -> DataFrame:
    """RPT-8, the consumer's side: JSON ``{user_id, store_id}`` -> the coupon line.
    Values that are no JSON object are left out, as the consumer reports and skips them."""
    m = messages.select(F.from_json(F.col(column), "user_id STRING, store_id STRING", {"mode": "PERMISSIVE"}).alias("m"))
    return (m.where("m is not null and m.user_id is not null and m.store_id is not null")
             .select("m.user_id", "m.store_id", F.format_string(texts.COUPON_LINE, F.col("m.user_id"), F.col("m.store_id")).alias("line")))
