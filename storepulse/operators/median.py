"""Median of the views-before-buy histogram (AGG-6, AGG-15, WIN-2).

The histogram has one row per distinct view count per store, so its size is
bounded by the largest view count, not by the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median_views_ref(hist: DataFrame) -> DataFrame:
    """Dashboard rule (Q8): smallest ``views`` whose running count reaches
    floor(N / 2), plus the range and the total of the histogram."""
    running = Window.partitionBy("store_id").orderBy("views").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("store_id")
    h = (hist.withColumn("cum", F.sum("count").over(running))
             .withColumn("total", F.sum("count").over(whole)))
    return (h.groupBy("store_id").agg(
        F.min(F.when(F.col("cum") >= F.floor(F.col("total") / 2), F.col("views"))).alias("median_views"),
        F.min("views").alias("min_views"),
        F.max("views").alias("max_views"),
        F.first("total").alias("total_buys")))


def median_views(hist: DataFrame) -> DataFrame:
    """True weighted median (0.5 percentile, interpolated) per store."""
    return hist.groupBy("store_id").agg(
        F.percentile(F.col("views"), F.lit(0.5), F.col("count")).alias("median_views"))
