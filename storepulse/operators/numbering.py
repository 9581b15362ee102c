"""Consecutive numbers for the rows of a frame, without a window over all of them.

Each task numbers its own rows, the rows are written once, and a row's number is its place
in its task plus the rows of all tasks before. Only one row for each task is ever ordered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

TASK_BITS = 33  # monotonically_increasing_id() keeps the task above these bits


def numbered(df: DataFrame, out: str, order: list[Column] | None = None, start: int = 1) -> DataFrame:
    """``df`` with ``out``: LONG numbers from ``start`` without gaps, by ``order`` (range partitioned and
    sorted; columns that make it total make the numbers repeatable) or as the rows come."""
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = rows.withColumn("_place", F.monotonically_increasing_id())
    path = scratch_path(spark, "numbered")
    rows.write.parquet(path)
    held = spark.read.schema(rows.schema).parquet(path).withColumn("_task", F.shiftright("_place", TASK_BITS))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offset = (held.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
              .select("_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_first")))
    own = F.col("_place").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return held.join(offset, "_task").withColumn(out, F.col("_first") + own).drop("_place", "_task", "_first")
