"""Latest window per store (WIN-1), top-k per store (TOP-1), merge of partial
results (AGG-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, key: str, order_col: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return df.withColumn("_rank", F.dense_rank().over(w))


def last_window(df: DataFrame, key: str = "store_id", order_col: str = "window_end") -> DataFrame:
    """WIN-1, rank == 1: rows of the newest window of each key.

    ``dense_rank() = 1`` is planned with a group limit on both sides of the
    shuffle: each task forwards only its rows of the newest window per key, and
    the input is computed once (no self-join re-reading it).
    """
    return _ranked(df, key, order_col).filter(F.col("_rank") == 1).drop("_rank")


def older_windows(df: DataFrame, key: str = "store_id", order_col: str = "window_end") -> DataFrame:
    """WIN-1, rank > 1: all rows of earlier windows. The newest window of each
    key is a map-side combined aggregate joined back, so no task ranks a key."""
    newest = df.groupBy(F.col(key).alias("_key")).agg(F.max(order_col).alias("_newest"))
    return (df.join(newest, F.col(key).eqNullSafe(F.col("_key")))
              .filter(F.col(order_col) < F.col("_newest")).drop("_key", "_newest"))


def top_n(df: DataFrame, metric: str, n: int = 10, key: str = "store_id",
          tie: str | None = "name") -> DataFrame:
    """TOP-1 / WIN-3: first ``n`` rows per key by metric desc, ties by ``tie``.

    ``row_number() <= n`` is planned with a per-partition group limit before the
    shuffle, so each task forwards at most ``n`` rows per key.
    """
    order = [F.col(metric).desc_nulls_last()]
    if tie:
        order.append(F.col(tie).asc_nulls_first())
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def merge_partials(df1: DataFrame, df2: DataFrame, group_columns: list[str], agg_column: str) -> DataFrame:
    """AGG-11: union of two partial results, re-summed per group."""
    return (df1.unionByName(df2).groupBy(*group_columns)
               .agg(F.sum(agg_column).alias(agg_column)))
