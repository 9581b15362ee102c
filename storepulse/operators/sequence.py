"""Per-key sequence operators that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; with
one user or product holding a third of all rows that task does a third of the
work. Both operators here split each key into time buckets (``bucket`` column,
e.g. the day), do the per-row work inside (key, bucket) partitions, and fix up
the bucket borders from a small per-(key, bucket) summary (one row per bucket),
the classic two-level prefix computation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality of the keys: null users or products are a sequence like any other."""
    cond = left[keys[0]].eqNullSafe(right[f"_r_{keys[0]}"])
    for k in keys[1:]:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def _carried(df: DataFrame, summary: DataFrame, part: list[str], column: str) -> DataFrame:
    side = summary.select(*[F.col(k).alias(f"_r_{k}") for k in part], column)
    return df.join(side, _same(df, side, part), "left").drop(*[f"_r_{k}" for k in part])


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: str,
               out: str = "next_value") -> DataFrame:
    """``lead(value)`` over ``keys`` ordered by ``order`` (bucket must be
    monotone in ``order``), computed per (keys, bucket).

    The summary (first value of each bucket) is aggregated from the input with a
    map-side combine, so only the windowed branch shuffles whole rows."""
    part = keys + [bucket]
    firsts = df.groupBy(*part).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"))
    wb = Window.partitionBy(*keys).orderBy(bucket)
    carry = firsts.select(*part, F.lead("_first").over(wb)["v"].alias("_carry"))
    w = Window.partitionBy(*part).orderBy(*order)
    local = (df.withColumn("_lead", F.lead(value).over(w))
               .withColumn("_is_last", F.lead(F.lit(1)).over(w).isNull()))
    return (_carried(local, carry, part, "_carry")
            .withColumn(out, F.when(F.col("_is_last"), F.col("_carry")).otherwise(F.col("_lead")))
            .drop("_lead", "_is_last", "_carry"))


def count_before(df: DataFrame, keys: list[str], order: list[str], flag: str, bucket: str,
                 out: str = "count_before") -> DataFrame:
    """For every row, the number of earlier rows (by ``order``) of the same key
    with ``flag`` = 1; rows tied on ``order`` are ordered by ``order`` only, so
    callers add a tie-breaker column when ties must not count."""
    part = keys + [bucket]
    per_bucket = df.groupBy(*part).agg(F.sum(flag).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*part, F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_offset"))
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(flag).over(w), F.lit(0)))
    return (_carried(local, offsets, part, "_offset")
            .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long")).drop("_local", "_offset"))
