"""Distinct viewers as bitmaps over a numbering of the users (AGG-3, AGG-11).

A bitmap covers 32,768 user numbers; a (window, name, store) has one for each range of numbers that its viewers lie in.
Bitmaps of parts and passes merge by OR, and the merged state no longer holds users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .numbering import numbered

STATE_KEYS = ["window", "name", "store_id", "bucket"]


def number_users(users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user_id, number): every user once, also the null one, numbered from 1 without gaps. Users in ``known`` keep
    their numbers, new ones follow."""
    every = users.select("user_id").distinct()
    if known is None:
        return numbered(every, "number")
    fresh = every.join(known.select(F.col("user_id").alias("_k")), F.col("user_id").eqNullSafe(F.col("_k")), "left_anti")
    last = known.agg(F.max("number")).first()[0] or 0
    return known.unionByName(numbered(fresh, "number", start=last + 1))


def viewer_bitmaps(views: DataFrame, products: DataFrame, numbers: DataFrame, duration: str = "1 minute") -> DataFrame:
    """(window, name, store_id, bucket, bits) of one part of the views. ``numbers`` holds their users."""
    sets = metrics.viewer_sets(views, products, duration)
    side = numbers.select(F.col("user_id").alias("_u"), "number")
    placed = sets.join(side, F.col("user_id").eqNullSafe(F.col("_u")))
    return (placed.groupBy("window", "name", "store_id", F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))


def merge_bitmaps(*states: DataFrame) -> DataFrame:
    """One state of several: a user in two parts is one bit."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*STATE_KEYS).agg(F.bitmap_or_agg("bits").alias("bits"))


def unique_users_from_bitmaps(state: DataFrame) -> DataFrame:
    """AGG-3 from a merged state; ``All`` is the sum of the stores (Q6)."""
    rows = state.select("window", "name", "store_id", F.bitmap_count("bits").alias("n"))
    agg = (rows.groupingSets([["window", "name", "store_id"], ["window", "name"]], "window", "name", "store_id")
           .agg(F.sum("n").alias("unique_users"), F.grouping("store_id").alias("_g")))
    return agg.select(F.col("window.start").cast("string").alias("window_start"), F.col("window.end").alias("window_end"), "name",
                      F.when(F.col("_g") == 1, F.lit(metrics.ALL)).otherwise(F.col("store_id")).alias("store_id"), "unique_users")
