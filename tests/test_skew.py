"""Skew-safe sequence operators equal the plain per-key window, with one key
holding a third of all rows spread over many buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from storepulse.operators.sequence import count_before, next_value


def _skewed(spark, n=30000):
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") * 7919 % 5).cast("string").alias("v"),
        (F.col("id") % 2).cast("int").alias("flag"))
    return base.withColumn("bucket", F.floor(F.col("seq") / 500))


def test_next_value_matches_plain_lead(spark):
    df = _skewed(spark)
    got = next_value(df, ["k"], ["seq"], "v", "bucket", out="nxt").select("k", "seq", "nxt")
    plain = df.select("k", "seq", F.lead("v").over(Window.partitionBy("k").orderBy("seq")).alias("nxt"))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_count_before_matches_plain_running_count(spark):
    df = _skewed(spark)
    got = count_before(df, ["k"], ["seq"], "flag", "bucket", out="c").select("k", "seq", "c")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "seq", F.coalesce(F.sum("flag").over(w), F.lit(0)).cast("long").alias("c"))
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
