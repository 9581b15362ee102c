"""Metrics kept across passes (AGG-11, STR-5, STR-8).

The state is one table of mergeable counts, (kind, minute, store, product) -> n, partitioned by day. A pass merges
the counts of its events into the days they touch and rewrites only those; purchases, revenue and the
view ranking are read from it. Rows behind the watermark of the passes before go to a side table, and a
correction pass merges them into just their windows, so that nothing is lost.
Passes and corrections share one numbering; repeating one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timewin import duration_us, shift, tumble_start
from ..operators import metrics
from ..sinks import files
from ..sinks.merge import merge_batch

MINUTE = "1 minute"
KEYS = ["day", "kind", "minute", "store_id", "product_id"]
STATE = "kind string, minute timestamp_ntz, store_id string, product_id string, n bigint, day date"


def minute_counts(tagged: DataFrame) -> DataFrame:
    """(kind, store_id, product_id, datetime) events -> their counts; events without time are in no window."""
    timed = tagged.where("datetime is not null")
    rows = timed.select("kind", tumble_start(timed, "datetime", MINUTE).alias("minute"), "store_id", "product_id")
    return (rows.groupBy("kind", "minute", "store_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("day", F.col("minute").cast("date")))


class MetricTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], STATE).schema

    def _merge(self, number: int, fresh: DataFrame) -> DataFrame:
        def summed(old, new):
            return old.unionByName(new).groupBy(*KEYS).agg(F.sum("n").alias("n"))
        return merge_batch(self.spark, self.path, number, fresh, "day", summed, self.schema.names, self.schema)

    def add(self, number: int, tagged: DataFrame) -> DataFrame:
        """One pass: merge the events' counts; returned are the rewritten days."""
        return self._merge(number, minute_counts(tagged))

    def watermark(self, number: int):
        """The newest event of all passes before ``number``."""
        marks = [n for n in files.numbers_in(self.spark, f"{self.path}.marks", "pass")
                 if n < number and files.complete(self.spark, f"{self.path}.marks/pass={n}")]
        if not marks:
            return None
        paths = [f"{self.path}.marks/pass={n}" for n in marks]
        return self.spark.read.schema("newest timestamp_ntz").parquet(*paths).agg(F.max("newest")).first()[0]

    def add_on_time(self, number: int, tagged: DataFrame, delay: str) -> DataFrame:
        """One pass of a stream-like source: events more than ``delay`` before the newest event of earlier
        passes are late; they wait in the side table, the others are merged."""
        newest = self.watermark(number)
        late = F.lit(False)
        if newest is not None:
            late = F.col("datetime") < F.timestamp_add("MICROSECOND", F.lit(-duration_us(delay)), F.lit(str(newest)).cast("timestamp_ntz"))
        late = F.coalesce(late, F.lit(False))
        minute_counts(tagged.where(late)).write.mode("overwrite").parquet(f"{self.path}.late/pass={number}")
        tagged.agg(F.max("datetime").alias("newest")).write.mode("overwrite").parquet(f"{self.path}.marks/pass={number}")
        return self.add(number, tagged.where(~late))

    def late(self, below: int, since: int = -1) -> DataFrame:
        """Counts of the late rows of the passes after ``since`` and before ``below``."""
        paths = [f"{self.path}.late/pass={n}" for n in files.numbers_in(self.spark, f"{self.path}.late", "pass") if since < n < below]
        schema = minute_counts(self.spark.createDataFrame(
            [], "kind string, datetime timestamp_ntz, store_id string, product_id string")).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def correct(self, number: int) -> int:
        """Merge all rows that were late since the last correction; the number of windows corrected."""
        done = [n for n in files.numbers_in(self.spark, f"{self.path}.corrections", "pass") if n < number]
        found = self.late(number, done[-1] if done else -1)
        windows = found.select("kind", "minute").distinct()
        windows.write.mode("overwrite").parquet(f"{self.path}.corrections/pass={number}")
        self._merge(number, found.groupBy(*KEYS).agg(F.sum("n").alias("n")))
        return self.spark.read.schema(windows.schema).parquet(f"{self.path}.corrections/pass={number}").count()

    def corrected(self) -> DataFrame:
        """(kind, minute) of every window that a correction changed."""
        paths = [f"{self.path}.corrections/pass={n}" for n in files.numbers_in(self.spark, f"{self.path}.corrections", "pass")]
        schema = "kind string, minute timestamp_ntz"
        return self.spark.read.schema(schema).parquet(*paths).distinct() if paths else self.spark.createDataFrame([], schema)

    def rows(self, kind: str) -> DataFrame:
        if not files.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema).where(F.col("kind") == kind)
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("kind") == kind)

    def _windows(self, kind: str, duration: str) -> DataFrame:
        rows = self.rows(kind)
        start = tumble_start(rows, "minute", duration)
        return rows.withColumn("start", start).select(
            F.struct("start", shift(F.col("start"), duration).alias("end")).alias("window"), "store_id", "product_id", "n")

    def purchases(self, duration: str = MINUTE) -> DataFrame:
        return metrics.units_per_window(self._windows("buy", duration), F.sum("n"))

    def revenue(self, products: DataFrame, duration: str = MINUTE) -> DataFrame:
        return metrics.viewed_price(metrics.with_attributes(self._windows("view", duration), products, "price"))

    def ranking(self, products: DataFrame, duration: str = "1 hour") -> DataFrame:
        per_product = self._windows("view", duration).groupBy("window", "store_id", "product_id").agg(F.sum("n").alias("n"))
        return metrics.views_per_name(metrics.with_attributes(per_product, products, "name"))
