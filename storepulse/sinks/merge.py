"""Keyed batches merged into a partitioned table, rewriting only the partitions they meet.

A batch has a number. Its partitions are merged into a staging folder first; once that is
complete, they replace those of the table (dynamic partition overwrite) and the batch is marked. A batch
that failed in between is taken up from its staging folder, one that is marked, or older than
a marked one, changes nothing. Other partitions keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import files


def bucket(keys: list[str], buckets: int) -> Column:
    """The key bucket that lays out a table without a natural partition."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def lay_out(rows: DataFrame, path: str, part: str) -> None:
    """Write ``rows`` as a table partitioned by ``part``; a large partition is several files."""
    rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(path)


def folder(part: str, value) -> str:
    """The folder of a partition (dates and integers, whose text needs no escapes)."""
    return f"{part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"


def chosen(part: str, values: list) -> Column:
    """Rows of the partitions ``values``; a filter on the partition column alone, so others are not listed."""
    known = [v for v in values if v is not None]
    found = F.col(part).isin(known) if known else F.lit(False)
    return found | F.col(part).isNull() if len(known) < len(values) else found


def merge_batch(spark: SparkSession, path: str, number: int, fresh: DataFrame, part: str,
                merge: Callable[[DataFrame, DataFrame], DataFrame], columns: list[str], schema) -> DataFrame:
    """Merge ``fresh`` (with the column ``part``) into the table at ``path`` of ``schema``. ``merge(old, fresh)`` gives the new
    rows of the partitions met, with ``columns`` of the table and any others; returned are those rows as staged
    (none where the batch is of the past), so that a caller reads what changed from the same pass."""
    log = f"{path}.batches"
    staged = f"{log}/batch={number}"
    applied = files.numbers_in(spark, log, "applied")
    if applied and applied[-1] > number:
        return merge(spark.createDataFrame([], schema), fresh.limit(0)).where(F.lit(False))
    if not files.complete(spark, staged):
        held = scratch_path(spark, "fresh")
        fresh.write.parquet(held)  # computed once: it is read for its partitions and for its rows
        fresh = spark.read.schema(fresh.schema).parquet(held)
        met = [r[0] for r in fresh.select(part).distinct().collect()]  # partitions, not rows
        old = (spark.read.schema(schema).parquet(path).where(chosen(part, met)) if files.exists(spark, path)
               else spark.createDataFrame([], schema))
        for v in met:
            files.mark(spark, f"{log}/met={number}/{folder(part, v)}")
        merge(old, fresh).hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(staged)
    if number not in applied:
        rows = _staged(spark, staged, part, schema)
        if rows is not None:
            (rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(part).parquet(path))
        # a partition that lost all its rows is in no write
        for name in files.names_in(spark, f"{log}/met={number}"):
            if not files.exists(spark, f"{staged}/{name}"):
                files.delete(spark, f"{path}/{name}")
        files.mark(spark, f"{log}/applied={number}")
        for n in files.numbers_in(spark, log, "batch"):
            if n < number:
                files.delete(spark, f"{log}/batch={n}")
                files.delete(spark, f"{log}/met={n}")
    rows = _staged(spark, staged, part, schema)
    return rows if rows is not None else merge(spark.createDataFrame([], schema), fresh.limit(0)).where(F.lit(False))


def _staged(spark: SparkSession, staged: str, part: str, schema) -> DataFrame | None:
    """The staged rows, the partition column in the table's type; None where the batch was empty."""
    if not any(spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
               .load(staged).select("path").head(1)):
        return None
    rows = spark.read.option("basePath", staged).parquet(staged)
    return rows.withColumn(part, F.col(part).cast(schema[part].dataType))
