"""Appends with generated keys (SNK-2, SNK-7).

A batch of rows gets LONG keys without gaps: the rows of each task are counted, the tasks' offsets added, from the
high-water mark on that the batches before left in the manifest ``<path>.ids``. A batch writes its own folder and manifest
entry, so one that is repeated takes the same range of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..schemas import APPENDED_TABLES
from . import files

MANIFEST = "batch_id long, first_id long, rows long"


def next_id(spark: SparkSession, path: str, batch_id: int) -> int:
    """The first key of a batch: after those of the newest batch before it."""
    log = f"{path}.ids"
    done = [n for n in files.numbers_in(spark, log, "batch") if n < batch_id and files.complete(spark, f"{log}/batch={n}")]
    if not done:
        return 1
    last = spark.read.schema(MANIFEST).parquet(f"{log}/batch={done[-1]}").first()
    return last.first_id + last.rows


def append_batch(rows: DataFrame, path: str, batch_id: int, key: str) -> DataFrame:
    """Write ``rows`` with their keys as batch ``batch_id`` of the table; the written rows."""
    spark = rows.sparkSession
    first, out = next_id(spark, path, batch_id), f"{path}/batch_id={batch_id}"
    keyed = numbered(rows, key, start=first).select(key, *rows.columns)
    keyed.write.mode("overwrite").parquet(out)
    own = spark.read.schema(keyed.schema).parquet(out)
    (own.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(first).cast("long").alias("first_id"), F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").parquet(f"{path}.ids/batch={batch_id}"))
    return own


def append_to(table: str, rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """SNK-7: one batch of new rows of an operational table (users, products, stock, purchase_orders). Columns are
    taken by name and cast to the table's types; a missing or unknown column, a value that does not fit, or a null
    where the table allows none refuses the whole batch, as a transaction would."""
    key, columns, required = APPENDED_TABLES[table]
    names = [c.split()[0] for c in columns]
    wrong = sorted(set(names) ^ set(rows.columns))
    if wrong:
        raise ValueError(f"{table}: missing or unknown columns {wrong}")
    typed = rows.select(*[_fitted(c) for c in columns],
                        *[F.col(n).isNotNull().alias(f"_given_{n}") for n in names])
    bad = F.lit(False)
    for n in names:
        bad = bad | (F.col(n).isNull() & (F.col(f"_given_{n}") | F.lit(n in required)))
    refused = typed.where(bad).count()
    if refused:
        raise ValueError(f"{table}: {refused} rows do not fit the table")
    return append_batch(typed.select(*names), path, batch_id, key)


def _fitted(column: str) -> Column:
    """The column in its type; null where the value does not fit (Spark itself cuts or keeps text of any length)."""
    name, kind = column.split(maxsplit=1)
    if kind.startswith("varchar("):
        text = F.col(name).cast("string")
        return F.when(F.length(text) <= int(kind[8:-1]), text).alias(name)
    return F.col(name).try_cast(kind).alias(name)


def read_appended(spark: SparkSession, table: str, path: str) -> DataFrame:
    key, columns, _ = APPENDED_TABLES[table]
    plain = ["{} {}".format(*(c.split()[0], "string" if "varchar" in c else c.split(maxsplit=1)[1])) for c in columns]
    return spark.read.schema(", ".join([f"{key} bigint", *plain])).parquet(path)
