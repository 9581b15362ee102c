"""Table scans (SRC-4) and the fixture views that map the driver tables onto the
store data model (FIXTURES.md section 3).

Every view is a projection/aggregation of the whole given table: nothing is
sampled or capped, so work grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number of stores the driver tables are spread over, and products per store in
# the event stream (props.k in 0..99 -> store k div 20, product k mod 20).
N_STORES = 5
PRODUCTS_PER_STORE = 20


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table by name (column pruning and filters reach the scan)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Rows of one range of a partitioned read.
JDBC_ROWS = 1_000_000


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, rows_per_task: int = JDBC_ROWS, **settings: str) -> DataFrame:
    """SRC-4 over JDBC: a partitioned read (parallel range scans on the numeric ``key``). Its bounds and the
    number of ranges come from the table itself, so no task reads a whole table. Connection settings (user, password,
    driver) are passed in, never read from the environment."""
    base = {"url": url, **settings}
    bounds = spark.read.format("jdbc").options(**base, query=bounds_query(table, key)).load().first()
    return spark.read.format("jdbc").options(**base, dbtable=table, **read_ranges(key, *bounds, rows_per_task)).load()


def bounds_query(table: str, key: str) -> str:
    return f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}"


def read_ranges(key: str, lo: int | None, hi: int | None, n: int, rows_per_task: int) -> dict[str, str]:
    """Options of a read in ranges of about ``rows_per_task`` rows; none for an empty table."""
    if lo is None or hi is None:
        return {}
    return {"partitionColumn": key, "lowerBound": str(lo), "upperBound": str(hi + 1),
            "numPartitions": str(max(1, min(-(-n // rows_per_task), hi + 1 - lo)))}


def _store(expr) -> F.Column:
    return F.concat(F.lit("store_"), expr.cast("string"))


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (event_id, ts, user_id, event_type, value, store_id, product_id)."""
    ev = load_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type", "value",
        _store(F.floor(k / PRODUCTS_PER_STORE)).alias("store_id"),
        F.pmod(k, F.lit(PRODUCTS_PER_STORE)).cast("string").alias("product_id"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> products(id_product, id, store_id, name, price DECIMAL(10,2)).

    Every part row is one catalogue version of a (id, store_id) product, so the
    table holds many versions per business key (as the reference's table does,
    Q28); ``current_products`` keeps the newest.
    """
    p = load_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("id_product"),
        F.pmod(key, F.lit(PRODUCTS_PER_STORE)).cast("string").alias("id"),
        _store(F.pmod(F.floor(key / PRODUCTS_PER_STORE), F.lit(N_STORES))).alias("store_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> stock(product_id, store_id, quantity) = 100 - units shipped."""
    li = load_table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_partkey").cast("string").alias("product_id"),
                       _store(F.pmod("l_suppkey", F.lit(N_STORES))).alias("store_id"))
              .agg((F.lit(100) - F.sum(F.col("l_quantity").cast("int"))).alias("quantity")))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> price_history(product_id, store_id, price DECIMAL(10,2), recorded_at).

    The unit price is kept as DECIMAL(10,2) like the reference table, so sums
    and averages over it are exact and do not depend on summation order.
    """
    li = load_table(spark, sf_dir, "lineitem")
    # unit price = extended price / quantity, half-up to cents, in integer arithmetic
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    unit_cents = F.floor((cents * 2 + qty).cast("decimal(20,0)") / (qty * 2))
    return li.select(
        F.col("l_partkey").cast("string").alias("product_id"),
        _store(F.pmod("l_suppkey", F.lit(N_STORES))).alias("store_id"),
        (unit_cents.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(2,2)")).cast("decimal(10,2)").alias("price"),
        F.col("l_shipdate").alias("recorded_at"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part x stores -> current price per (id, store_id), used by the deal search."""
    p = load_table(spark, sf_dir, "part")
    stores = F.transform(F.sequence(F.lit(0), F.lit(N_STORES - 1)), lambda s: _store(s))
    return p.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.explode(stores).alias("store_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
    )
