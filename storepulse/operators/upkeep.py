"""Stock and prices kept as tables laid out by key bucket (JN-5, JN-6, JN-7).

A batch of sales or price moves rewrites only the buckets its keys lie in, and the rows that changed come from the
same pass. A repeated batch changes nothing; see ``sinks.merge``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timewin import ntz_lit
from ..sinks.merge import bucket, lay_out, merge_batch
from .prices import moved_price
from .stock import KEYS, sales_per_product

BUCKETS = 64
STOCK = "product_id string, store_id string, quantity bigint, bucket int"
PRODUCTS = "id_product bigint, id string, store_id string, name string, price decimal(10,2), bucket int"
PRODUCT_KEY = ["id_product"]


def create_stock(stock: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    lay_out(stock.select("product_id", "store_id", F.col("quantity").cast("long").alias("quantity"), bucket(KEYS, buckets).alias("bucket")),
            path, "bucket")


def create_products(products: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    lay_out(products.select("id_product", "id", "store_id", "name", "price", bucket(PRODUCT_KEY, buckets).alias("bucket")), path, "bucket")


def read_stock(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOCK).parquet(path).drop("bucket")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCTS).parquet(path).drop("bucket")


def sell(spark: SparkSession, path: str, number: int, buys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """JN-5 + AGG-14: take batch ``number`` of bought units off the stock; sales without a stock row update nothing (Q29).
    The rows that changed: product_id, store_id, before, after."""
    schema = spark.createDataFrame([], STOCK).schema
    fresh = sales_per_product(buys).withColumn("bucket", bucket(KEYS, buckets))

    def merge(old, new):
        j = old.join(new.drop("bucket"), KEYS, "left")
        return j.select(*KEYS, (F.col("quantity") - F.coalesce("sold", F.lit(0))).alias("quantity"),
                        F.when(F.col("sold") > 0, F.col("quantity")).alias("before"), "bucket")

    rows = merge_batch(spark, path, number, fresh, "bucket", merge, schema.names, schema)
    return rows.where("before is not null").select(*KEYS, "before", F.col("quantity").alias("after"))


def move_prices(spark: SparkSession, path: str, number: int, moves: DataFrame, as_of: dt.datetime, buckets: int = BUCKETS) -> DataFrame:
    """JN-6 + JN-7 + FN-12: apply batch ``number`` of moves (id_product, cents); one history row for every price that
    really changed: product_id, price, store_id, recorded_at."""
    schema = spark.createDataFrame([], PRODUCTS).schema
    fresh = moves.groupBy("id_product").agg(F.sum("cents").alias("cents")).withColumn("bucket", bucket(PRODUCT_KEY, buckets))

    def merge(old, new):
        j = old.join(new.drop("bucket"), PRODUCT_KEY, "left")
        price = F.when(F.col("cents").isNull(), F.col("price")).otherwise(moved_price(F.col("price"), F.col("cents")))
        return j.select("id_product", "id", "store_id", "name", price.alias("price"), F.col("price").alias("before"), "bucket")

    rows = merge_batch(spark, path, number, fresh, "bucket", merge, schema.names, schema)
    return rows.where("price <> before").select(F.col("id").alias("product_id"), "price", "store_id", ntz_lit(as_of).alias("recorded_at"))
